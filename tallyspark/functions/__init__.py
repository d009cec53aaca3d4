from . import plan_size, scalar, states

__all__ = ["plan_size", "scalar", "states"]
