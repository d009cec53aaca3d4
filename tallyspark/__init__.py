"""Repeated-visit inventory analytics as composable Spark DataFrame operators."""
