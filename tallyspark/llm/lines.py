"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Lines are cut at ``\\n``, compared in lower case without blanks at the ends; blank lines are never touched. Two lines are
near-duplicates if the Jaccard similarity of their sets of 5-character shingles is 0.8 or more (a shorter line is its own
shingle). One line of each component stays, the one with the smallest (key, line number); rows that repeat key and text
are one document given twice and are treated alike, a null key sorts last. A null text has no lines and stays null. An
empty table gives an empty result. Only the key and text columns are read.

Signatures. All 5-character shingles of a line, the set that is compared in the end, are hashed. Lines below 64 shingles: the
hashes are taken in eight orders; the smallest and the largest of each are 16 MinHash values. They form a 4 x 4 grid, and its
rows, columns and two Latin squares give 16 bands of four values in which no two values meet twice and the two values of one
order never: lines of similarity 0.8 share a band with a probability of about 0.98. Longer lines: the hashes are cut at 16 fixed
points, and a band is the smallest hashes beyond its point, five of them below 160 shingles and six from 128 on (one permutation
for all points; a union's smallest hashes are all in both lines with a probability of nearly similarity ** 5 or ** 6). Bands of
more values keep lines apart that only share common syllables, whose pairs grow with the square of the input. A line whose
size lets a similar one fall on the other side of a limit has the bands of both sides. Texts are signed where they are read,
and equal lines collapse to one before anything is compared.

Verification. In each band bucket every line is compared with the smallest line and with its predecessor. Then, for buckets
whose lines are not one component, the lines outside the bucket's largest component are compared with all lines of other
components. So every pair of a bucket is compared or is in one component already, and a large group of near copies costs
links in proportion to its size. Pairs that cannot be similar are passed over by bounds that lose none: the
sizes of their sets, and for all pairs of such buckets the number of bits in which the parities of the sets' hash counts differ,
which is at most the number of shingles that only one line has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .components import components

SHINGLE = 5
ORDERS = 8
BITS = ("b0", "b1", "b2", "b3")
SIMILARITY = 0.8
POINTS = 16
SHORT, LONG = 64, 160  # shingles from which on bands are the smallest hashes beyond a point, and from which on they are more
WIDE = (5, 6)  # hashes in a band of such lines

_TIMES2, _TIMES3 = (0, 2, 3, 1), (0, 3, 1, 2)  # multiplication by two and three in the field of four elements
_CELLS = sorted(range(16), key=lambda c: (c // 4 ^ _TIMES3[c % 4], c))  # values 2k and 2k + 1, of one order, lie where no band holds both
GROUPS = [[[v for v, c in enumerate(_CELLS) if f(c // 4, c % 4) == g] for g in range(4)]
          for f in (lambda i, j: i, lambda i, j: j, lambda i, j: i ^ j, lambda i, j: i ^ _TIMES2[j])]


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def hashes(line: Column, size: int = SHINGLE) -> Column:
    """Hashes of all character shingles of a line, repeats included; four bytes a character, so that they are cut without counting."""
    starts = lambda b: F.sequence(F.lit(1), F.greatest(F.octet_length(b) - (4 * size - 1), F.lit(1)), F.lit(4))
    return _let(F.encode(line, "UTF-32"), lambda b: F.transform(starts(b), lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * size)))))


def shingles(line: Column) -> Column:
    """Distinct hashes of all character shingles of a line."""
    return F.array_distinct(hashes(line))


def signature(line: Column) -> Column:
    """16 MinHash values of a line, the smallest and the largest hash of all its shingles in each order."""
    seeds = F.array(*[F.lit(k) for k in range(ORDERS)])
    return _let(hashes(line), lambda s: F.flatten(F.transform(seeds, lambda k: _let(
        F.transform(s, lambda h: F.xxhash64(h, k)), lambda t: F.array(F.array_min(t), F.array_max(t))))))


def parities(line: Column) -> Column:
    """The number of shingles of a line, and the parities of how many fall to each of 256 values of their hash, as four numbers."""
    def flip(s: Column, k: int) -> Column:
        mine = F.filter(s, lambda h: h.bitwiseAND(F.lit(3)) == k)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 2).bitwiseAND(F.lit(63)).cast("int"))))

    return _let(shingles(line), lambda s: F.struct(F.size(s).alias("size"), *[flip(s, k).alias(x) for k, x in enumerate(BITS)]))


def signed(lines: DataFrame, similarity: float) -> DataFrame:
    """lines with ``size``, the number of shingles, and ``bands`` in place of ``norm``."""
    keep = [c for c in lines.columns if c != "norm"]
    cuts = [(g << 60) - (1 << 63) for g in range(POINTS)]
    sets = lines.select(*keep, "norm", F.sort_array(shingles(F.col("norm"))).alias("set"))
    # where the first hash beyond each point lies, found among the hashes with the points put in
    cut = sets.select(*keep, "norm", "set", F.size("set").alias("size"), F.when(F.size("set") >= similarity * SHORT, F.sort_array(F.concat("set", F.array(*map(F.lit, cuts))))).alias("cut"))
    places = F.array(*[F.array_position("cut", F.lit(c)).cast("int") - g for g, c in enumerate(cuts)])
    ring = cut.select(*keep, "norm", "size", F.concat("set", F.slice("set", 1, max(WIDE))).alias("ring"), F.when(F.col("cut").isNotNull(), places).alias("places"))
    sig = _let(signature(F.col("norm")), lambda sig: F.array(*[F.xxhash64(F.lit(p * 4 + g), *[F.shiftright(sig[c], 32).cast("int") for c in cells])
                                                              for p, groups in enumerate(GROUPS) for g, cells in enumerate(groups)]))

    def beyond(r: int) -> Column:
        return F.transform("places", lambda p, g: F.xxhash64(F.lit(r << 8) + g, F.slice("ring", p, r)))

    none, n = F.array().cast("array<bigint>"), F.col("size")
    kinds = [F.when(n < SHORT, sig), F.when((n >= similarity * SHORT) & (n < LONG), beyond(WIDE[0])), F.when(n >= similarity * LONG, beyond(WIDE[1]))]
    return ring.select(*keep, "size", F.concat(*[k.otherwise(none) for k in kinds]).alias("bands"))


def split_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, at, norm): the lines of every document that are not blank; th is a hash of the whole text."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    lines = rows.select("key", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.select("key", "th", "at", F.lower(F.trim("line")).alias("norm")).where(F.col("norm").rlike(r"\S"))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose lines are similar enough; the sizes of their sets are compared before texts move."""
    sizes = texts.select("id", "size")
    sized = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    sized = sized.where(F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - F.lit(1e-6))
    both = sized.join(texts.select("id", "t").toDF("a", "ta"), "a").join(texts.select("id", "t").toDF("b", "tb"), "b")
    common = F.size(F.array_intersect(hashes(F.col("ta")), hashes(F.col("tb"))))  # which has no repeats
    sets = both.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), common.alias("common"))
    return sets.where(F.col("common") >= F.lit(similarity) * (F.col("n") - F.col("common")) - F.lit(1e-9)).select("a", "b")


def _alike(a: str, b: str, similarity: float) -> Column:
    """Whether two bounds leave a pair possible: the sizes of the sets, and the parities that differ."""
    x, y = F.col(f"{a}size"), F.col(f"{b}size")
    differ = sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in BITS), F.lit(0))
    return (F.least(x, y) >= F.lit(similarity) * F.greatest(x, y) - F.lit(1e-6)) & (differ <= F.lit((1 - similarity) / (1 + similarity)) * (x + y) + F.lit(1e-6))


def line_classes(docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Two tables: (key, th, at, h1, h2) of all lines, and (h1, h2, key0, th0, at0), for each line text that is
    not alone the line that stays."""
    lines = split_lines(docs, key, text)
    lines = lines.select("key", "th", "at", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), "norm")
    low = F.struct(F.col("key").isNull().alias("unknown"), "key", "at", "th")
    once = signed(lines, similarity).groupBy("h1", "h2").agg(F.min(low).alias("low"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    once = stored(once.withColumn("id", F.monotonically_increasing_id()), "lines")
    bands = once.select("id", F.explode("bands").alias("band"))
    w = Window.partitionBy("band")
    members = bands.select("band", "id", F.count(F.lit(1)).over(w).alias("n"), F.lag("id").over(w.orderBy("id")).alias("prev"), F.min("id").over(w).alias("lo"))
    members = stored(members.where("n > 1"), "members")
    near = members.where("id > lo").select(F.explode(F.array("lo", "prev")).alias("a"), F.col("id").alias("b"))
    near = stored(near.distinct(), "pairs")
    # the texts of candidate lines, found again where they first occur
    wanted = once.join(members.select("id").distinct(), "id", "left_semi").select("id", "size", "low.*")
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    per_doc = wanted.groupBy("key", "th").agg(F.collect_list(F.struct("id", "at", "size")).alias("want"))
    found = rows.join(per_doc, (F.col("k").eqNullSafe(F.col("key"))) & (F.col("h") == F.col("th"))).select(F.split("text", "\n").alias("ls"), F.explode("want").alias("w"))
    texts = stored(found.select("w.id", "w.size", F.lower(F.trim(F.get("ls", "w.at"))).alias("t")).dropDuplicates(["id"]), "texts")
    links = stored(_verified(near, texts, similarity), "links")
    comp = stored(components(links, "a", "b"), "classes")
    # pairs of a bucket that are still apart
    placed = members.select("band", "id").join(comp, members.id == comp.node, "left").select("band", "id", F.coalesce("component", "id").alias("c"))
    counts = placed.groupBy("band", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count(F.lit(1)).alias("kinds"))
    open_ = stored(placed.join(counts.where("kinds > 1"), "band"), "open")
    prints = texts.join(open_.select("id").distinct(), "id", "left_semi").select("id", parities(F.col("t")).alias("f")).select("id", "f.*")
    open_ = stored(open_.join(prints, "id"), "open")
    minor = open_.where("c <> main").select("band", *[F.col(x).alias(f"o{x}") for x in ("id", "c", "size", *BITS)])
    alike = _alike("o", "", similarity)
    rest = minor.join(open_, "band").where((F.col("c") != F.col("oc")) & ((F.col("c") == F.col("main")) | (F.col("oid") < F.col("id"))) & alike)
    rest = rest.select(F.least("oid", "id").alias("a"), F.greatest("oid", "id").alias("b")).distinct().join(near, ["a", "b"], "left_anti")
    more = stored(_verified(rest, texts, similarity), "links")
    comp = stored(components(links.unionAll(more), "a", "b"), "classes")
    least = comp.join(once.select("id", "low"), comp.node == F.col("id")).groupBy("component").agg(F.min("low").alias("low0"))
    kept = once.join(comp.join(least, "component").select(F.col("node").alias("id"), "low0"), "id", "left")
    # a line that occurs once and is like no other stays
    kept = kept.where((F.col("copies") > 1) | F.col("low0").isNotNull()).select("h1", "h2", F.coalesce("low0", "low").alias("low"))
    kept = kept.select("h1", "h2", F.col("low.key").alias("key0"), F.col("low.th").alias("th0"), F.col("low.at").alias("at0"))
    return lines.select("key", "th", "at", "h1", "h2"), kept


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry…, text, n_lines, n_removed): every document with the lines that stay."""
    lines, kept = line_classes(docs, key, text, similarity)
    gone = lines.join(kept, ["h1", "h2"]).where(~(F.col("key").eqNullSafe(F.col("key0")) & (F.col("th") == F.col("th0")) & (F.col("at") == F.col("at0"))))
    gone = stored(gone.select("key", "th", "at").distinct().groupBy("key", "th").agg(F.collect_list("at").alias("gone")), "gone")
    rows = docs.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in carry], F.col(text).cast("string").alias("__text"))
    both = rows.join(gone, F.col("__k").eqNullSafe(F.col("key")) & (F.xxhash64("__text") == F.col("th")), "left")
    out = F.when(F.col("gone").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(F.array(F.split("__text", "\n")), lambda ls: F.filter(
        ls, lambda x, i: ~F.array_contains("gone", i)))[0], "\n"))
    blank = F.when(F.col("__text").isNull(), 0).otherwise(F.size(F.split("__text", "\n")))
    return both.select(F.col("__k").alias(key), *[F.col(f"__{c}").alias(c) for c in carry], out.alias(text), blank.cast("long").alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
