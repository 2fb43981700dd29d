"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Every source gets a target number of words. Among all document rates r that meet it, the ones closest to 1 in
relative entropy, with 0 <= r <= cap, are an exponential tilt of the document's size, r = min(cap, exp(t * size/mean)).
The multiplier t of each source solves a convex dual; Newton steps, kept inside a bracket, run over the
table of (source, size) counts, which is made once: a step is one grouped sum, whatever the number of documents.

Rates become whole copies by systematic rounding: within a source the sizes are walked from large to small, and the
running sum of fractional copies decides how many documents of each size get one copy more, which keeps the
sum within half the largest size; a second walk from small sizes up settles what is left. Documents of one size
are dealt to parts by a hash of the id and the text, as many as the number of rows asks for, so that no part grows with a hot
size. Repeated rows have one hash: where many do, they are dealt by their place in a table that they alone are written to.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_PATTERN, forget, kept_columns, quoted, table

CAP = 3
#: Parts of a (source, size): as many as all rows would need for so many rows each, and not fewer than LEAST_PARTS.
PART_ROWS, LEAST_PARTS = 250_000, 256
#: Hashes that more than a HOT-th part of all rows share: fewer than HOT, whatever the data.
HOT = 50_000
SOURCE = ["__none", "__source"]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, splits: int) -> DataFrame:
    """The whole row as __row, so that no column of it can clash with ours."""
    source, doc_id = F.col(source_col).cast("string"), F.col(id_col)
    out = docs.select(
        F.struct(*quoted(docs.columns)).alias("__row"), doc_id.alias("__id"), words(F.col(text_col)).alias("__size"), source.isNull().alias("__none"), F.coalesce(source, F.lit("")).alias("__source"), F.xxhash64(doc_id, F.col(text_col).cast("string")).alias("__hash")
    )
    return out.withColumn("__part", F.pmod(F.shiftright("__hash", 7), F.lit(splits)).cast("int"))


def _spread(rows: DataFrame, every: int, splits: int) -> DataFrame:
    """``rows`` with other parts for hashes that many rows share. A place is given once, when such rows are written."""
    often = rows.groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(1, every // HOT)).select("__hash")
    often = table(often, "mix-repeated")
    if often.isEmpty():
        return rows
    often = F.broadcast(often)  # fewer than HOT numbers
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(splits)).cast("int")
    written = table(rows.join(often, "__hash", "left_semi").withColumn("__part", place), "mix-repeated-rows")
    return rows.join(often, "__hash", "left_anti").unionByName(written)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """``sizes``: __none, __source, source_size. Adds target: all words shared by weight (given in turn, by code point,
    null last), at most ``cap`` times a source's size; what is above is shared again among the others by weight.

    Sorted by size over weight, the sources at their cap are a prefix, and the level of the rest follows from prefix sums."""
    rank = F.row_number().over(W.orderBy("__none", "__source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("__cap", F.lit(float(cap)) * F.col("source_size")).withColumn("__ratio", F.col("__cap") / F.col("weight"))
    before = W.orderBy("__ratio", "__none", "__source").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("__ratio", "__none", "__source").rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    found = ranked.withColumn("__level", level).withColumn("__open", F.col("__level") <= F.col("__ratio"))
    least = F.min(F.when(F.col("__open"), F.struct("__ratio", "__none", "__source", "__level"))).over(every)["__level"]
    return found.withColumn("__theta", least).withColumn("target", F.least(F.col("__cap"), F.coalesce(F.col("__theta") * F.col("weight"), F.col("__cap")))).select(*SOURCE, "source_size", "target")


def tilts(counts: DataFrame, wanted: DataFrame, cap: int = CAP, steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """``counts``: source keys, __size, n. ``wanted``: source keys, source_size, target. Returns wanted with mean size and
    the multiplier ``tilt`` (null where all documents stand at the cap)."""
    mean = counts.filter("__size > 0").groupBy(*SOURCE).agg((F.sum(F.col("__size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("__size").alias("least"))
    full = F.col("target") >= cap * F.col("source_size")
    state = wanted.join(mean, SOURCE, "left").select(
        *SOURCE, "source_size", "target", "mean",
        full.alias("full"),
        F.lit(0.0).alias("tilt"),
        F.when(F.col("target") <= F.col("source_size"), F.lit(None)).otherwise(F.lit(0.0)).cast("double").alias("low"),
        F.when(F.col("target") <= F.col("source_size"), F.lit(0.0)).otherwise(F.lit(math.log(cap)) * F.col("mean") / F.col("least")).alias("high"),
        (full | (F.col("target") == F.col("source_size"))).alias("done"),
    )
    state, before = table(state, "tilts"), None
    for _ in range(steps):
        if state.filter("NOT done").isEmpty():
            break
        if before is not None:
            forget(before)
        x = F.col("__size") / F.col("mean")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(math.log(cap))))
        moments = (
            counts.filter("__size > 0").join(state.filter("NOT done"), SOURCE)
            .groupBy(*SOURCE)
            .agg(F.sum(F.col("n") * x * rate).alias("got"), F.sum(F.when(F.col("tilt") * x < math.log(cap), F.col("n") * x * x * rate).otherwise(0.0)).alias("slope"))
        )
        both = state.join(moments, SOURCE, "left")
        goal = F.col("target") / F.col("mean")
        over = F.col("got") > goal
        both = both.withColumns({"low": F.when(F.col("done") | over, F.col("low")).otherwise(F.col("tilt")), "high": F.when(~F.col("done") & over, F.col("tilt")).otherwise(F.col("high"))})
        step = F.col("tilt") - (F.col("got") - goal) / F.col("slope")
        inside = (F.col("slope") > 0) & (F.col("low").isNull() | (step > F.col("low"))) & (step < F.col("high"))
        middle = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).otherwise((F.col("low") + F.col("high")) / 2)
        near = F.abs(F.col("got") - goal) <= tolerance * goal
        before = state
        state = table(
            both.select(
                *SOURCE, "source_size", "target", "mean", "full",
                F.when(F.col("done") | near, F.col("tilt")).when(inside, step).otherwise(middle).alias("tilt"),
                "low", "high", (F.col("done") | F.coalesce(near, F.lit(True))).alias("done"),
            ),
            "tilts",
        )
    else:
        if not state.filter("NOT done").isEmpty():
            raise RuntimeError(f"a source's multiplier did not settle in {steps} steps")
    return state.select(*SOURCE, "source_size", "target", "mean", F.when(~F.col("full"), F.col("tilt")).alias("tilt"))


def copy_counts(counts: DataFrame, solved: DataFrame, cap: int = CAP) -> DataFrame:
    """Per (source, size): n documents, ``base`` copies of each and ``extra`` of them with one copy more."""
    exponent = F.least(F.coalesce(F.col("tilt") * F.col("__size") / F.col("mean"), F.lit(math.log(cap))), F.lit(math.log(cap)))
    rate = F.when(F.col("tilt").isNull(), F.lit(float(cap))).when(exponent >= math.log(cap), F.lit(float(cap))).otherwise(F.exp(exponent))
    rated = counts.join(solved, SOURCE).withColumn("rate", F.when(F.col("__size") > 0, rate).otherwise(F.lit(1.0)))
    rated = rated.withColumn("base", F.floor("rate")).withColumn("part", F.col("n") * (F.col("rate") - F.col("base")))
    down = W.partitionBy(*SOURCE).orderBy(F.desc("__size"))
    so_far = F.sum("part").over(down.rowsBetween(W.unboundedPreceding, 0))
    until = F.coalesce(F.sum("part").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rounded = rated.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("n"), F.floor(so_far + 0.5) - F.floor(until + 0.5))))
    whole = W.partitionBy(*SOURCE)
    short = rounded.withColumn("gap", F.col("target") - F.sum(F.col("__size") * (F.col("n") * F.col("base") + F.col("extra"))).over(whole))
    spare = F.when(F.col("__size") == 0, 0).when(F.col("gap") > 0, F.when(F.col("base") < cap, F.col("n") - F.col("extra")).otherwise(0)).otherwise(F.col("extra"))
    up = W.partitionBy(*SOURCE).orderBy("__size")
    settled = short.withColumn("spare", spare).withColumn("before", F.coalesce(F.sum(F.col("spare") * F.col("__size")).over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    change = F.when(F.col("__size") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.col("spare"), F.floor((F.abs("gap") - F.col("before")) / F.col("__size")))))
    return settled.select(*SOURCE, "source_size", "target", "__size", "n", "base", (F.col("extra") + F.when(F.col("gap") > 0, change).otherwise(-change)).alias("extra"))


MADE = ["__size", "__source_size", "__target", "__copies"]


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with __size, __source_size, __target and __copies (0 to ``cap``), which replace columns of these names.

    A null text has size 0, a null source is a source of its own, the last one. Documents without words get one copy.
    Reruns agree: ties within one size go by a hash of the id and the text, then the id; repeated rows count each by itself, and which of
    them are taken more often goes by place. ``splits`` is the number of parts, which follows from the rows unless given. If there
    are no words at all, targets are 0. An empty table stays empty."""
    return _mixed(docs, **options).select(*[F.col("__row")[c].alias(c) for c in kept_columns(docs, MADE)], *MADE)


def _mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, splits: int | None = None) -> DataFrame:
    every = docs.count()
    splits = splits or max(LEAST_PARTS, math.ceil(every / PART_ROWS))
    rows = _spread(_keyed(docs, id_col, text_col, source_col, splits), every, splits)
    parts = table(rows.groupBy(*SOURCE, "__size", "__part").agg(F.count(F.lit(1)).alias("in_part")), "mix-parts")
    counts = table(parts.groupBy(*SOURCE, "__size").agg(F.sum("in_part").alias("n")), "mix-counts")
    wanted = table(targets(counts.groupBy(*SOURCE).agg(F.sum(F.col("__size") * F.col("n")).alias("source_size")), weights, cap), "mix-targets")
    solved = tilts(counts, wanted, cap)
    classes = copy_counts(counts, solved, cap)
    walk = W.partitionBy(*SOURCE, "__size").orderBy("__part")
    upto = F.sum("in_part").over(walk.rowsBetween(W.unboundedPreceding, 0))
    dealt = parts.withColumn("upto", upto).join(classes, [*SOURCE, "__size"])
    share = lambda x: F.floor(F.col("extra") * x / F.col("n"))
    dealt = dealt.withColumn("__more", share(F.col("upto")) - share(F.col("upto") - F.col("in_part")))
    keys = [*SOURCE, "__size", "__part"]
    dealt = dealt.select(*keys, F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("base").alias("__base"), "__more")
    place = F.row_number().over(W.partitionBy(*keys).orderBy("__hash", "__id"))
    out = rows.withColumn("__place", place).join(dealt, keys)
    return out.withColumn("__copies", (F.col("__base") + (F.col("__place") <= F.col("__more")).cast("long")).cast("long")).select("__row", *MADE)


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. Options and rules as for :func:`mix`."""
    mixed = _mixed(docs, **options)
    return mixed.select("__row", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).select("__row.*")
