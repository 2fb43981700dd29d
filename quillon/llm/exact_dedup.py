"""Exact deduplication, safe against skew, with DataFrame operations only.

Rows are equal when their texts are identical after the six white-space characters are deleted.
Copies are combined in three stages, each of which groups by the normalised text itself beside its
digest, so that two texts never meet because of a digest collision:

1. *local*: the map side of a grouping by (digest, salt, text) combines the copies in one input split;
2. *salted*: its reduce side merges them per salt, so a text held by a third of all rows is spread
   over ``salts`` tasks;
3. *global*: at most ``salts`` winners per text meet by digest and yield the class.

Decisions go back to the rows by digest. Classes of a size that at most ``HOT`` classes can have, whatever the data, are
broadcast, so the rows of a text held by a third of all rows are not gathered; the others are joined. Of repeated rows
(same id, same text) the first of the written table is found by a grouping that the map side combines; no task numbers
them. Only if two different texts do share a digest are the rows of those digests joined by text as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACES, quoted, table

#: An id's place among the longest: ids are shifted into [0, 2^64), null ids come after all others.
_NULL_ORDER = "18446744073709551616"
_SHIFT = "9223372036854775808"
_MAX_LENGTH = 2**31
#: At most so many classes are broadcast: those with more than a HOT-th part of all rows each.
HOT = 50_000


def normalised(text: Column) -> Column:
    """``text`` without white space; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _order(text: Column, doc_id: Column) -> Column:
    """A number that is smaller for a text of more code points, then for a smaller id."""
    length = F.coalesce(F.length(text), F.lit(0))
    by_id = F.coalesce(doc_id.cast("decimal(20,0)") + F.lit(_SHIFT).cast("decimal(20,0)"), F.lit(_NULL_ORDER).cast("decimal(21,0)"))
    return ((F.lit(_MAX_LENGTH) - length).cast("decimal(10,0)") * F.lit("36893488147419103232").cast("decimal(20,0)") + by_id).cast("decimal(38,0)")


def _id_of(order: Column) -> Column:
    by_id = order % F.lit("36893488147419103232").cast("decimal(38,0)")
    return F.when(by_id < F.lit(_NULL_ORDER).cast("decimal(38,0)"), (by_id - F.lit(_SHIFT).cast("decimal(38,0)")).cast("long"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int, digest_bits: int) -> DataFrame:
    """The whole row as __row, so that no column of it can clash with ours."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("__row"), normalised(text).alias("__norm"), doc_id.alias("__id"), _order(text, doc_id).alias("__order"))
    return rows.withColumns({"__sha": F.sha2(F.col("__norm"), 256), "__salt": F.pmod(F.xxhash64("__id", "__norm"), F.lit(salts)).cast("int")}).withColumn("__digest", F.substring("__sha", 1, digest_bits // 4))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest_bits: int = 256) -> DataFrame:
    """One row per distinct normalised text: digest, best (the order of the row that stays), keep_id, group_size, the number
    of texts under its digest and, only if that is over one, the text. Written to the shared folder."""
    rows = _keyed(docs, id_col, text_col, salts, digest_bits).select("__digest", "__salt", "__norm", "__order")
    salted = rows.groupBy("__digest", "__salt", "__norm").agg(F.count(F.lit(1)).alias("n"), F.min("__order").alias("best"))
    merged = (
        salted.repartition("__digest")
        .groupBy("__digest", "__norm")
        .agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
        .withColumn("texts", F.count(F.lit(1)).over(W.partitionBy("__digest")))
    )
    return table(merged.select("__digest", "best", _id_of(F.col("best")).alias("keep_id"), "group_size", "texts", F.when(F.col("texts") > 1, F.col("__norm")).alias("__text")), "dedup-classes")


def _firsts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the first place of rows that occur more than once under them; each task combines its own rows first."""
    return rows.groupBy(*keys).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest_bits: int = 256, hot: int = HOT) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    The row with the most code points in the original text stays, then the smallest id. Null and empty
    texts form one class with those of white space only. Null ids come last; a class of null ids only has a
    null keep_id. Of repeated rows (same id, text of same length) one is kept; an empty table gives no row. Ids are integers.
    Other columns are ignored. ``salts`` bounds the rows a text has in the global stage, ``hot`` the classes that are
    broadcast; ``digest_bits`` exists to test collisions."""
    found = classes(docs, id_col, text_col, salts, digest_bits)
    rows = _keyed(docs, id_col, text_col, salts, digest_bits)
    every = found.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    # a place is given once, when the rows are written
    written = table(rows.select("__id", "__sha", "__order", F.monotonically_increasing_id().alias("__place")), "dedup-rows").withColumn("__digest", F.substring("__sha", 1, digest_bits // 4))
    plain = found.filter("texts = 1").select("__digest", "best", "keep_id", "group_size", F.lit(None).cast("long").alias("__first"))
    if not written.groupBy("__id").count().filter("count > 1").isEmpty():  # without repeated ids there are no repeated rows
        firsts = _firsts(written, ["__digest", "__order"]).withColumnRenamed("__order", "best")
        plain = plain.drop("__first").join(firsts, ["__digest", "best"], "left")
    plain = plain.select("__digest", "group_size", F.struct("best", "keep_id", "group_size", "__first").alias("__class"))
    large = F.col("group_size") > every / hot  # true for fewer than `hot` classes
    met = written.join(F.broadcast(plain.filter(large).select("__digest", F.col("__class").alias("__hot"))), "__digest", "left")
    met = met.withColumn("__key", F.when(F.col("__hot").isNotNull(), F.concat("__digest", F.lit("-"), F.pmod("__place", F.lit(65536)).cast("string"))).otherwise(F.col("__digest")))
    rest = plain.filter(~large).select(F.col("__digest").alias("__key"), F.col("__class").alias("__rest"))
    out = met.join(rest, "__key", "left").withColumn("__class", F.coalesce("__hot", "__rest")).filter("__class IS NOT NULL").select("__id", "__sha", "__order", "__place", "__class.*")
    clash = found.filter("texts > 1")
    if not clash.isEmpty():
        same = clash.select("__digest", F.col("__text").alias("__norm"), "best", "keep_id", "group_size")
        met = table(rows.join(same, ["__digest", "__norm"]).select("__id", "__sha", "__order", "__digest", "__norm", "best", "keep_id", "group_size", F.monotonically_increasing_id().alias("__place")), "dedup-clashes")
        firsts = met.filter(F.col("__order") == F.col("best")).groupBy("__digest", "__norm").agg(F.min("__place").alias("__place"))
        met = met.join(firsts.select("__place", F.col("__place").alias("__first")), "__place", "left").withColumn("__first", F.coalesce("__first", F.lit(-1)))
        out = out.unionByName(met.select("__id", "__sha", "__order", "__place", "best", "keep_id", "group_size", "__first"))
    return out.select(
        F.col("__id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("__order") == F.col("best")) & (F.col("__place") == F.coalesce("__first", "__place"))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest_bits: int = 256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Same rules as :func:`decide`. Repeated rows are combined where
    they are read, before any shuffle."""
    found = classes(docs, id_col, text_col, salts, digest_bits)
    keys = ["__digest", "__order"] if found.filter("texts > 1").isEmpty() else ["__digest", "__order", "__norm"]
    rows = _keyed(docs, id_col, text_col, salts, digest_bits).groupBy(*keys).agg(F.first("__row").alias("__row"))
    joined = rows.join(found.select("__digest", F.col("best").alias("__order"), "__text"), ["__digest", "__order"])
    return (joined.filter(F.col("__text").isNull() | (F.col("__text") == F.col("__norm"))) if "__norm" in keys else joined).select("__row.*")
