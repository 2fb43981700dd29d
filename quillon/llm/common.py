"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a maximal run of characters outside [\x20\x09-\x0D] (fixed by the contract).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: The six characters that separate words.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def forget(df: DataFrame, folder: str = "") -> None:
    """Delete the files of a table that no later step reads; ``folder``: those in folders that end so."""
    spark = df.sparkSession
    for path in {f.rsplit("/part-", 1)[0] for f in df.inputFiles()}:
        if not path.endswith(folder):
            continue
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends, and a lost executor costs nothing.
    ``by`` names a column of few values whose rows go to folders of their own, so that a filter on it reads only those."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_sums(rows: DataFrame, keys: list[str], by: Column, sums: dict[str, tuple], salts: int = 32) -> DataFrame:
    """``rows`` with aggregates of their group. ``sums``: name to (aggregate of rows, function that merges such aggregates).

    A group is dealt to ``salts`` parts by a hash of ``by``, both when it is summed and when the sums come back, so that no
    task meets a whole group; only parts that exist get a row. Null keys form no group and are dropped."""
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    parts = rows.groupBy(*keys, "__part").agg(*[made.alias(name) for name, (made, _) in sums.items()])
    whole = parts.groupBy(*keys).agg(*[merge(name).alias(name) for name, (_, merge) in sums.items()], F.bit_or(F.expr("shiftleft(1L, __part)")).alias("__parts"))
    known = whole.select(*keys, *sums, F.expr(f"explode(filter(sequence(0, {salts - 1}), s -> getbit(__parts, s) = 1))").alias("__part"))
    return rows.join(known, [*keys, "__part"]).drop("__part")


def kept_columns(df: DataFrame, made: list[str]) -> list[str]:
    """Columns of ``df`` without those that an operator makes itself, which replace them."""
    return [c for c in df.columns if c.lower() not in {m.lower() for m in made}]


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their plain names, whatever signs these have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def _packed(task, name: str | None):
    """``task`` over batches of the packed columns and one more, which may be one of those packed."""

    def run(batches):
        pairs = batches if name is None else (pa.RecordBatch.from_arrays([b.column(0), b.column(0).field(name)], names=["kept", "last"]) for b in batches)
        yield from task(pairs)
        release_memory()

    return run


def map_packed(df: DataFrame, columns: list[str], source: str, kind: str, task, made: str) -> DataFrame:
    """``kept``, a struct of those columns of ``df``, and the columns ``made`` (names and types) that an Arrow task computes
    from the column ``source`` cast to ``kind``.

    The task sees the columns packed as one, whatever their names are, and the source; it returns the packed one first."""
    inside = source in columns and df.schema[source].dataType.simpleString() == kind
    kept = F.struct(*quoted(columns)).alias("kept")
    rows = df.select(kept) if inside else df.select(kept, quoted([source])[0].cast(kind).alias("last"))
    return rows.mapInArrow(_packed(task, source if inside else None), StructType(rows.schema.fields[:1] + StructType.fromDDL(made).fields))


def map_kept(df: DataFrame, columns: list[str], source: str, kind: str, task, made: str) -> DataFrame:
    """The same with the packed columns by themselves again."""
    return map_packed(df, columns, source, kind, task, made).select("kept.*", *StructType.fromDDL(made).names)


def release_memory() -> None:
    """Give back what a task has freed: workers are used again, and what they hold counts against the next task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def crc_mod(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus`` (null ids count as the empty text)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def in_batches(rows, sizes, limit: int):
    """Cut ``rows`` into lists whose summed ``sizes`` stay near ``limit``; a row over the limit stands alone."""
    held, held_size = [], 0
    for row, size in zip(rows, sizes, strict=True):
        if held and held_size + size > limit:
            yield held
            held, held_size = [], 0
        held.append(row)
        held_size += size
    if held:
        yield held
