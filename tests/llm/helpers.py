"""Small tables that every operator must bear."""

from __future__ import annotations

from contextlib import contextmanager

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row string, `Salt` int, `a.b c` string, __id string, media int, __ids int"


def awkward(spark, texts=None):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns whose names clash with ours."""
    texts = texts or ["the cat sat", "the cat sat", " the  cat sat ", "", None, " \t\n", "é ßx ▁ 日本", "x" * 5000, "word " * 3000, "The Cat sat"]
    rows = [(k, t, "en", f"s{k % 3}", 1, "r", 1, "q", "i", 2, 3) for k, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s0", 1, "r", 1, "q", "i", 2, 3), (0, texts[0], None, None, None, None, None, None, None, None, None), (None, "the cat sat", None, None, None, "r", None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@contextmanager
def largest_read(spark):
    """Yields a function: the most rows that one task has read from a shuffle of 16 partitions since."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm, none = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {(s.stageId(), s.attemptId()) for s in _items(store.stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList()))}
    before = stages()
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    usual = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)

    def found() -> int:
        tasks = (t for s in stages() - before for t in _items(store.taskList(*s, 100_000)))
        return max((t.taskMetrics().get().shuffleReadMetrics().recordsRead() for t in tasks if t.taskMetrics().isDefined()), default=0)

    try:
        yield found
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)


def _items(sequence):
    return [sequence.apply(k) for k in range(sequence.size())]
