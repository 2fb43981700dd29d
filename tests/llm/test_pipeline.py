from __future__ import annotations

import re

import corpus_pipeline
from quillon.llm import golay_simhash, mil_quality, pieces
from quillon.llm.common import table

from .helpers import awkward, empty
from .test_golay_simhash import brute_print

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = table(stage(spark, docs, SF), "stage")
        rows = docs.collect()
        sizes.append(len(rows))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "quality classifier":
            scores = {r["doc_id"]: r["__score"] for r in mil_quality.score(before, mil_quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
            assert {r["doc_id"] for r in rows} == {i for i, s in scores.items() if s >= mil_quality.THRESHOLD}
        elif name == "exact dedup":
            texts = ["".join(r["text"].split()) for r in rows]
            assert len(texts) == len(set(texts)) == len({"".join(r["text"].split()) for r in before.collect()})
        elif name == "near dedup":
            prints = [brute_print(r["text"]) for r in rows]
            assert min((a ^ b).bit_count() for i, a in enumerate(prints) for b in prints[:i]) > 4
            assert len(rows) == golay_simhash.group(before).select("component_id").distinct().count()
        elif name == "mixing":
            count = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in df)
            assert abs(count(rows) / count(before.collect()) - 1) < 0.2
        else:
            ids = pieces.encode_texts([r["text"] for r in rows], pieces.Encoder(pieces.load()))
            assert [r["piece_ids"] for r in rows] == [x.tolist() for x in ids]
    assert sizes[1] < sizes[0]
    assert sizes[3] <= sizes[2] <= sizes[1]
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "mixing", "pieces"]


def test_awkward_and_empty_rows_pass_all_stages(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing names, then no rows at all."""


    for name, docs in (("awkward", awkward(spark)), ("empty", empty(spark))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        found = corpus_pipeline.run(spark, folder)
        assert found.columns == [*docs.columns, "piece_ids", "decoded_sha256"]
        rows = found.collect()
        assert len(rows) == 0 if name == "empty" else all(r["decoded_sha256"] for r in rows)
        for _, stage in corpus_pipeline.STAGES[1:4]:
            assert stage(spark, docs, folder).columns == docs.columns
