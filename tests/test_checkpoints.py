from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import checkpoints as C


def test_a_prefix_ends_at_the_first_break(spark):
    rows = [(d, k, "contract", f"result {d} {k}") for d in range(9) for k in range(4)]
    made = C.sealed(spark.createDataFrame(rows, "document_id int, window_index int, contract_sha256 string, payload string")).cache()
    assert made.count() == 36 and made.select("chain_sha256").distinct().count() == 36
    d, k = F.col("document_id"), F.col("window_index")
    other = C.sealed(spark.createDataFrame([(7, j, "contract", f"result 7 {j}" if j else "another first") for j in range(4)], "document_id int, window_index int, contract_sha256 string, payload string"))
    stored = made.filter("NOT (document_id = 1 AND window_index = 2) AND document_id <> 8")  # a gap; none of document 8
    stored = stored.withColumn("payload", F.when((d == 2) & (k == 1), "tampered").otherwise(F.col("payload")))
    stored = stored.withColumn("payload_sha256", F.when((d == 3) & (k == 3), F.sha2(F.lit("x"), 256)).otherwise(F.col("payload_sha256")))
    stored = stored.withColumn("contract_sha256", F.when((d == 4) & (k >= 1), "changed").otherwise(F.col("contract_sha256")))
    stored = stored.unionByName(made.filter("document_id = 5 AND window_index = 1"))
    stored = stored.filter("NOT (document_id = 7 AND window_index > 0)").unionByName(other.filter("window_index > 0"))
    jobs = spark.createDataFrame([(j, "new" if j == 6 else "contract", 3 if j == 0 else 4) for j in range(9)], "document_id int, contract_sha256 string, windows int")
    got = {r["document_id"]: (r["complete"], r["problem"]) for r in C.restored(stored, jobs).collect()}
    assert got == {0: (3, C.UNKNOWN), 1: (2, C.GAP), 2: (1, C.PAYLOAD), 3: (3, C.PAYLOAD), 4: (1, C.CONTRACT), 5: (2, C.REPEATED), 6: (0, C.CONTRACT), 7: (1, C.CHAIN), 8: (0, None)}
    fine = {r["document_id"]: (r["complete"], r["problem"]) for r in C.restored(made, jobs.filter("document_id IN (1, 2)")).collect()}
    assert fine == {1: (4, None), 2: (4, None)}


def test_a_contract_is_its_fields(spark):
    row = spark.createDataFrame([(1, None)], "b int, a string")
    same, other = row.select(C.contract_digest("a", "b"), C.contract_digest("b", "a")).first()
    assert same == other
    assert row.select(C.contract_digest("b")).first()[0] != same
