"""Every registered query of the engine against its DuckDB SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from quillon.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    return round(value, 5) if isinstance(value, float) else value


def rows_of(rows, columns):
    return sorted([tuple(plain(r[c]) for c in columns) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    result = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in result.description]
    expected = [dict(zip(columns, r, strict=True)) for r in result.fetchall()]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.collect(), sorted(columns)) == rows_of(expected, sorted(columns))


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_whole_hybrid_search_reads_vectors_beyond_500(spark, tmp_path):
    """With 2,000 vectors, of which only those from 500 on resemble the query, chunks that have them come first."""
    (tmp_path / "t").mkdir()
    for name in TABLES:
        if name != "embeddings":
            os.symlink(f"{SF}/{name}.parquet", tmp_path / "t" / f"{name}.parquet")
    near = "IF(id = 0 OR id >= 500, 1.0, 0.0)"
    made = spark.range(2000).selectExpr("id AS vec_id", f"transform(sequence(1, 64), k -> CAST(IF(k = 1, {near}, 0.0) AS FLOAT)) AS embedding", "CAST(id % 10 AS INT) AS label")
    made.coalesce(1).write.parquet(str(tmp_path / "t" / "embeddings.parquet"))
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/t/{name}.parquet{'/*.parquet' if name == 'embeddings' else ''}'")
    for name in ("hybrid_rrf", "hybrid_rrf_timeline"):
        expected = con.execute(registry.ORACLES[name]).fetchall()
        columns = [c[0] for c in con.description]
        found = rows_of(registry.QUERIES[name](spark, str(tmp_path / "t")).collect(), sorted(columns))
        assert found == rows_of([dict(zip(columns, r, strict=True)) for r in expected], sorted(columns))
    sql = registry.ORACLES["hybrid_rrf"].split(" fused AS (")[0].rstrip().rstrip(",")
    first = con.execute(sql + " SELECT (document_id * 31 + chunk_no) % 2000 FROM sem JOIN chunks USING (chunk_id) ORDER BY semantic_rank LIMIT 1").fetchone()[0]
    assert first == 0 or first >= 500


def test_whole_file_names_are_not_cut(spark):
    names = [len(r["file_name"]) for r in registry.QUERIES["file_names"](spark, SF).collect()]
    assert max(names) > 25
