import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import innerproduct, queries

SCHEMA = "vec_id long, embedding array<double>, id string, score long, number int"


def quantised(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    q = [math.floor(64 * x) for x in v]
    while q and q[-1] == 0:  # filled up with zeros
        q.pop()
    return tuple(q)


def brute(rows, k=20, every=20):
    rows = {(i, quantised(v)) for i, v in rows if quantised(v) is not None}
    out = []
    for qi, q in rows:
        if qi is not None and qi % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i is None, i or 0) for i, v in rows if i is None or i != qi)
            out += [(qi, r, None if none else i, -s) for r, (s, none, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def result(spark, rows, k=20, every=20, **more):
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in innerproduct.top_k(df, F.col("id") % every == 0, k=k, **more).collect()), key=repr)


def some_rows(n=700, dims=9, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * rng.lognormal(0, 1, (n, 1)) * np.linspace(2, 0.1, dims)
    rows = [(1000 - i, v) for i, v in enumerate(x.tolist())]
    rows += [(2000 + i, rows[i % 3][1]) for i in range(60)]  # ties beyond k
    rows += [(None, rows[0][1]), (None, [5.0] * dims), (3000, None), (3020, [1.0, None] + [0.0] * (dims - 2)), (3040, [math.nan] * dims), (3060, [math.inf] * dims)]
    rows += [(3080, []), (3100, [0.0] * dims), (3120, [1.0]), (3120, [2.0, 1.0]), (-40, [-3.0] * dims), rows[5], rows[40], rows[40]]
    return rows


def test_against_brute_force(spark):
    rows = some_rows()
    assert result(spark, rows) == brute(rows)


def test_small_blocks_and_many_cells(spark):
    rows = some_rows(300)
    assert result(spark, rows, block_rows=16, group_bytes=2000, query_bytes=200, head_bytes=1, sample_bytes=1) == brute(rows)


@pytest.mark.parametrize("dims", [1, 2, 33])
def test_few_and_many_components(spark, dims):
    rows = some_rows(120, max(dims, 2), seed=dims)[: 120 if dims > 1 else 0] or [(i, [float(i % 7) - 3]) for i in range(50)]
    assert result(spark, rows, k=3, every=5) == brute(rows, k=3, every=5)


def test_fewer_others_than_k_and_empty_tables(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, [1.0]), (3, [2.0])]) == []
    assert result(spark, [(20, [1.0, 2.0])]) == []
    rows = [(20, [1.0, 2.0]), (21, [1.0, 0.5]), (40, [0.0, 0.0])]
    assert result(spark, rows) == brute(rows)


def test_scores_beyond_doubles(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.integers(-(2**21), 2**21, 4) + 0.015625).tolist()) for i in range(60)] + [(100, [float(2**23)] * 4), (120, [float(2**23) + 1 / 64] * 4)]
    assert result(spark, rows, k=5) == brute(rows, k=5)
    with pytest.raises(Exception, match="too long"):
        result(spark, [(20, [1e30]), (1, [1.0])])


def test_bounds_drop_nothing_that_counts():
    """Pairs that the bounds let through hold all that reach the floor; most others are dropped."""
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(size=(2000, 32)) * np.linspace(60, 1, 32)).astype(np.int64)
    rotation = np.linalg.svd(x[:500].astype(float), full_matrices=True)[2].T
    stages = innerproduct.cuts(32)

    def block(m, first):
        ids = np.arange(first, first + len(m))
        return innerproduct.Block({"rows": len(m), "ids": ids.tobytes(), "unnamed": np.zeros(len(m), bool).tobytes(), "matrix": innerproduct.narrow(m).tobytes()}, rotation, stages)

    q, b = block(x[:200], 0), block(x[200:], 200)
    scores = x[:200] @ x[200:].T
    floors = np.sort(scores, axis=1)[:, -20]
    i, j = innerproduct.candidates(q, slice(0, 200), b, floors, stages)
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    assert set(zip(*(a.tolist() for a in np.nonzero(scores >= floors[:, None])), strict=True)) <= kept
    assert len(kept) < 0.2 * scores.size
    assert (innerproduct.exact(q, slice(0, 200), b, i, j) == scores[i, j]).all()


def test_query_equals_its_sql(spark):
    con, at = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"create view embeddings as select * from '{at}/embeddings.parquet'")
    df = queries.QUERIES["op12_exact_topk_search"](spark, at)
    rows = con.execute(queries.ORACLE_SQL["op12_exact_topk_search"])
    names = [c[0] for c in rows.description]
    assert sorted(names) == sorted(df.columns)
    got, expected = sorted(tuple(r[c] for c in names) for r in df.collect()), sorted(rows.fetchall())
    assert expected and got == expected
