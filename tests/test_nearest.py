"""The blocked cosine search against plain Python."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.operators import nearest, search


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or any(x is None or not math.isfinite(x) for x in (*a, *b)):
        return None
    size = math.sqrt(math.fsum(x * x for x in a)) * math.sqrt(math.fsum(x * x for x in b))
    return math.fsum(x * y for x, y in zip(a, b, strict=True)) / size if size else None


def brute(chunks, queries, k):
    out, first = [], {}
    for i, v in queries:
        key = (v is None, [(x is None, x or 0.0) for x in v or []])
        if i not in first or key < first[i][0]:
            first[i] = (key, v)
    for q, (_, v) in first.items():
        found = []
        for c, x in chunks:
            s = cosine(v, x)
            # Equal vectors differ by rounding at most here; the ids must decide.
            found.append((s is None, round(1 - s, 9) if s is not None else 0, c is None, c if c is not None else 0, s))
        out += [(q, r, None if none else c, None if s is None else round(s, 9)) for r, (_, _, none, c, s) in enumerate(sorted(found, key=lambda f: f[:4])[:k], 1)]
    return sorted(out, key=repr)


def result(spark, chunks, queries, k, parts=3, kind="long", **more):
    df = spark.createDataFrame([(c, f"t{c}", v) for c, v in chunks], f"chunk_id {kind}, title string, embedding array<double>").repartition(parts)
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    rows = nearest.nearest(df, asked, k, **more).collect()
    assert all(r.title == f"t{r.chunk_id}" for r in rows if r.chunk_id is not None)
    assert all((r.distance is None) == (r.similarity is None) for r in rows)
    return sorted(((r.query_id, r["rank"], r.chunk_id, None if r.similarity is None else round(r.similarity, 9)) for r in rows), key=repr)


def some(n, dims, seed):
    rng = random.Random(seed)
    return [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0, 2.0]) for _ in range(dims)]) for i in range(n)]


def test_ties_and_odd_vectors(spark):
    """Many equal and parallel vectors: ids decide, whichever task and slice they are in."""
    chunks = some(400, 3, 1) + [(None, [1.0, 0.5, 2.0]), (500, None), (501, [0.0] * 3), (502, [1.0]), (503, [1.0, None, 2.0]), (504, [math.nan] * 3), (505, [1e200] * 3), (7, [2.0] * 3)]
    queries = some(40, 3, 2) + [(50, None), (51, [0.0] * 3), (52, [1.0, 2.0]), (3, [-1.0, 0.5, 0.5])]
    for k in (1, 5):
        assert result(spark, chunks, queries, k) == brute([(c, None if v == [1e200] * 3 else v) for c, v in chunks], queries, k)


def test_fewer_chunks_than_k(spark):
    chunks = some(4, 3, 3) + [(9, None), (8, [0.0] * 3)]
    assert result(spark, chunks, some(3, 3, 4), 10) == brute(chunks, some(3, 3, 4), 10)
    assert result(spark, [], some(3, 3, 4), 10) == [] and result(spark, chunks, [], 10) == []


def test_blocks_of_queries_and_slices_of_chunks(spark, monkeypatch):
    chunks, queries = some(300, 4, 5), some(57, 4, 6)
    expected = brute(chunks, queries, 3)
    assert result(spark, chunks, queries, 3) == expected
    assert result(spark, chunks, queries, 3, query_bytes=400) == expected
    state = nearest.Nearest(*nearest.unit_rows(pa.array([v for _, v in queries]), 4), 3)
    monkeypatch.setattr(nearest, "PRODUCT_BYTES", 57 * 8 * 7)  # seven chunks at once
    state.add(pa.record_batch([pa.array([c for c, _ in chunks])], names=["chunk_id"]), pa.array([v for _, v in chunks]), "chunk_id")
    (found,) = state.found(pa.array([q for q, _ in queries]))
    assert sorted(zip(*(found[c].to_pylist() for c in ("query_id", "chunk_id")), strict=True)) == sorted((q, c) for q, _, c, _ in expected)


def test_heap_holds_k_rows_a_query():
    """However many chunks a task reads."""
    rng = random.Random(7)
    queries = nearest.unit_rows(pa.array([[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]), 8)
    state = nearest.Nearest(*queries, 5)
    for start in range(0, 20_000, 1000):
        state.add(pa.record_batch([pa.array(range(start, start + 1000))], names=["chunk_id"]), pa.array([[rng.gauss(0, 1) for _ in range(8)] for _ in range(1000)]), "chunk_id")
        assert len(state.query) == 100 and state.rows.num_rows <= 100


def test_ids_of_text(spark):
    chunks = [(chr(0x61 + i % 26) + ("é" if i % 3 else "z"), [1.0, float(i % 2)]) for i in range(60)]
    expected = sorted(chunks, key=lambda c: (-cosine([1.0, 0.2], c[1]), c[0].encode()))[:20]
    got = nearest.nearest(spark.createDataFrame(chunks, "chunk_id string, embedding array<float>"), spark.createDataFrame([("q", [1.0, 0.2])], "query_id string, vector array<double>"), 20)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == [c for c, _ in expected]


def test_plan_shuffles_only_what_was_kept(spark):
    df = spark.createDataFrame(some(50, 3, 8), "chunk_id long, embedding array<double>")
    plan = nearest.nearest(df, df.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector")), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert plan.index("Exchange") < plan.index("MapInArrow")  # above it in the tree


def test_agrees_with_the_similarity_of_columns(spark):
    df = spark.createDataFrame(some(30, 5, 9), "chunk_id long, embedding array<double>")
    q = df.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = nearest.nearest(df, q, 30).join(df, "chunk_id").join(q, "query_id")
    for r in rows.withColumn("s", search.similarity(F.col("embedding"), F.col("vector"))).collect():
        assert r.s == pytest.approx(r.similarity, abs=1e-12)
