"""Embeddings by content, fingerprints of tables, and the index of visible text."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import audits, embedding, visible_search
from larkspur.operators.index import Contract
from larkspur.sources.versions import Store

CONTRACT = Contract("local", "m1", 2)
CHUNKS = "chunk_id long, content string, content_hash string"


def _embedders():
    """Made inside a function, so that they go to the tasks by value."""

    def embedder(texts):
        return [[float(len(t)), 1.0] for t in texts]

    def never(texts):
        raise AssertionError(f"asked for {texts}")

    return embedder, never


embedder, never = _embedders()


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def some_chunks(spark, n=300):
    df = spark.range(0, n, 1, 5).select(F.col("id").alias("chunk_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id") % 40)).alias("content"))
    return df.withColumn("content_hash", F.sha2("content", 256))


def test_a_second_run_embeds_nothing(spark, tmp_path):
    store, chunks = Store(spark, f"file://{tmp_path}/s"), some_chunks(spark)
    made = embedding.embed_into(store, chunks, embedder, CONTRACT, "ingest", 0, buckets=8)
    assert made.count() == 300 and {r.content: r.embedding[0] for r in made.collect()} == {r.content: len(r.content) for r in chunks.select("content").distinct().collect()}
    # Each different content has one vector.
    assert store.read("vectors").count() == chunks.select("content").distinct().count() == 41
    for run in (0, 1):
        again = embedding.embed_into(store, chunks, never, CONTRACT, "ingest", run, buckets=8)
        assert rows(again) == rows(made)
    # New contents and another contract are embedded.
    more = chunks.unionByName(spark.createDataFrame([(900, "new one", "h"), (901, None, "empty")], CHUNKS))
    assert {r.chunk_id: r.embedding[0] for r in embedding.embed_into(store, more, embedder, CONTRACT, "ingest", 2, buckets=8).where("chunk_id > 899").collect()} == {900: 7.0, 901: 0.0}
    assert store.read("vectors").count() == 43
    other = embedding.embed_into(store, chunks, lambda ts: [[9.0] * 3 for _ in ts], Contract("local", "m1", 3), "ingest", 3, buckets=8)
    assert other.select(F.size("embedding")).distinct().first()[0] == 3 and store.read("vectors").count() == 43 + 41


def test_bad_embedders_store_nothing(spark, tmp_path):
    store, chunks = Store(spark, f"file://{tmp_path}/s"), some_chunks(spark, 30)
    for bad in (lambda ts: [[1.0, 2.0]] * (len(ts) - 1), lambda ts: [[1.0]] * len(ts), lambda ts: [[1.0, float("nan")]] * len(ts)):
        with pytest.raises(Exception, match="another number or length|not finite"):
            embedding.embed_into(store, chunks, bad, CONTRACT, "ingest", 0)
    assert store.latest().version == -1
    assert embedding.embed_into(store, chunks.limit(0), never, CONTRACT, "ingest", 0).collect() == []


def test_batches_cross_the_borders_of_arrow(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(0, 100, 1, 1).select("id", F.col("id").cast("string").alias("content"))
        made = embedding.embedded(df, lambda ts: [[float(len(ts)), float(t)] for t in ts], 2, batch=16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.embedding for r in made] == [[16.0 if i < 96 else 4.0, float(i)] for i in range(100)]


def test_unequal_vectors_are_seen(spark):
    chunks = spark.createDataFrame([(1,), (2,), (3,), (None,)], "chunk_id long")
    vectors = spark.createDataFrame([(1, [1.0]), (2, None), (3, [1.0]), (3, [1.0]), (4, [1.0]), (None, [2.0])], "chunk_id long, embedding array<double>")
    assert rows(embedding.unequal(chunks, vectors)) == [(2, 1, 0), (3, 1, 2), (4, 0, 1)]


ROWS = "doc string, place int, hash string"


def test_two_swapped_rows_are_seen(spark):
    data = [(f"d{i // 5}", i % 5, f"h{i}") for i in range(200)] + [(None, 0, None), (None, None, "x")]
    a = spark.createDataFrame(data, ROWS)
    swapped = list(data)
    swapped[12], swapped[13] = ("d2", 2, "h13"), ("d2", 3, "h12")
    far = list(data)
    far[0], far[199] = ("d0", 0, "h199"), ("d39", 4, "h0")
    cases = {"again": (data[::-1], True, True), "swapped": (swapped, True, False), "far": (far, True, False), "twice": (data + data[:1], False, False), "null": (data[:-2] + [(None, 0, "x"), (None, None, None)], True, False), "less": (data[:-1], False, False)}
    for name, (rows_b, same_rows, same_order) in cases.items():
        b = spark.createDataFrame(rows_b, ROWS).repartition(3)
        got = audits.verdict(a, b, ["doc", "place"]).first()
        assert (got.rows_a, got.rows_b, got.same_rows, got.same_order) == (202, len(rows_b), same_rows, same_order), name
        left, right = list(data), list(rows_b)
        for r in list(left):
            if r in right:
                left.remove(r)
                right.remove(r)
        expected = sorted([(*r, "a") for r in left] + [(*r, "b") for r in right], key=repr)
        assert rows(audits.differences(a, b, ["doc", "place"]), "doc", "place", "hash", "side") == expected, name
    assert audits.compared(a, spark.createDataFrame(swapped, ROWS), ["doc", "place"]).where("not same_order").count() == 1
    empty = a.limit(0)
    assert tuple(audits.verdict(empty, empty, ["doc", "place"]).first()) == (0, 0, True, True, 0)


def test_each_table_is_read_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "a"))
    spark.range(10).write.parquet(str(tmp_path / "b"))
    plan = audits.verdict(*(spark.read.parquet(str(tmp_path / n)) for n in "ab"), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2


def test_index_of_visible_text(spark, tmp_path):
    texts = ["**The** end of `the` [Thing](http://the)", "", None, "a b", "Ünder THE the thethe", "aaaa", "x" * 5000 + " the", "no match", "no match"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    visible_search.build(df, f"file://{tmp_path}/i", ["id"])
    terms = ["the", " THE ", "aa", "", None, "ünder", "missing", "a b", "no match", "http", "aaa"]
    asked = spark.createDataFrame(list(enumerate(terms)), "term_id int, term string")
    shown = {0: "the end of the thing", 1: "", 2: "", 3: "a b", 4: "ünder the the thethe", 5: "aaaa", 6: "x" * 5000 + " the", 7: "no match", 8: "no match"}
    expected = []
    for t, term in enumerate(terms):
        term = (term or "").strip().lower()
        expected += [(t, i, v.count(term) if term else 0) for i, v in shown.items() if term in v]
    assert rows(visible_search.search(spark, f"file://{tmp_path}/i", asked)) == sorted(expected, key=repr)
    visible_search.build(df.limit(0), f"file://{tmp_path}/e", ["id"])
    assert visible_search.search(spark, f"file://{tmp_path}/e", asked).collect() == []
