"""Commits as a whole, stale writers, replays, merges by bucket, appends and turns."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from larkspur.operators import index
from larkspur.sources import versions
from larkspur.sources.versions import StaleWriter, Store, append_once, batched
from larkspur.streaming import activity

CONTRACT = index.Contract("local", "m1", 2)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def files(store):
    return {n: sorted(store._names(f"data/{n}")) for n in store._names("data")}


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def test_empty_store_and_old_versions(spark, store):
    assert store.latest().version == -1
    with pytest.raises(KeyError):
        store.read("t")
    t = store.begin()
    t.put("t", spark.createDataFrame([(1, "a"), (2, None)], "id long, v string"), ("id",), 4)
    t.put("empty", spark.createDataFrame([], "id long"), ("id",), 4)
    assert store.latest().version == -1 and t.commit() == 0
    t = store.begin()
    assert t.merge("t", spark.createDataFrame([], "id long"), lambda old, new: old) == []
    t.merge("t", spark.createDataFrame([(3, "c")], "id long, v string"), lambda old, new: old.unionByName(new))
    assert t.commit() == 1
    assert rows(store.read("t")) == [(1, "a"), (2, None), (3, "c")] and rows(store.read("t", 0)) == [(1, "a"), (2, None)]
    assert store.read("empty").collect() == [] and store.read("t").columns == ["id", "v"]


def test_two_writers(spark, store):
    a, b = store.begin(), store.begin()
    for t, v in ((a, "a"), (b, "b")):
        t.put("t", spark.createDataFrame([(1, v)], "id long, v string"), ("id",), 4)
    a.commit()
    with pytest.raises(StaleWriter):
        b.commit()
    assert rows(store.read("t")) == [(1, "a")]
    # Who is refused can do the work again from the new version.
    assert batched(store, "b", 0, lambda t: t.merge("t", spark.createDataFrame([(2, "b")], "id long, v string"), lambda old, new: old.unionByName(new))) == 1
    assert rows(store.read("t")) == [(1, "a"), (2, "b")]
    assert len(store._names("data")) == 3 and store.clean() == 1 and rows(store.read("t")) == [(1, "a"), (2, "b")]


def test_of_many_writers_at_once_one_gets_the_number(store):
    won, lost = [], []

    def write(i):
        try:
            store._put(7, f'{{"tables": {{}}, "writers": {{"w": {i}}}}}')
            won.append(i)
        except StaleWriter:
            lost.append(i)

    store._fs.mkdirs(store._path(f"{store.root}/_commits"))
    threads = [threading.Thread(target=write, args=(i,)) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 11 and store.latest().writers == {"w": won[0]}
    assert store._names("_commits") == [f"{7:020d}.json"]


def test_merge_writes_in_proportion_to_the_batch(spark, store):
    t = store.begin()
    t.put("t", spark.range(10_000).select("id", F.lit(0).alias("v")), ("id",), 32)
    t.commit()
    before = dict(store.latest().tables["t"].parts)
    t = store.begin()
    touched = t.merge("t", spark.createDataFrame([(5,)], "id long"), lambda old, new: old.withColumn("v", F.when(F.col("id") == 5, 1).otherwise(F.col("v"))))
    t.commit()
    after = store.latest().tables["t"].parts
    assert len(touched) == 1 and [b for b in before if before[b] != after[b]] == [str(touched[0])]
    assert len(t.written) == 1 and [n for n in files(store)[t.written[0].split("/")[1]] if "=" in n] == [f"__bucket={touched[0]}"]
    assert store.read("t").agg(F.count("*"), F.sum("v")).first() == (10_000, 1)
    with pytest.raises(ValueError, match="without a change"):
        store.begin().merge("t", spark.createDataFrame([(5,)], "id long"), lambda old, new: spark.range(100).select("id", F.lit(0).alias("v")))


def account(kind, clerk, name, second, arrival=0):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)
    return (kind, clerk, name, "x", at, arrival)


EVENTS = "type string, clerk_id string, first_name string, last_name string, profile_at timestamp, arrival long"


def test_profile_stream_with_a_replay(spark, tmp_path):
    batches = [
        [account("user.created", "a", "A", 1), account("user.created", "b", "B", 1), account("user.deleted", "zz", None, 2), account("other", "q", "Q", 1)],
        [account("user.updated", "a", "A2", 5), account("user.updated", "a", "A1", 3), account("user.updated", "b", "old", 0), account("user.created", None, "?", 9)],
        [account("user.deleted", "a", None, 7), account("user.deleted", "a", None, 8), account("user.updated", "c", "C", 1)],
    ]
    root, sink = f"file://{tmp_path}/accounts", activity.profile_sink(f"file://{tmp_path}/accounts", buckets=8)
    for i, b in enumerate(batches):
        spark.createDataFrame(b, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        assert stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120), i
    expected = [("a", "A2", dt.datetime(2024, 1, 1, 0, 0, 7)), ("b", "B", None), ("c", "C", None)]
    store = Store(spark, root)
    assert rows(store.read("user_account"), "clerk_id", "first_name", "deleted_at") == expected
    version, written = store.latest().version, files(store)
    # A batch that comes again, or one before it, leaves no trace.
    for number in (2, 0):
        sink(spark.createDataFrame([account("user.updated", "a", "again", 99)], EVENTS), number)
    assert store.latest().version == version == 2 and files(store) == written


def test_append_once_with_refusals(spark, store):
    batch = spark.createDataFrame([(1, "m", 5), (2, None, 5), (3, None, -1), (None, "m", 1)], "id long, assistant_message_id string, tokens int")
    refuse = {"no assistant_message_id": F.col("assistant_message_id").isNull(), "negative tokens": F.col("tokens") < 0, "no id": F.col("id").isNull()}
    assert append_once(store, "costs", batch, "job", 0, refuse) == 0
    assert append_once(store, "costs", batch, "job", 0, refuse) == 0 and append_once(store, "costs", batch, "other", 0) == 1
    assert append_once(store, "costs", batch.limit(0), "job", 1, refuse) == 2
    assert rows(store.read("costs", 0)) == [(1, "m", 5)] and len(rows(store.read("costs"))) == 5
    assert rows(store.read("costs_refused"), "id", "reason") == [(2, "no assistant_message_id"), (3, "no assistant_message_id"), (None, "no id")]


def test_parts_are_joined_after_many_appends(spark, store, monkeypatch):
    monkeypatch.setattr(versions, "MOST_PARTS", 3)
    for i in range(6):
        append_once(store, "t", spark.range(i, i + 1), "w", i)
        assert len(store.latest().tables["t"].parts) <= 3
    assert rows(store.read("t")) == [(i,) for i in range(6)]


DOCUMENTS = "id string, source_type string, source_path string, title string, course_name string, content_hash string"
CHUNKS = "document_id string, chunk_id string, chunk_index int, content string"
VECTORS = "chunk_id string, embedding array<float>, provider string, model string, dimensions int"


def an_index(spark, names, mark="x", vectors=None):
    documents = spark.createDataFrame([(n, "repo", f"{n}.md", f"{n}{mark}", None, mark) for n in names], DOCUMENTS)
    chunks = [(n, f"{n}{mark}{i}", i, f"{mark}{i}") for n in names for i in range(3)]
    return documents, spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame([(c[1], [1.0, float(c[2])], "local", "m1", 2) for c in chunks] if vectors is None else vectors, VECTORS)


def test_index_is_replaced_as_a_whole(spark, store):
    assert index.replace_index(store, *an_index(spark, "ab"), F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")), CONTRACT, 8) == 0
    documents, chunks, vectors = an_index(spark, "bc", "y")
    # The second half fails while it is written: chunks are there by then.
    broken = vectors.withColumn("embedding", F.when(F.col("chunk_id") == "cy2", F.raise_error(F.lit("lost")).cast("array<float>")).otherwise(F.col("embedding")))
    with pytest.raises(Exception, match="lost"):
        t = store.begin()
        t.merge("chunks", chunks, lambda old, new: old.unionByName(new))
        t.put("embeddings", broken.withColumn("document_id", F.lit("c")), ("document_id",), 8)
        t.commit()
    assert store.latest().version == 0 and len(rows(store.read("chunks"))) == 6
    with pytest.raises(Exception, match="lost"):
        index.replace_index(store, documents, chunks, broken, F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")), CONTRACT)
    assert store.latest().version == 0

    assert index.replace_index(store, documents, chunks, vectors, F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")), CONTRACT) == 1
    assert rows(store.read("documents"), "id", "title") == [("a", "ax"), ("b", "by"), ("c", "cy")]
    assert rows(store.read("chunks"), "chunk_id") == [(f"{d}{i}",) for d in ("ax", "by", "cy") for i in range(3)]
    assert rows(store.read("embeddings"), "chunk_id") == rows(store.read("chunks"), "chunk_id")
    # Whoever has read version 0 is too late.
    with pytest.raises(StaleWriter):
        index.replace_index(store, *an_index(spark, "a", "z"), F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")), CONTRACT, version=0)
    # A document under a new id keeps its stored one; without chunks it loses them.
    renamed = documents.where("id = 'b'").withColumn("id", F.lit("new"))
    index.replace_index(store, renamed, chunks.limit(0), vectors.limit(0), F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")), CONTRACT)
    assert rows(store.read("chunks"), "document_id") == [("a",)] * 3 + [("c",)] * 3
    assert rows(store.read("documents"), "id") == [("a",), ("b",), ("c",)]


def test_invalid_indexes_are_refused(spark, store):
    documents, chunks, vectors = an_index(spark, "ab")
    odd = spark.createDataFrame([("a", None, 7, ""), ("a", "ax1", 8, ""), ("b", "bx9", 0, "")], CHUNKS)
    more = spark.createDataFrame([("ax0", [1.0, 2.0], "local", "m1", 2), ("q", [1.0, 2.0], "local", "m1", 2), ("bx9", [1.0], "local", "m1", 2), ("bx9", None, "local", None, 2)], VECTORS)
    got = rows(index.violations(chunks.unionByName(odd), vectors.where("chunk_id <> 'ax2'").unionByName(more), CONTRACT))
    expected = [("a", "chunk without id", 1), ("a", "chunk id repeated", 1), ("b", "chunk index repeated", 1), ("a", "chunk without embedding", 1), ("a", "more than one embedding", 1), ("b", "more than one embedding", 1), (None, "embedding without chunk", 1), ("b", "embedding breaks the contract", 2)]
    assert got == sorted(expected, key=repr)
    assert rows(index.violations(chunks, vectors, CONTRACT)) == []
    with pytest.raises(index.InvalidIndex, match="chunk without embedding"):
        index.replace_index(store, documents, chunks, vectors.limit(3), F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")), CONTRACT)
    with pytest.raises(index.InvalidIndex, match="not replaced"):
        index.replace_index(store, documents.where("id = 'a'"), chunks, vectors, F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")), CONTRACT)
    assert store.latest().version == -1 and store._names("data") == []


MESSAGES = "conv_id long, sequence long, role string, status string, content string"
TURNS = "conv_id long, arrival long, content string, base_sequence long"


def test_turns_conflict(spark, store):
    t = store.begin()
    t.put("messages", spark.createDataFrame([(1, 1, "user", "completed", "q"), (1, 2, "assistant", "completed", "a")], MESSAGES), ("conv_id",), 8)
    t.put("conflicts", spark.createDataFrame([], TURNS + ", error string, current_sequence long"))
    t.commit()
    first = spark.createDataFrame([(1, 10, "x", 2), (1, 11, "late", 2), (2, 5, "new", 0), (3, 6, "odd", 4), (1, 9, "stale", 0), (1, 8, "none", None)], TURNS)
    index.write_turns(store, first, "api", 0)
    # The second batch saw the conversation as it was before the first.
    second = spark.createDataFrame([(1, 12, "too late", 2), (2, 13, "fine", 2)], TURNS)
    index.write_turns(store, second, "api", 1)
    index.write_turns(store, second, "api", 1)
    got = rows(store.read("messages").where("sequence > 2 or conv_id > 1"), "conv_id", "sequence", "content")
    assert got == [(1, 3, "x"), (1, 4, ""), (2, 1, "new"), (2, 2, ""), (2, 3, "fine"), (2, 4, "")]
    lost = rows(store.read("conflicts"), "conv_id", "content", "error", "current_sequence")
    assert lost == sorted([(1, c, index.CONFLICT, 4) for c in ("late", "stale", "none", "too late")] + [(3, "odd", index.CONFLICT, 0)])
