import zlib

from pyspark.sql import functions as F

from larkspur.llm import chat, sharding

ODD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<|nl|> a\nb <\\\\|x", "", None, "日本 é"]


def test_turns_come_back_and_the_mask_covers_assistant_texts(spark):
    rows = [(i % 3, i, "assistant" if i % 2 else "user", t, "clash") for i, t in enumerate(ODD * 2)] + [(None, 0, None, "x", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    made = chat.format_turns(chat.canonical_turns(df))
    got = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in got:
        own = [(x[2] or "", x[3] or "") for x in sorted(rows, key=lambda x: x[1]) if x[0] == r.conv_id]
        assert [tuple(t) for t in r.back] == own
        assert r.loss == "".join(t for role, t in own if role == "assistant")
    assert chat.format_turns(chat.canonical_turns(df.limit(0))).collect() == []


def test_json_layouts(spark):
    df = spark.createDataFrame([(1, '{"prompt":"a","response":"b"}'), (2, '{"messages":[{"role":"user","content":"x"}]}'), (3, '{"z":1}'), (4, None)], "id long, record string")
    got = {r.id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical_turns_json(df).collect()}
    assert got == {1: ("prompt_response", [("user", "a"), ("assistant", "b")]), 2: ("messages", [("user", "x")]), 3: (None, None), 4: (None, None)}


def test_shards(spark):
    rows = [(i, None if i == 5 else f"é{i}", "c", "c") for i in range(4000)] + [(None, "n", "c", "c"), (7, "é7", "c", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string, shard string")
    got = sharding.assign(df).collect()
    slots: dict = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
        if r.doc_id is not None:
            t = "" if r.doc_id == 5 else f"é{r.doc_id}"
            assert (r["size"], r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
    assert len(got) == len(rows) and set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.5 * min(map(len, slots.values()))
    assert sharding.assign(df.limit(0)).collect() == []
    heavy = [r.shard for r in sharding.assign(df, weights=(3.0, 1.0)).collect()]
    assert 0.7 < heavy.count(0) / len(heavy) < 0.8


def test_shards_against_a_plain_argmax(spark):
    import math

    import xxhash

    def hashed(key, i):
        h = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        return xxhash.xxh64_intdigest(i.to_bytes(4, "little"), h)

    def best(key, weights):
        scores = [w / -math.log(((hashed(key, i) >> 12) + 0.5) * 2.0**-52) for i, w in enumerate(weights)]
        return max(range(len(scores)), key=lambda i: (scores[i], -i))

    rows = [(i * 37 - 50, f"t{i}") for i in range(300)] + [(None, None), (7, "x" * 2_000_000)]
    weights = [1.0, 2.5, 0.5, 1.0]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), weights=weights).collect()
    assert len(got) == len(rows)
    assert all((r.shard, r.grown_shard) == (best(r.doc_id, weights), best(r.doc_id, [*weights, 1.0])) for r in got)
    assert all(r.grown_shard in (r.shard, 4) for r in got)
