import numpy as np
import xxhash
from pyspark.sql import types as T

from larkspur.llm import simhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("root", T.StringType())])


def brute_print(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=3):
    fps = [brute_print(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    least = {}
    for (d, _), c in zip(rows, comp, strict=True):
        least[c] = min(least.get(c, d), d)
    return sorted((d, f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, comp, strict=True))


def result(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    return sorted((r.doc_id, r.fp.hex(), r.component_id) for r in simhash.near_duplicates(df, **more).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}é" for i in range(300)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(20)]
    rows = []
    for i in range(120):
        w = base[i % 20].split(" ")
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, len(w)))] = str(rng.choice(words))
        rows.append((1000 - i, "  ".join(w).upper() if i % 7 == 0 else " \n".join(w)))
    rows += [(1, None), (2, ""), (3, " \x0b "), (4, "one"), (5, "ONE"), (6, "a b"), (7, "a b c"), (8, "long " * 30000)]
    rows += [(7, "a b c")]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_blocks_lose_no_link():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, (700, 1), dtype=np.uint64)
    b = a[:400] ^ (np.uint64(1) << rng.integers(0, 64, (400, 1), dtype=np.uint64))
    b = np.concatenate([b, rng.integers(0, 2**63, (200, 1), dtype=np.uint64)])
    label = simhash.compare(a, b, 3, 3, False)
    assert (label[:400] == label[700:1100]).all()
    assert len(set(label.tolist())) == 700 + 200


def test_four_lanes_join_edited_texts_only(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    base = list(rng.choice(words, 400))
    near = list(base)
    near[200] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(rng.choice(words, 400)))]
    got = {d: c for d, _, c in result(spark, rows, shingle_words=5, radius=46, lanes=4, screen=18)}
    assert got == {1: 1, 2: 1, 3: 3}
