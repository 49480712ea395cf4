import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import phrases, queries

SCHEMA = "doc_id long, text string, lang string, a long, path array<long>, phrase string"


def brute(docs, least=30, most_words=4, top=2000, covered=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most_words + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        hidden = set()
        for p, a in found.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and 100 * a >= covered * counts[p[i:j]]:
                        hidden.add(p[i:j])
        rows = []
        for p, a in found.items():
            if p not in hidden:
                score, _, x, y = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), x, y))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def result(spark, docs, parts=5, **more):
    df = spark.createDataFrame([(i, t, lang, 1, [2], "x") for i, (t, lang) in enumerate(docs)], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in phrases.phrases(df, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def some_docs():
    rng = np.random.default_rng(5)
    pool = ["the", "of", "a", "New", "york", "né", "né", "x1", "q-r", "Ärger", "end"]
    weights = np.array([8, 6, 4, 3, 3, 2, 1, 1, 1, 1, 1]) / 31
    docs = []
    for i in range(150):
        w = list(rng.choice(pool, int(rng.integers(1, 200)), p=weights))
        glue = rng.choice([" ", "\t", "  ", ". ", ", ", "\n", " \x0b", "!"], len(w), p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])
        docs.append(("".join(x + g for x, g in zip(w, glue, strict=True)), [None, "", "en", "fr", "und"][i % 5]))
    docs += [(None, "en"), ("", "en"), (" . ,", "fr"), ("San Francisco bay area " * 40, "en"), ("one two three four five. " * 35, "fr"), ("again and " * 20000, "de")]
    return docs + docs[:7]


def test_against_brute_force(spark):
    docs = some_docs()
    expected = brute(docs)
    assert len(expected) > 100 and any(len(r[2].split(" ")) == 4 for r in expected)
    assert result(spark, docs) == expected


def test_many_small_shards_full_filters_and_rounds(spark):
    """Shards of a text or two, merged three at once; filters so small that everything passes lose nothing either."""
    docs = some_docs()[:60]
    assert result(spark, docs, parts=9, shard_bytes=700, fan=3, filter_bits=6, least=20) == brute(docs, least=20)


def test_depth_limit_is_free(spark):
    docs = some_docs()[:40]
    for most in (2, 3, 6):
        assert result(spark, docs, least=5, most_words=most, top=50) == brute(docs, least=5, most_words=most, top=50)


def test_empty_table(spark):
    assert result(spark, []) == []
    assert result(spark, [(None, None), ("", "en")]) == []


def test_arithmetic_beyond_64_bits(spark):
    a, left, right = 7_000_000_000_000_000, 9_000_000_000_000_000, 7_000_000_000_000_001
    row = spark.createDataFrame([(a, [left, a], [right, 2**62])], "a long, l array<long>, r array<long>")
    got = row.select(phrases.worst_cut(F.col("a"), F.col("l"), F.col("r"), 2_000_000).alias("c")).first()["c"]
    assert tuple(got) == min((2_000_000 * a // (x + y), k, x, y) for k, x, y in ((1, left, right), (2, a, 2**62)))


def test_equal_hashes_are_seen(spark, monkeypatch):
    """Two words of one hash in different shards end the merge, whatever their counts."""

    def trie(word):
        none = np.empty(0, np.uint64)
        return phrases.Trie([word], ["en"], np.array([5], np.uint64), np.array([3]), (none, none, np.empty(0, np.int64)), [])

    assert phrases.merge_tries([trie(b"x"), trie(b"x")]).counts.tolist() == [6]
    assert phrases.merge_tries([trie(b"x"), trie(b"y")]) is None
    assert phrases.merge_rows([trie(b"x").pack(), dict.fromkeys(phrases.PIECE)])["levels"] is None
    assert phrases.clash().to_pylist()[0]["depth"] == -1


def test_a_broken_trie_changes_the_result():
    """Pieces by prefix ranges, packed and read back, merge to the whole."""
    rng = np.random.default_rng(6)
    every = phrases.Filter([(i, b"\xff" * (1 << 3)) for i in range(8)], 3, 9)
    texts = [[" ".join(rng.choice(["a", "b", "c", "d"], 500)).encode()] for _ in range(6)]
    whole = phrases.trie_of(phrases.Words("en", [b"\n".join(t[0] for t in texts)], 1), every, every, 4)
    pieces = [dict(phrases.trie_of(phrases.Words("en", t, 1), every, every, 4).pieces(3)) for t in texts]
    paths = {}
    for bucket in range(8):
        merged = phrases.merge_tries([phrases.Trie.unpack(p[bucket].pack()) for p in pieces if bucket in p]) if any(bucket in p for p in pieces) else None
        for b in phrases.nodes(merged, 1) if merged else []:
            paths |= {tuple(r["path"]): (r["a"], r["lefts"]) for r in b.to_pylist()}
    expected = {tuple(r["path"]): (r["a"], r["lefts"]) for b in phrases.nodes(whole, 1) for r in b.to_pylist()}
    assert paths == expected and len(expected) == 1 + 4 + 16 + 64 + 256


def test_short_hashes_that_clash_are_made_anew(spark, monkeypatch):
    """With hashes of one byte about every second seed clashes; the result is right all the same."""
    docs = [(" ".join(f"v{i}" for i in range(19)), "en")] * 6
    narrow, seeds = phrases.trie_of, []

    def one_byte(found, words, pairs, most_words, width=8):
        return narrow(found, words, pairs, most_words, 1)

    nodes = phrases.frequent_nodes
    monkeypatch.setattr(phrases, "frequent_nodes", lambda *a: seeds.append(a[5]) or nodes(*a))
    monkeypatch.setattr(phrases, "trie_of", one_byte)
    df = spark.createDataFrame([(i, t, lang, 1, [2], "x") for i, (t, lang) in enumerate(docs)], SCHEMA)
    got = sorted(tuple(r) for r in phrases.phrases(df, least=5).collect())
    assert got == brute(docs, least=5) and len(seeds) >= 1


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for most in (0, 1, 255, 256, 2**16, 2**32 - 1, 2**32, 2**62):
        x = rng.integers(0, most + 1, 50)
        assert phrases.unpack_ints(phrases.pack_ints(x)).tolist() == x.tolist()
    keys = rng.integers(0, 2**63, 50).astype(np.uint64)
    for width in (1, 5, 8):
        mask = np.uint64((2**64 - 1) ^ ((1 << 64 - 8 * width) - 1))
        assert phrases.unpack_keys(phrases.pack_keys(keys & mask, width)).tolist() == (keys & mask).tolist()
    assert phrases.unpack_ints(phrases.pack_ints(np.empty(0, np.int64))).tolist() == [] and phrases.unpack_keys(phrases.pack_keys(np.empty(0, np.uint64), 5)).tolist() == []


def test_query_equals_its_sql(spark):
    con, at = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"create view documents as select * from '{at}/documents.parquet'")
    df = queries.QUERIES["op13_phrase_collocations"](spark, at)
    rows = con.execute(queries.ORACLE_SQL["op13_phrase_collocations"])
    names = [c[0] for c in rows.description]
    assert sorted(names) == sorted(df.columns)
    got, expected = sorted(tuple(r[c] for c in names) for r in df.collect()), sorted(rows.fetchall())
    assert expected and got == expected
