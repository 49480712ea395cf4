import hashlib
import random
import re

import numpy as np
import pytest

from larkspur.llm import repeats, substrings, suffixes

DDL = "doc_id long, text string, shard string, keys string"


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "日本"]
    make = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared = [make(rng.randint(15, 60)) for _ in range(5)]
    base = make(150)
    rows = []
    for i in range(n):
        if i % 4 == 0:
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = make(rng.randint(0, 80))
            for _ in range(rng.randint(0, 2)):
                at = rng.randint(0, len(w))
                w[at:at] = rng.choice(shared)
        rows.append((i * 2, rng.choice([" ", "\n"]).join(w)))
    rows += [(1, None), (3, ""), (5, " \t\n"), (7, "ab" * 300), (9, "x " * 200), (11, "x " * 200), (13, "ab" * 301 + "c"), (15, "a" * 100), (17, "a" * 101), (19, "q" * 99), (21, "q" * 99), (23, " ".join(make(5000)))]
    rng.shuffle(rows)
    return rows


def brute(rows, window, split, join):
    """Windows are looked up in order of (doc_id, start)."""
    first, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        units = split(t or "")
        gone = [False] * len(units)
        for i in range(len(units) - window + 1):
            w = tuple(units[i : i + window])
            if w in first:
                gone[i : i + window] = [True] * window
            first.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(units), sum(gone), spans, hashlib.sha256(join(u for u, g in zip(units, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "c", "c") for d, t in rows], DDL)


@pytest.mark.parametrize("shard_bytes", [700, 1 << 20])
def test_words_against_brute_force(spark, shard_bytes):
    rows = corpus(1)
    got = sorted(tuple(r) for r in substrings.dedup(frame(spark, rows), shard_bytes=shard_bytes).collect())
    assert got == brute(rows, 20, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), lambda u: " ".join(u).encode())


@pytest.mark.parametrize("shard_bytes", [700, 1 << 20])
def test_bytes_against_brute_force(spark, shard_bytes):
    rows = corpus(2)
    got = sorted(tuple(r)[:5] for r in suffixes.dedup(frame(spark, rows), shard_bytes=shard_bytes, with_spans=True).collect())
    assert got == brute(rows, 100, lambda t: list(t.encode()), bytes)


@pytest.mark.parametrize("operator", [substrings, suffixes])
def test_repeated_rows_null_ids_and_empty_table(spark, operator):
    text = " ".join(f"word{i}" for i in range(60))
    got = sorted((str(r.doc_id), r.n_removed > 0) for r in operator.dedup(frame(spark, [(4, text), (None, text), (4, text)])).collect())
    assert got == [("4", True), ("4", True), ("None", False)]
    assert operator.dedup(frame(spark, [])).collect() == []


def test_kept_text_and_spans(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = frame(spark, [(1, text), (2, f"own {text} end")])
    assert {r.doc_id: r.kept_text for r in substrings.dedup(rows, with_text=True).collect()} == {1: text, 2: "own end"}
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in suffixes.dedup(rows, with_spans=True).collect()}
    assert spans == {1: [], 2: [(4, 4 + len(text))]}


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    for n, k, depth in ((1, 2, 5), (300, 2, 9), (2000, 3, 100), (500, 1, 100), (400, 250, 12)):
        t = rng.integers(0, k, n).astype(np.uint8)
        sa, rank = suffixes.suffix_array(t, depth)
        cut = [t.tobytes()[i : i + depth] for i in range(n)]
        assert [cut[i] for i in sa] == sorted(cut)
        assert all((cut[i] == cut[j]) == (rank[i] == rank[j]) for i, j in rng.integers(0, n, (200, 2)))
        full, _ = suffixes.suffix_array(t, n)
        prefixes = suffixes.common_prefixes(t.tobytes(), full, n)
        for p in range(1, n):
            a, b = t[full[p - 1] :].tobytes(), t[full[p] :].tobytes()
            c = int(prefixes[p])
            assert a[:c] == b[:c] and a[c : c + 1] != b[c : c + 1]


def test_seen_before():
    rng = np.random.default_rng(4)
    runs = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype("S16") for _ in range(9)]
    runs = [np.sort(r) for r in runs]
    seen: set[bytes] = set()
    for run, flags in zip(runs, repeats.seen_before(runs), strict=True):
        assert [x in seen for x in run.tolist()] == (flags > 0).tolist()
        seen |= set(run.tolist())
