import functools
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from pyspark.sql import types as T

from larkspur.llm import wavelet

FILE = P.path("byte_bpe_50k.json")
ODD = [None, "", " ", "don't I'VE  it's \n\n x", "é 1½ ² 333 <|endoftext|>y", "日本 👩‍👩‍👧", "a\x00b\x1c c　d", "zz " * 4000]


@functools.cache
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return t


def reference(text):
    return library().encode(text or "", add_special_tokens=False).ids + [2]


def test_access_count_and_find(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK_BYTES", 64)
    rng = np.random.default_rng(1)
    for n, bits in ((1, 1), (64, 3), (1000, 16), (777, 17), (9000, 6)):
        x = rng.integers(0, min(2**bits, 50), n)
        m = wavelet.WaveletMatrix(wavelet.build(np.array([7]), np.array([n]), x, bits))
        assert m.tokens().tolist() == x.tolist()
        assert [m.access(i) for i in range(n)] == x.tolist()
        for t in {*x.tolist(), 49, 1}:
            assert m.rank(t, n // 2) == int((x[: n // 2] == t).sum())
            assert m.occurrences(t) == np.flatnonzero(x == t).tolist()
        assert m.rank(1 << bits) == 0


def test_files_against_the_library(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("abé '1.\n<|>_", k=rng.randint(1, 80))) for _ in range(100)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("k", T.StringType())])
    rows = [(i * 3 - 5, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(random.sample(rows, len(rows)) + [(4, "again", "z"), (None, "none", "z"), (None, "", "z"), (-(2**63), "least", "z")], schema)
    manifest = wavelet.write_new(df, FILE, shard_bytes=2000)
    got = sorted(wavelet.checksums(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got][:4] == [None, None, -(2**63), -5] and len(got) == len(rows) + 4
    start, by = 0, {}
    for r in got:
        assert r.start == start
        start += r.n_tokens
        by.setdefault(r.doc_id, []).append(r)
    for d, t, _ in rows:
        ids = reference(t)
        want = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert want in [(r.n_tokens, r.ids_crc32) for r in by[d]], t
    back = {(r.doc_id, tuple(r.tokens)) for r in wavelet.read_documents(manifest).collect()}
    assert all((d, tuple(reference(t))) in back for d, t, _ in rows)


def test_empty_table(spark):
    manifest = wavelet.write_new(spark.createDataFrame([], "doc_id long, text string"), FILE)
    assert wavelet.checksums(manifest).collect() == []


def test_chunks_are_encoded_as_whole_texts():
    rng, e = random.Random(6), wavelet.Encoder(FILE)
    e.MOST, e.LONGEST = 500, 6
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()] + ["\u180e", "\u200b", "\u2060", "\ufeff"]
    pool = ["a", "Zé", "don't", "'s", " 's", "12", "²", "日本", "\u0301", "👩", "_-", "<|endoftext|>", "x" * 9, *[" "] * 12, *rng.sample(spaces, 8), *spaces]
    for _ in range(4000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 30)))
        assert e.encode(text) == library().encode(text, add_special_tokens=False).ids, ascii(text)


def test_texts_side_by_side():
    rng, e = random.Random(7), wavelet.Encoder(FILE)
    e.MOST, e.LONGEST = 300, 8
    ends = [" ", "  ", "\n", " \n", "\n ", "\n\n", "\t", " ", "　", "\x1c", "", "a", "é", "×", "÷", "Я", "日", "́", "'", "'s", ".", "7", "<|endoftext|>", "<|endoftext"]
    pool = [*ends, *[" ", "\n"] * 6, "the", "Zürich", "l'été", "x×y", "I'll", "'.s", "-'ll", "--", "a1b", "3rd", "½", "|>", "don't", "1,000.5"]
    for _ in range(300):
        texts = [None if rng.random() < 0.05 else rng.choice(ends) + "".join(rng.choices(pool, k=rng.randint(0, 12))) + rng.choice(ends) for _ in range(rng.randint(0, 30))]
        kept = pa.array(["before ", *texts, " after"], rng.choice([pa.string(), pa.large_string()])).slice(1, len(texts))
        ids, n = e.arrays(kept)
        want = [reference(t)[:-1] for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w], ascii(texts)


def test_a_vocabulary_with_another_pre_tokenizer_is_not_cut(tmp_path):
    made = json.loads(library().to_str())
    made["pre_tokenizer"]["use_regex"] = False
    (tmp_path / "v.json").write_text(json.dumps(made))
    e, whole = wavelet.Encoder(str(tmp_path / "v.json")), type(library()).from_file(str(tmp_path / "v.json"))
    texts = ["of the people", "", "a\nb  c", "of the people, don't"]
    ids, n = e.arrays(pa.array(texts))
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_new_words_are_not_split_by_the_whole_tokenizer():
    rng, e = random.Random(8), wavelet.Encoder(FILE)
    text = ". ".join(" ".join("".join(rng.choices("abcdefghijé", k=9)) for _ in range(10)) for _ in range(300)) + "\nIt's 1,000 more."
    handed = []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            handed.extend(texts)
            return library().encode_batch_fast(texts, **more)

    e.library = Counted()
    assert e.encode(text) == library().encode(text, add_special_tokens=False).ids
    assert sum(map(len, handed)) < len(text) // 100
    handed.clear()
    assert e.encode(text[:200]) == library().encode(text[:200], add_special_tokens=False).ids and len(handed) <= 1
