"""Exact substring dedup on words by fixed-block anchors.

1. Index: each document is cut into blocks of ``block`` words that don't overlap. Probe: every rolling
   window of ``block`` words of every document. A probe hits if its hash is that of a block and occurs
   twice or more. A repeat of ``window`` >= 2 * block - 1 words holds a whole block of whichever
   document it is looked up in, so no repeat is missed.
2. Extension: around each hit, windows of ``window`` words are compared by 128-bit fingerprints; one that
   also starts earlier (smaller key, or same document, earlier start) is repeated. Neighbouring repeated
   windows join into maximal exact repeats, and their words are removed.

Blocks, probes and fingerprints meet in buckets by hash (see repeats.py), each once for each shard.

Defined results: a null or empty text, or one without words, has no words and keeps the empty text;
texts shorter than a window lose nothing; repeated rows and equal keys are taken in order of their
texts, the first keeps its words; null keys come first; an empty table gives an empty result; columns
other than key and text are ignored, so their names can't clash. Words are runs of anything but ASCII
white space, unchanged; the kept text has one space between words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm import repeats as R
from larkspur.llm.common import materialize

WINDOW, BLOCK = 20, 10
#: Bits of a probe's hash, behind the bucket's, and the flags below them: in the index; occurs twice in the shard.
_REST, _INDEXED, _TWICE = 38, 1, 2


class _Hashes(dict):
    """Hash of each word, kept up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 11)
        return h


_hashes = _Hashes()


class _Shard:
    """Words and hashes of a shard."""

    def __init__(self, row: dict, window: int, block: int):
        blob, ends = row["blob"].as_py(), row["ends"].as_py()
        self.number, self.ids, self.window, self.block = row["shard"].as_py(), row["ids"].as_py(), window, block
        self.docs = [blob[a:b].split() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        counts = np.array([len(d) for d in self.docs], np.int64)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.n = int(self.ends[-1])
        self.values = np.fromiter((_hashes[w] for d in self.docs for w in d), np.uint64, self.n)
        self.left = np.repeat(self.ends, counts) - np.arange(self.n)  # words from here to the document's end
        self.at = np.arange(self.n) - np.repeat(self.starts, counts)

    def probes(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the probes, their distinct shortened hashes with flags, and which of these each probe has."""
        places = np.flatnonzero(self.left >= self.block)
        h = R.window_hashes(R.prefix_hashes(self.values, R.BASES[0]), R.BASES[0], self.block)[places] >> np.uint64(64 - _REST - bits)
        keys, which, count = np.unique(h, return_inverse=True, return_counts=True)
        flags = np.where(count > 1, _TWICE, 0).astype(np.uint64)
        flags[which[self.at[places] % self.block == 0]] |= np.uint64(_INDEXED)
        return places, keys << np.uint64(2) | flags, which

    def candidates(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that hold a hit, and their fingerprints."""
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int64), np.full(self.window, hit.sum())])
        places = np.flatnonzero((self.left >= self.window) & (sums[self.window - self.block + 1 :][: self.n] > sums[: self.n]))
        prints = [R.window_hashes(R.prefix_hashes(self.values, b), b, self.window)[places] if len(places) else np.empty(0, np.uint64) for b in R.BASES]
        return places, R.pack(*prints)


def _key_bytes(keys: np.ndarray) -> np.ndarray:
    """The low 40 bits of each key, five bytes each."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:])


def _key_values(raw: bytes) -> np.ndarray:
    five = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return np.concatenate([np.zeros((len(five), 3), np.uint8), five], axis=1).view(">u8").ravel().astype(np.uint64)


def _hits(parts: list[bytes]) -> list[np.ndarray]:
    """1 for each key that is in the index and occurs twice or more, over all shards."""
    values = [_key_values(p) for p in parts]
    every = np.concatenate(values)
    order = np.argsort(every >> np.uint64(2), kind="stable")
    keys, flags = every[order] >> np.uint64(2), (every[order] & np.uint64(3)).astype(np.uint8)
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    some = np.bitwise_or.reduceat(flags, begin)
    size = np.diff(np.append(begin, len(keys)))
    hit = np.empty(len(every), np.uint8)
    hit[order] = np.repeat((some & _INDEXED > 0) & ((some & _TWICE > 0) | (size > 1)), size)
    return np.split(hit, np.cumsum([len(v) for v in values])[:-1])


def _probe_rows(s: _Shard, bits: int) -> pa.RecordBatch:
    _, keys, _ = s.probes(bits)
    return R.to_buckets(s.number, _key_bytes(keys), (keys >> np.uint64(_REST + 2)).astype(np.int64), bits)


def _local(s: _Shard, answers, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the candidate windows, distinct fingerprints, and the fingerprint of each window."""
    places, _, which = s.probes(bits)
    hit = np.zeros(s.n, bool)
    hit[places] = R.joined(answers)[which] > 0 if len(places) else False
    at, prints = s.candidates(hit)
    keys, which = np.unique(prints, return_inverse=True)
    return at, keys, which


def _first(keys: np.ndarray) -> np.ndarray:
    return np.frombuffer(keys.tobytes(), ">u8").reshape(-1, 2)[:, 0].astype(np.uint64)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK, shard_bytes: int = R.SHARD_BYTES, with_text: bool = False, others: Sequence[str] = ()) -> DataFrame:
    """(key, n_words, n_removed, n_spans, kept_sha256) and, if asked for, kept_text and a struct of other columns of docs.

    n_spans: maximal runs of removed words. kept_text: the text itself where nothing was removed.
    """
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block wherever it begins: 2 * block - 1 <= window")
    shards, size = R.shards(docs, key, text, shard_bytes, others)
    bits = R.bucket_bits(size)
    texts = shards.select("shard", "ids", "ends", "blob")
    probes = R.each_shard(texts, lambda row: _probe_rows(_Shard(row, window, block), bits), R.EXCHANGE)
    hits = materialize(R.exchange(probes, _hits).withColumnRenamed("answers", "hits"), "block-hits")

    def windows(row: dict) -> pa.RecordBatch:
        s = _Shard(row, window, block)
        _, keys, _ = _local(s, row["hits"], bits)
        return R.to_buckets(s.number, keys, (_first(keys) >> np.uint64(64 - bits)).astype(np.int64), bits)

    prints = R.each_shard(texts.join(hits, "shard"), windows, R.EXCHANGE)
    seen = materialize(R.exchange(prints, R.first_windows).withColumnRenamed("answers", "seen"), "window-verdicts")

    def decide(row: dict) -> pa.RecordBatch:
        s = _Shard(row, window, block)
        at, keys, which = _local(s, row["hits"], bits)
        before = R.joined(row["seen"]) > 0
        first = np.full(len(keys), s.n, np.int64)
        np.minimum.at(first, which, at)
        gone = R.covered(at[before[which] | (first[which] < at)] if len(at) else at, window, s.n)
        blob, limits = row["blob"].as_py(), row["ends"].as_py()
        kept_text, shas, spans, removed = [], [], [], []
        for words, a, b, x, y in zip(s.docs, s.starts.tolist(), s.ends.tolist(), [0, *limits[:-1]], limits, strict=True):
            g = gone[a:b]
            removed.append(n := int(np.count_nonzero(g)))
            spans.append(int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[:1].any()) if n else 0)
            kept = b" ".join([w for w, out in zip(words, g.tolist(), strict=True) if not out] if n else words)
            shas.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_text.append((kept if n else blob[x:y]).decode())
        columns = [pa.array(s.ids, pa.int64()), pa.array(s.ends - s.starts), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())]
        names = [key, "n_words", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns, names = [*columns, pa.array(kept_text, pa.string())], [*names, "kept_text"]
        if others:
            columns, names = [*columns, row["others"].values], [*names, "others"]
        return pa.record_batch(columns, names=names)

    fields = T.StructType.fromDDL(f"`{key}` long, n_words long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")).fields
    schema = T.StructType([*fields, *([T.StructField("others", shards.schema["others"].dataType.elementType)] if others else [])])
    whole = shards if others else texts
    return R.each_shard(whole.join(hits, "shard", "left").join(seen, "shard", "left"), decide, schema)
