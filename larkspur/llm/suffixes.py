"""Exact substring dedup on bytes by suffix arrays.

1. Anchors: of all ``ANCHOR``-byte strings of a window, the one with the least hash. Neighbouring windows
   that share an anchor form a segment, about one for each 27 bytes of text. Anchors and hashes of the
   segments meet in buckets (see repeats.py). A segment whose anchor occurs once holds no repeat; one that
   equals an earlier segment is all repeat; the others are open.
2. Each shard builds a suffix array of its open segments: Larsson-Sadakane refinement doubles the sorted
   depth from 7 bytes on, and only groups that are still equal are sorted again.
   Kasai's algorithm gives the common prefixes of neighbours; windows with a common prefix of the full
   length are the same string, of which the first place counts.
   The verdict inside a shard comes from these groups.
3. Across shards, the sorted groups of all shards (as 128-bit fingerprints of their windows) are merged
   pairwise by binary search; each is told whether an earlier shard has it.

Equal windows have equal anchors, so they are in equal segments or in open ones: nothing is missed.

Defined results: a null or empty text has no bytes and keeps the empty text; texts shorter than a window
lose nothing; matches never cross documents; repeated rows and equal keys are taken in order of their
texts, the first keeps its bytes; null keys come first; an empty table gives an empty result; columns
other than key and text are ignored, so their names can't clash. Kept bytes may end inside a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm import repeats as R
from larkspur.llm.common import materialize

WINDOW, ANCHOR = 100, 48
_U = np.uint64
_BYTE = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LATER, _OPEN = 1, 2


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: minima from the left and from the right inside blocks of that width."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.empty(0, keys.dtype)
    blocks = np.concatenate([keys, np.full(-len(keys) % width, np.iinfo(keys.dtype).max, keys.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of the ``depth`` bytes that follow (past the end: less than any), and the rank of each place; equal strings have equal ranks."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Bytes with one more value for the end need 9 bits: seven of them fit in a word.
    h = min(7, depth)
    wide = np.concatenate([text.astype(np.uint16) + 1, np.zeros(h, np.uint16)])
    key = np.zeros(n, _U)
    for i in range(h):
        key = key << _U(9) | wide[i : i + n].astype(_U)
    sa = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[sa[1:]] != key[sa[:-1]]])
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(fresh)
    rank[sa] = np.repeat(starts, np.diff(np.append(starts, n)))  # a group's rank is its first place
    open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while h < depth and len(open_):
        step = min(h, depth - h)
        at = sa[open_]
        ahead = at + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        first = rank[at]
        order = np.lexsort((second, first))
        at, first, second = at[order], first[order], second[order]
        sa[open_] = at
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        begin = np.flatnonzero(new)
        rank[at] = np.repeat(open_[begin], np.diff(np.append(begin, len(at))))
        open_ = open_[~(new & np.append(new[1:], True))]
        h += step
    return sa, rank


def common_prefixes(text: bytes, sa: np.ndarray, most: int) -> np.ndarray:
    """Kasai: bytes that each place of the array has in common with the one before it, up to ``most``."""
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out, k = [0] * n, 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            k = 0
            continue
        end = min(most, n - max(i, j))
        if k > end:
            k = end
        while k < end and text[i + k] == text[j + k]:
            k += 1
        out[i] = k
        if k:
            k -= 1
    return np.array(out, np.int64)[sa]


class _Shard:
    """Bytes, anchors and segments of a shard."""

    def __init__(self, row: dict, window: int, anchor: int):
        self.number, self.ids, self.window = row["shard"].as_py(), row["ids"].as_py(), window
        self.blob = row["blob"].as_py()
        self.ends = np.array(row["ends"].as_py(), np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.text = np.frombuffer(self.blob, np.uint8)
        n = len(self.text)
        prefix = R.prefix_hashes(_BYTE[self.text], R.BASES[0])
        h = R.window_hashes(prefix, R.BASES[0], anchor)
        minima = window_minima((h >> _U(32) << _U(32)) | np.arange(len(h), dtype=_U), window - anchor + 1)
        places = (minima & _U(0xFFFFFFFF)).astype(np.int64)
        valid = np.zeros(len(places), bool)
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            valid[a : max(a, b - window + 1)] = True
        fresh = np.empty(len(places), bool)
        fresh[:1], fresh[1:] = True, places[1:] != places[:-1]
        fresh[1:] |= valid[1:] & ~valid[:-1]
        begin = np.flatnonzero(fresh & valid)
        stop = np.flatnonzero(valid & np.append(fresh[1:] | ~valid[1:], np.ones(min(1, len(valid)), bool))) + 1
        #: Windows start from first[i] on and before last[i]; the segment's bytes go on for a window from there.
        self.first, self.last = begin, stop
        hashes = R.run_hashes(prefix, R.BASES[0], begin, stop + window - 1)
        self.keys, self.which = np.unique(R.pack(h[places[begin]], hashes), return_inverse=True)
        self.earliest = np.full(len(self.keys), n, np.int64)
        np.minimum.at(self.earliest, self.which, begin)

    def repeated_segments(self, codes: np.ndarray) -> np.ndarray:
        return (self.earliest[self.which] < self.first) | (codes[self.which] == _LATER)

    def open_text(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the open segments, end to end: the place of each byte, and where windows start."""
        own = np.flatnonzero((codes[self.which] == _OPEN) & (self.earliest[self.which] == self.first))
        a, b = self.first[own], self.last[own] + self.window - 1
        sizes = b - a
        shift = np.cumsum(sizes) - sizes
        source = np.arange(int(sizes.sum())) + np.repeat(a - shift, sizes)
        return source, np.flatnonzero(np.arange(len(source)) - np.repeat(shift, sizes) <= np.repeat(sizes - self.window, sizes))

    def groups(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the windows of the open segments in suffix order, the group of equal windows of each, and the first place of each group, by suffix array and common prefixes."""
        source, at = self.open_text(codes)
        text = self.text[source]
        sa, _ = suffix_array(text, len(text))  # to the end: Kasai's bound needs the true order
        prefixes = common_prefixes(text.tobytes(), sa, self.window)
        starts = np.zeros(len(sa), bool)
        starts[at] = True
        # Neighbours whose common prefix is a whole window are one string.
        _, group = np.unique(np.cumsum(prefixes < self.window)[starts[sa]], return_inverse=True)
        places = source[sa[starts[sa]]]
        first = np.full(int(group.max()) + 1 if len(group) else 0, len(self.text), np.int64)
        np.minimum.at(first, group, places)
        return places, group, first

    def group_prints(self, first: np.ndarray) -> np.ndarray:
        """Fingerprints of the groups' windows, by which shards tell each other of them."""
        if not len(first):
            return np.empty(0, "S16")
        values = _BYTE[self.text]
        return R.pack(*(R.window_hashes(R.prefix_hashes(values, base), base, self.window)[first] for base in R.BASES))


def _first(keys: np.ndarray) -> np.ndarray:
    return np.frombuffer(keys.tobytes(), ">u8").reshape(-1, 2)[:, 0].astype(_U)


def _codes(parts: list[bytes]) -> list[np.ndarray]:
    """For each segment of each shard: later, open or neither."""
    runs = [np.frombuffer(p, "S16") for p in parts]
    later = R.seen_before(runs)
    pairs = np.frombuffer(b"".join(parts), ">u8").reshape(-1, 2)
    fresh = np.concatenate(later) == 0
    anchors = pairs[:, 0].astype(_U)
    kinds, count = np.unique(anchors[fresh], return_counts=True)
    many = np.isin(anchors, kinds[count > 1])
    codes = np.where(fresh, np.where(many, _OPEN, 0), _LATER).astype(np.uint8)
    return np.split(codes, np.cumsum([len(r) for r in runs])[:-1])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, shard_bytes: int = R.SHARD_BYTES, with_spans: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) and, if asked for, spans: array of removed (start, end)."""
    if not 0 < anchor <= window:
        raise ValueError("an anchor is a part of a window")
    shards, size = R.shards(docs, key, text, shard_bytes)
    bits = R.bucket_bits(size)

    def segments(row: dict) -> pa.RecordBatch:
        s = _Shard(row, window, anchor)
        return R.to_buckets(s.number, s.keys, (_first(s.keys) >> _U(64 - bits)).astype(np.int64), bits)

    codes = materialize(R.exchange(R.each_shard(shards, segments, R.EXCHANGE), _codes).withColumnRenamed("answers", "codes"), "segment-codes")

    def windows(row: dict) -> pa.RecordBatch:
        s = _Shard(row, window, anchor)
        prints = np.sort(s.group_prints(s.groups(R.joined(row["codes"]))[2]))
        return R.to_buckets(s.number, prints, (_first(prints) >> _U(64 - bits)).astype(np.int64), bits)

    seen = materialize(R.exchange(R.each_shard(shards.join(codes, "shard"), windows, R.EXCHANGE), R.first_windows).withColumnRenamed("answers", "seen"), "window-verdicts")

    def decide(row: dict) -> pa.RecordBatch:
        s = _Shard(row, window, anchor)
        code = R.joined(row["codes"])
        whole = s.repeated_segments(code) if len(s.first) else np.zeros(0, bool)
        gone = R.covered(s.first[whole], (s.last - s.first + window - 1)[whole], len(s.text))
        places, group, first = s.groups(code)
        if len(places):
            # The shard asked about its groups in the order of their fingerprints.
            before = np.empty(len(first), bool)
            before[np.argsort(s.group_prints(first), kind="stable")] = R.joined(row["seen"]) > 0
            gone |= R.covered(places[before[group] | (first[group] < places)], window, len(s.text))
        removed, count, shas, spans = [], [], [], []
        for a, b in zip(s.starts.tolist(), s.ends.tolist(), strict=True):
            g = gone[a:b]
            removed.append(n := int(np.count_nonzero(g)))
            edges = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8))).tolist() if n else []
            count.append(len(edges) // 2)
            spans.append([{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2], strict=True)])
            shas.append(hashlib.sha256(s.text[a:b][~g].tobytes() if n else s.blob[a:b]).hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [pa.array(s.ids, pa.int64()), pa.array(s.ends - s.starts), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(shas, pa.string())]
        return pa.record_batch([*columns, *([pa.array(spans, kind)] if with_spans else [])], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans"] if with_spans else [])])

    schema = f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<start:long,end:long>>" if with_spans else "")
    return R.each_shard(shards.join(codes, "shard", "left").join(seen, "shard", "left"), decide, schema)
