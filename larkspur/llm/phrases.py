"""Phrase collocation mining over depth-limited count tries.

A text is lower-cased (A to Z only), cut into pieces at ``[.,;:!?`` and the line ends 0A to 0D, and a piece into words
at blanks and tabs. All counts are by language (null: ``und``). The texts are read three times; each time a task turns
a shard of texts into sorted arrays, with numpy and Arrow only:

1. Words. A shard gives its distinct words as sorted 40-bit hashes with counts. Summed over all shards, what is
   frequent enough sets bits in a filter of fixed size, which is broadcast.
2. Pairs of words that pass the filter, in the same way: a second filter.
3. A trie of each shard, of depth ``most_words``: words that pass, then the pairs that pass, then what continues a pair
   by pairs that pass. A part of a frequent phrase is as frequent, and filters err on one side only, so no frequent
   phrase is lost; all final counts come from the tries and are exact.

A trie is serialised in order of its paths and cut into pieces by ranges of the prefix (the hash of the first two words; of
the word, for single ones). The pieces of a range are merged k ways, level by level: paths are sorted with the number of
their merged parent, so equal paths meet. At most ``fan`` pieces are merged at once; with more shards merging takes rounds,
so a phrase that every shard has never makes a task hold an entry for each shard.

What is frequent is then a table. Left parts of a phrase are counted on the walk down its trie; its right parts by the
suffix link, the node of the same words without the first, which carries its own right parts.

Inside the tries a word is a hash of its language and itself, of as many bytes as the number of frequent words asks for. Merging
compares the words themselves: if two of them have one hash, the tries are made again with another seed, so hashes decide nothing.

Defined results: a null text has no words; a null language is ``und``; repeated rows count each; ids are not looked at;
an empty table gives no rows; a very long text is a shard of its own; extra columns are ignored. Of phrases of one score
that with the larger count comes first, then that which is first in the order of its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from larkspur.llm.common import materialize
from larkspur.llm.repeats import mix

#: Bytes of text whose tries are made at once, and bits of a filter (16 MB).
SHARD_BYTES, FILTER_BITS = 8 << 20, 27
#: Pieces that are merged at once.
FAN = 512
_U, KEY_BITS = np.uint64, 40
# Bytes between the words of a piece, and between pieces.
BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*BLANKS]], _KINDS[[*BREAKS]] = 1, 2


class Words:
    """The words of some texts of one language: places in order, as numbers of the distinct words, which are sorted by hash."""

    def __init__(self, lang: str, texts: list[bytes], seed: int):
        data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        kind = _KINDS[data]
        inside = kind == 0
        edges = np.flatnonzero(np.diff(np.concatenate([np.zeros(1, np.int8), inside.view(np.int8), np.zeros(1, np.int8)])))
        starts, ends = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        letters, piece = data[inside], np.cumsum(kind == 2, dtype=np.int32)
        made = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
        found = made.dictionary.to_pylist()
        head = lang.encode() + b"\0"
        hashes = np.array([xxhash.xxh3_64_intdigest(head + w, seed) for w in found], _U)
        order = np.argsort(hashes)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.lang, self.seed, self.hashes, self.words = lang, seed, hashes[order], [found[i] for i in order]
        self.at = number[made.indices.to_numpy()]
        #: Whether the next place is in the same piece.
        self.goes_on = piece[starts[1:]] == piece[starts[:-1]]
        self.counts = np.bincount(self.at, minlength=len(order))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0x9E3779B97F4A7C15) + mix(b))


def cut(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the ranges of 2**bits equal parts of the hashes begin in sorted ``keys``."""
    return np.searchsorted(keys >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=_U))


def pack_ints(x: np.ndarray) -> bytes:
    """Numbers from 0 on in the least width that holds all of them; the first byte is the width."""
    most = int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpack_ints(b: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(kind)


def pack_keys(x: np.ndarray, width: int) -> bytes:
    """The first ``width`` bytes of 64-bit keys, byte plane by byte plane; the first byte is the width."""
    return bytes([width]) + x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_keys(b: bytes) -> np.ndarray:
    width = b[0]
    out = np.zeros(((len(b) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8, offset=1).reshape(width, -1).T
    return out.view(">u8").ravel().astype(_U)


class Filter:
    """Bits by the first FILTER_BITS bits of a hash."""

    def __init__(self, parts: list[tuple[int, bytes]], part_bits: int, bits: int = FILTER_BITS):
        self.bits = bits
        size = 1 << (bits - part_bits - 3)
        self.data = np.zeros(1 << (bits - 3), np.uint8)
        for number, content in parts:
            self.data[number * size : (number + 1) * size] = np.frombuffer(content, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> _U(64 - self.bits)
        return (self.data[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)


def shards(texts: DataFrame, make: Callable[[dict[str, list[bytes]]], Iterator[tuple]], schema: str, shard_bytes: int) -> DataFrame:
    """``make`` on the texts of each shard by language; it gives rows without the number of the run, which comes first. texts: (t, lang)."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = _arrow(schema).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size, number, part = 0, 0, 0

        def flush():
            nonlocal held, size, number
            rows = [(part << 32 | number, *r) for r in make(held)]
            held, size, number = {}, 0, number + 1
            for i in range(0, len(rows), 64):
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 64], strict=True), kinds, strict=True)], names=names)

        for b in batches:
            part = b.column(2)[0].as_py() if b.num_rows else part
            langs = b.column(1).to_pylist()
            for i, t in enumerate(b.column(0)):
                body = t.as_py().encode()
                held.setdefault(langs[i], []).append(body)
                size += len(body)
                if size >= shard_bytes:
                    yield from flush()
        if held:
            yield from flush()

    return texts.select("t", "lang", F.spark_partition_id().cast("long").alias("p")).mapInArrow(run, schema)


RUNS = "run long, bucket int, keys binary, counts binary"


def key_runs(hashes: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple]:
    """Rows of RUNS for sorted hashes: differences of the first 40 bits, and counts."""
    at = cut(hashes, bits)
    short, small = hashes >> _U(64 - KEY_BITS), np.minimum(counts, 2**32 - 1).astype(np.uint32)
    for i in np.flatnonzero(at[1:] > at[:-1]).tolist():
        some = short[at[i] : at[i + 1]] - _U(i << (KEY_BITS - bits))
        yield i, pack_ints(np.diff(some, prepend=_U(0))), pack_ints(small[at[i] : at[i + 1]])


def in_rounds(runs: DataFrame, n: int, merge: Callable[[list[dict]], dict], schema: str, last: Callable[[dict], pa.Table], made: str, fan: int) -> DataFrame:
    """Merge the runs of each bucket, ``n`` at most, at most about ``fan`` at once, until each bucket has one, of which ``last`` makes rows. Each round before the last is written."""
    columns = [f.split()[0] for f in schema.split(", ")]

    def meet(group: pa.Table) -> dict:
        rows = group.to_pylist()
        return {"run": rows[0]["run"], "bucket": rows[0]["bucket"], **merge(rows)}

    def again(group: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([meet(group)]).select(columns).cast(_arrow(schema))

    while n > fan:
        n = -(-n // fan)
        runs = materialize(runs.withColumn("run", F.pmod(F.xxhash64("run"), F.lit(n))).groupBy("bucket", "run").applyInArrow(again, schema), "runs")
    return runs.groupBy("bucket").applyInArrow(lambda group: last(meet(group)), made)


def _arrow(schema: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(f.split()[0], types[f.split()[1]]) for f in schema.split(", ")])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts. Sorting runs that are sorted already is merging them."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merge_keys(rows: list[dict]) -> dict:
    keys = np.concatenate([np.cumsum(unpack_ints(r["keys"], _U)) for r in rows])
    keys, counts = summed(keys, np.concatenate([unpack_ints(r["counts"]) for r in rows]))
    return {"keys": pack_ints(np.diff(keys, prepend=_U(0))), "counts": pack_ints(np.minimum(counts, 2**32 - 1))}


def frequent(runs: DataFrame, n: int, least: int, bits: int, filter_bits: int, fan: int) -> Filter:
    """The filter of the keys whose counts add up to ``least``. What comes to the driver is the filter, whose size is fixed."""
    size = 1 << (filter_bits - bits)

    def set_bits(row: dict) -> pa.Table:
        out = np.zeros(size, bool)
        hit = np.cumsum(unpack_ints(row["keys"], _U))[unpack_ints(row["counts"]) >= least]
        out[hit >> _U(KEY_BITS - filter_bits)] = True
        return pa.table([pa.array([row["bucket"]], pa.int32()), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], names=["bucket", "bits"])

    done = in_rounds(runs, n, merge_keys, RUNS, set_bits, "bucket int, bits binary", fan)
    # Written first, so that the runs' shuffle files go.
    return Filter([(r["bucket"], bytes(r["bits"])) for r in materialize(done, "filter").collect()], bits, filter_bits)


class Trie:
    """Levels in order of their paths. Level 0: words by hash; level 1: pairs by (pair hash, first, second); further levels: (number of the parent in the level above, word). Single words and pairs are roots, so that a range of prefixes is a piece."""

    def __init__(self, words: list[bytes], langs: list[str], hashes: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], deeper: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.langs, self.hashes, self.counts, self.pairs, self.deeper = words, langs, hashes, counts, pairs, deeper

    def pack(self, width: int = 8) -> dict:
        """Parents are stored as the number of children of each node, words by the first ``width`` bytes of their hashes, which must hold all."""
        above, levels = len(self.pairs[0]), []
        for parent, word, n in self.deeper:
            levels += [pack_ints(np.bincount(parent, minlength=above)), pack_keys(word, width), pack_ints(n)]
            above = len(word)
        a, b, n = self.pairs
        return {"lang": self.langs, "word": self.words, "hash": pack_keys(self.hashes, width), "n": pack_ints(self.counts), "pairs": [pack_keys(a, width), pack_keys(b, width), pack_ints(n)], "levels": levels}

    @staticmethod
    def unpack(row: dict) -> Trie:
        deeper, levels = [], row["levels"]
        for i in range(0, len(levels), 3):
            children = unpack_ints(levels[i])
            deeper.append((np.repeat(np.arange(len(children)), children), unpack_keys(levels[i + 1]), unpack_ints(levels[i + 2])))
        first, second, n = row["pairs"]
        return Trie(row["word"], row["lang"], unpack_keys(row["hash"]), unpack_ints(row["n"]), (unpack_keys(first), unpack_keys(second), unpack_ints(n)), deeper)

    def pieces(self, bits: int) -> Iterator[tuple[int, Trie]]:
        """The trie cut by ranges of its prefixes."""
        at0, at1 = cut(self.hashes, bits), cut(pair_hash(self.pairs[0], self.pairs[1]), bits)
        starts = [at1]
        for parent, _, _ in self.deeper:
            starts.append(np.searchsorted(parent, starts[-1]))
        for i in np.flatnonzero((at0[1:] > at0[:-1]) | (at1[1:] > at1[:-1])).tolist():
            a, b = at0[i], at0[i + 1]
            c, d = at1[i], at1[i + 1]
            deeper = [(p[s[i] : s[i + 1]] - above[i], w[s[i] : s[i + 1]], n[s[i] : s[i + 1]]) for (p, w, n), s, above in zip(self.deeper, starts[1:], starts, strict=False)]
            yield i, Trie(self.words[a:b], self.langs[a:b], self.hashes[a:b], self.counts[a:b], tuple(x[c:d] for x in self.pairs), deeper)


def trie_of(found: Words, words: Filter, pairs: Filter, most_words: int, width: int = 8) -> Trie:
    """The trie of a shard. Numbers of words are in order of their hashes, so paths sort as numbers.

    Of a hash ``width`` bytes are kept. The root, the empty phrase, counts all words of the language and stands among the words.
    """
    short = found.hashes & _U((2**64 - 1) ^ ((1 << 64 - 8 * width) - 1))
    alive = words.has(found.hashes)
    at, n = found.at, len(found.at)
    a, b = at[:-1], at[1:]
    live = np.flatnonzero(found.goes_on & alive[a] & alive[b])
    live = live[pairs.has(pair_hash(found.hashes[a[live]], found.hashes[b[live]]))]
    holds = np.zeros(max(n, 1), bool)
    holds[live] = True
    size = max(1, len(found.hashes))
    # Pairs, put in order of (pair hash, first, second).
    keys, number, counts = np.unique(a[live] * size + b[live], return_inverse=True, return_counts=True)
    first, second = short[keys // size], short[keys % size]
    order = np.lexsort((second, first, pair_hash(first, second)))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    made, node, deeper = (first[order], second[order], counts[order]), place[number], []
    where = live
    for depth in range(3, most_words + 1):
        # A phrase goes on where its last two words are a pair that passes.
        more = np.flatnonzero(holds[np.minimum(where + depth - 2, len(holds) - 1)] & (where + depth - 1 < n))
        where, node = where[more], node[more]
        keys, node, counts = np.unique(node * size + at[where + depth - 1], return_inverse=True, return_counts=True)
        deeper.append((keys // size, short[keys % size], counts))
    kept = np.flatnonzero(alive)
    root = _U(xxhash.xxh3_64_intdigest(found.lang.encode() + b"\0", found.seed)) & _U((2**64 - 1) ^ ((1 << 64 - 8 * width) - 1))
    at = int(np.searchsorted(short[kept], root))
    all_words = [found.words[i] for i in kept]
    all_words.insert(at, b"")
    return Trie(all_words, [found.lang] * len(all_words), np.insert(short[kept], at, root), np.insert(found.counts[kept], at, n), made, deeper)


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows by keys (first one first), number of each row's group in that order, first row of each group."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    if len(order):
        fresh[0] = True
        for k in keys:
            fresh[1:] |= k[order][1:] != k[order][:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return order, group, order[np.flatnonzero(fresh)]


def _sums(group: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, group, counts)
    return out


def merge_tries(tries: list[Trie]) -> Trie | None:
    """K tries as one: level by level, with the merged number of the parent as the key's first part. None if two words have one hash."""
    words = [w for t in tries for w in t.words]
    langs = [x for t in tries for x in t.langs]
    hashes = np.concatenate([t.hashes for t in tries])
    _, group, first = _grouped(hashes)
    for i, g in enumerate(group.tolist()):
        if words[i] != words[first[g]] or langs[i] != langs[first[g]]:
            return None
    counts = _sums(group, np.concatenate([t.counts for t in tries]), len(first))
    a, b, n = (np.concatenate([t.pairs[i] for t in tries]) for i in range(3))
    _, node, lead = _grouped(pair_hash(a, b), a, b)
    merged = Trie([words[i] for i in first], [langs[i] for i in first], hashes[first], counts, (a[lead], b[lead], _sums(node, n, len(lead))), [])
    bases = np.cumsum([0, *(len(t.pairs[0]) for t in tries)])
    for depth in range(len(tries[0].deeper)):
        parent = node[np.concatenate([t.deeper[depth][0] + base for t, base in zip(tries, bases, strict=False)])]
        word, n = (np.concatenate([t.deeper[depth][i] for t in tries]) for i in (1, 2))
        bases = np.cumsum([0, *(len(t.deeper[depth][1]) for t in tries)])
        _, node, lead = _grouped(parent, word)
        merged.deeper.append((parent[lead], word[lead], _sums(node, n, len(lead))))
    return merged


PIECE = ("lang", "word", "hash", "n", "pairs", "levels")


def merge_rows(rows: list[dict]) -> dict:
    merged = merge_tries([Trie.unpack(r) for r in rows]) if all(r["levels"] is not None for r in rows) else None
    return merged.pack(rows[0]["hash"][0]) if merged else dict.fromkeys(PIECE)


TRIES = "run long, bucket int, lang array<string>, word array<binary>, hash binary, n binary, pairs array<binary>, levels array<binary>"
NODES = "depth int, lang string, word string, path array<long>, a long, lefts array<long>"


def nodes(trie: Trie, least: int) -> Iterator[pa.RecordBatch]:
    """NODES of the frequent nodes, the roots with depth 0: ``lefts`` are the counts of the pair, of three words and so on that a path of three and more words goes through. ``path`` holds hashes."""

    def rows(depth: int | np.ndarray, path: np.ndarray, a: np.ndarray, lefts: np.ndarray, lang=None, word=None) -> pa.RecordBatch:
        m = len(a)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * x.shape[1], pa.int32()), pa.array(x.astype(np.int64).ravel())) for x in (path.view(np.int64), lefts)]
        return pa.record_batch([pa.array(np.broadcast_to(np.asarray(depth, np.int32), m)), pa.array(lang or [None] * m, pa.string()), pa.array(word or [None] * m, pa.string()), lists[0], pa.array(a, pa.int64()), lists[1]], names=[f.split()[0] for f in NODES.split(", ")])

    hit = np.flatnonzero(trie.counts >= least)
    yield rows(np.array([int(trie.words[i] != b"") for i in hit], np.int32), trie.hashes[hit][:, None], trie.counts[hit], np.empty((len(hit), 0)), [trie.langs[i] for i in hit], [trie.words[i].decode() for i in hit])
    path, counts, lefts = np.stack(trie.pairs[:2], axis=1), trie.pairs[2], np.empty((len(trie.pairs[0]), 0), np.int64)
    depth = 2
    while True:
        hit = np.flatnonzero(counts >= least)
        for i in range(0, len(hit), 100_000):
            some = hit[i : i + 100_000]
            yield rows(depth, np.ascontiguousarray(path[some]), counts[some], lefts[some])
        if depth - 2 == len(trie.deeper):
            return
        parent, word, n = trie.deeper[depth - 2]
        path, lefts, counts = np.concatenate([path[parent], word[:, None]], axis=1), np.concatenate([lefts[parent], counts[parent][:, None]], axis=1), n
        depth += 1


def clash() -> pa.RecordBatch:
    """A row of depth -1: two words have one hash."""
    return pa.RecordBatch.from_pylist([{"depth": -1, "path": [], "a": 0, "lefts": []}], _arrow(NODES))


def frequent_nodes(docs: DataFrame, text: str, lang: str, least: int, most_words: int, seed: int, shard_bytes: int, filter_bits: int, fan: int) -> DataFrame:
    """NODES of all phrases of 0 to ``most_words`` words that occur ``least`` times."""
    spark = docs.sparkSession
    texts = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    # A range holds some megabytes of each round's pieces.
    bits = min(16, max(3, int(np.ceil(np.log2(max(1, size / (8 << 20)))))))

    def joined(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        """Languages differ in their hashes, so those of a shard are one run."""
        keys, counts = (np.concatenate(x) for x in zip(*pairs, strict=True))
        return key_runs(*summed(keys, counts), bits)

    def word_rows(held: dict[str, list[bytes]]) -> Iterator[tuple]:
        made = [Words(name, bodies, seed) for name, bodies in held.items()]
        yield from joined((found.hashes, found.counts) for found in made)

    n = size // shard_bytes + texts.rdd.getNumPartitions()  # runs, at most
    words = frequent(shards(texts, word_rows, RUNS, shard_bytes), n, least, bits, filter_bits, fan)
    # So many bytes of a hash that two of the words that pass hardly share them.
    width = min(8, max(1, -(-int(2 * np.log2(2 + np.bitwise_count(words.data).sum()) + 7) // 8)))
    words = spark.sparkContext.broadcast(words)

    def pair_rows(held: dict[str, list[bytes]]) -> Iterator[tuple]:
        made = []
        for name, bodies in held.items():
            found = Words(name, bodies, seed)
            alive, a, b = words.value.has(found.hashes), found.at[:-1], found.at[1:]
            live = found.goes_on & alive[a] & alive[b]
            size = max(1, len(alive))
            keys, counts = np.unique(a[live] * size + b[live], return_counts=True)
            made.append((pair_hash(found.hashes[keys // size], found.hashes[keys % size]), counts))
        yield from joined(made)

    pairs = spark.sparkContext.broadcast(frequent(shards(texts, pair_rows, RUNS, shard_bytes), n, least, bits, filter_bits, fan))

    def trie_rows(held: dict[str, list[bytes]]) -> Iterator[tuple]:
        made = [trie_of(Words(name, bodies, seed), words.value, pairs.value, most_words, width) for name, bodies in held.items()]
        whole = merge_tries(made) if len(made) > 1 else made[0]
        if whole is None:
            yield 0, *dict.fromkeys(PIECE).values()
            return
        for bucket, piece in whole.pieces(bits):
            yield bucket, *piece.pack(width).values()

    def emit(row: dict) -> pa.Table:
        return pa.Table.from_batches(list(nodes(Trie.unpack(row), least)) if row["levels"] is not None else [clash()], _arrow(NODES))

    return materialize(in_rounds(shards(texts, trie_rows, TRIES, shard_bytes), n, merge_rows, TRIES, emit, NODES, fan), "nodes")


def levels(found: DataFrame, most_words: int) -> list[DataFrame]:
    """For each depth (path, lang, phrase, last, first, a, lefts, rights), written: counts of the parts before and after each cut."""
    none = F.array().cast("array<long>")
    made = [found.where("depth = 1").select("path", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("a").alias("first"), "a", none.alias("lefts"), none.alias("rights"))]
    for depth in range(2, most_words + 1):
        here = found.where(F.col("depth") == depth).select("path", "a", "lefts", F.slice("path", 1, depth - 1).alias("head"), F.slice("path", 2, depth - 1).alias("link"))
        # Every part of a frequent phrase is frequent, so both joins find their row.
        parent = made[-1].select(F.col("path").alias("head"), "lang", F.col("phrase").alias("before"), "first")
        suffix = made[-1].select(F.col("path").alias("link"), F.concat(F.array("a"), "rights").alias("rights"), "last")
        both = here.join(parent, "head").join(suffix, "link")
        made.append(materialize(both.select("path", "lang", F.concat_ws(" ", "before", "last").alias("phrase"), "last", "first", "a", F.concat(F.array("first"), "lefts").alias("lefts"), "rights"), "phrases"))
    return made[1:]


def worst_cut(a: Column, lefts: Column, rights: Column, scale: int) -> Column:
    """(score, k, l, r) of the cut with the smallest score, the first of equal ones. Decimals: products pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    total = F.lit(scale).cast("decimal(9,0)") * wide(a)

    def one(k: Column) -> Column:
        left, right = F.element_at(lefts, k), F.element_at(rights, k)
        return F.struct(F.call_function("div", total, wide(left) + wide(right)).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(lefts)), one))


def phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, most_words: int = 4, top: int | None = 2000, scale: int = 2_000_000, covered: int = 80, shard_bytes: int = SHARD_BYTES, filter_bits: int = FILTER_BITS, fan: int = FAN, seed: int = 42
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``most_words`` words that occur ``least`` times.

    A phrase inside a longer one that has ``covered`` percent of its count is left out. ``top``: phrases a language, None for all.
    """
    while True:
        found = frequent_nodes(docs, text, lang, least, most_words, seed, shard_bytes, filter_bits, fan)
        if found.where("depth = -1").isEmpty():
            break
        seed += 1
    made = levels(found, most_words)
    kept = []
    for i, here in enumerate(made):
        if i + 1 < len(made):
            # A longer phrase has the count of the one between at most, so the next depth decides.
            longer = made[i + 1].select("a", F.explode(F.array(F.slice("path", 1, i + 2), F.slice("path", 2, i + 2))).alias("path")).groupBy("path").agg(F.max("a").alias("most"))
            here = here.join(longer, "path", "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a"))).drop("most")
        kept.append(here)
    scored = reduce(DataFrame.unionByName, kept).withColumn("cut", worst_cut(F.col("a"), F.col("lefts"), F.col("rights"), scale)).join(found.where("depth = 0").select("lang", F.col("a").alias("n")), "lang")
    rows = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
