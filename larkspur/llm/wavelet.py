"""Token ids on disk: a wavelet matrix for each shard, one compressed file.

Format of a file (little-endian): magic ``WVM2``; unsigned 32-bit counts: documents, tokens, bits, entries of
the directory for each plane; the compressed sizes of the document table and of each bit-plane (64 bits each);
the directory; then these parts. The document table holds the ids of the documents (int64) and the token
position behind each (int64). Plane i holds bit ``bits - 1 - i`` of every token, in the order that the planes
above leave: stably sorted by the bit before, zeros first. A plane is compressed in blocks. The directory holds,
for each plane, the ones before each block and, after those of all planes, where each block begins in its
plane; one entry more gives the end. Inside a block, rank counts bits word by word; select walks the
directory, then the block, by binary search. So an access opens one block of each plane.

Access, counting and finding occurrences take ``bits`` steps each, whatever the shard's size.

Defined results: a null or empty text is the end id alone; null keys come first, equal keys in the
order of their texts; an empty table gives no files and no rows; columns other than key and text are
ignored, so their names can't clash. Texts are encoded whole; a shard is a range of keys, and a text
is never cut over two shards.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from larkspur.llm.common import fresh_path, materialize
from larkspur.llm.files import make_folder, read_file, write_file

MAGIC = b"WVM2"
#: Bytes of a plane that are compressed together.
BLOCK_BYTES = 64 << 10
#: Bytes of text in a shard, about.
SHARD_BYTES = 8 << 20


def _byte_characters() -> str:
    """The characters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


#: Classes of bytes; the rest, white space of several bytes among them, is class 0.
SPACE, LINE_FEED, DIGIT, SIGN, APOSTROPHE, LETTER, OTHER = range(1, 8)


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[33:127] = SIGN
    for kind, (low, high) in [(DIGIT, b"09"), (LETTER, b"AZ"), (LETTER, b"az"), (OTHER, b"\xc3\xe0"), (OTHER, b"\xe4\xf4")]:
        out[low : high + 1] = kind
    out[ord(" ")], out[ord("\n")], out[ord("'")] = SPACE, LINE_FEED, APOSTROPHE
    return out


def _cuts() -> np.ndarray:
    """For classes a and b side by side, at ``8 * a + b``: 1 if a chunk may begin at the second, plus 2 if at the first."""
    out = np.zeros((8, 8), np.uint8)
    out[SPACE, DIGIT:] = 2
    out[LINE_FEED, DIGIT:] = 3
    out[[DIGIT, SIGN, APOSTROPHE, LETTER], LINE_FEED] = 1
    for kinds in ([DIGIT], [SIGN, APOSTROPHE], [LETTER]):
        for kind in kinds:
            out[kind, [k for k in (DIGIT, SIGN, APOSTROPHE, LETTER) if k not in kinds]] = 1
    out[APOSTROPHE, LETTER] = 0  # 's is one piece
    return out.ravel()


class Encoder:
    """The tokenizers library with a byte-level vocabulary, called once for each different chunk of text.

    Texts are cut where a piece of the vocabulary's pre-tokenizer always begins, so the ids of the chunks, one after
    the other, are the ids of the text: before a space and around a line feed that stand before a character other than
    white space, and between letters, digits and punctuation (not behind an apostrophe). Arrow numbers the different
    chunks of many texts; their ids are put in place by one gather. Texts with an added token are one chunk, as all
    texts are if the vocabulary's pre-tokenizer is another.

    New chunks are handed over together, a line for each. Chunks of letters, digits or punctuation alone are one piece:
    the library's model gets them in the characters of the vocabulary, cut at line feeds only, and the bytes of the
    tokens part the ids. Of the others, those that begin with one space or none and end in other than white space go
    through the whole tokenizer; a line feed before them is a piece of its own, whose id parts the ids.
    """

    #: Chunks that are one piece, and chunks that fit in a line.
    PIECE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
    LINE = re.compile(r" ?\S(?:[^\n]*\S)?")
    #: Chunks that are remembered in each of two generations, and the bytes of the longest of them.
    MOST, LONGEST = 600_000, 64
    CLASSES, CUTS = _classes(), _cuts()

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.bits = max(1, (self.library.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.dtype = np.dtype(np.uint16 if self.bits <= 16 else np.uint32)
        self.line = self._ids("\n")
        made = json.loads(self.library.to_str())
        before, model = made["pre_tokenizer"] or {}, made["model"]
        self.cutting = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and made["normalizer"] is None
        # One token for each byte at least, and tokens that say their bytes and nothing else.
        vocabulary, characters = self.library.get_vocab(with_added_tokens=False), _byte_characters()
        self.pieces = None
        if self.cutting and model["type"] == "BPE" and not model["continuing_subword_prefix"] and not model["end_of_word_suffix"] and all(c in vocabulary for c in characters):
            self.pieces = Tokenizer(self.library.model)
            self.pieces.pre_tokenizer = CharDelimiterSplit("\n")
            self.characters = characters[:10] + "\n" + characters[11:]
            self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.lengths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.seen: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _of_pieces(self, chunks: list[bytes]) -> list[bytes]:
        text = b"\n".join(chunks).decode("latin-1").translate(self.characters)
        ids = np.array(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        lengths = np.cumsum(self.lengths[ids])
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        after = np.searchsorted(lengths, ends) + 1
        if after[-1] != len(ids) or not np.array_equal(lengths[after - 1], ends):
            raise ValueError("the tokens are not the bytes of the chunks")
        raw, after = ids.tobytes(), (after * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *after[:-1]], after, strict=True)]

    def _of_lines(self, chunks: list[bytes]) -> list[bytes]:
        raw = self._ids(b"\n".join(chunks).decode())
        ends = np.flatnonzero(np.frombuffer(raw, self.dtype) == np.frombuffer(self.line, self.dtype)[0]) * self.dtype.itemsize
        begins = [0, *(ends + self.dtype.itemsize).tolist()]
        return [raw[a:b] for a, b in zip(begins, [*ends.tolist(), len(raw)], strict=True)]

    def _encoded(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """The ids of different chunks."""
        pieces = [c for c in chunks if self.PIECE.fullmatch(c)] if self.pieces else []
        out: dict[bytes, bytes] = {}
        for i in range(0, len(pieces), 8192):
            out.update(zip(pieces[i : i + 8192], self._of_pieces(pieces[i : i + 8192]), strict=True))
        rest = [c for c in chunks if c not in out]
        # A whole text may hold an added token.
        lines = [c for c in rest if len(c) <= self.LONGEST and self.LINE.fullmatch(t := c.decode()) and not any(a in t for a in self.added)] if self.cutting and len(self.line) == self.dtype.itemsize else []
        for i in range(0, len(lines), 8192):
            out.update(zip(lines[i : i + 8192], self._of_lines(lines[i : i + 8192]), strict=True))
        out.update((c, self._ids(c.decode())) for c in rest if c not in out)
        return out

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of different chunks; short ones are remembered."""
        found = list(map(self.seen.get, chunks))
        missing = [i for i, ids in enumerate(found) if ids is None]
        made = {c: ids for i in missing if (ids := self.older.get(c := chunks[i])) is not None}
        made |= self._encoded([c for i in missing if (c := chunks[i]) not in made])
        for i in missing:
            found[i] = made[chunks[i]]
        self.seen.update((c, ids) for c, ids in made.items() if len(c) <= self.LONGEST)
        if len(self.seen) > self.MOST:  # what was not met since the last time is forgotten
            self.seen, self.older = {}, self.seen
        return found

    def _begins(self, raw: np.ndarray, at: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Where the chunks begin in texts that lie end to end, text i from ``at[i]`` to ``at[i + 1]``; ``whole``: texts that are not cut."""
        kinds = self.CLASSES[raw]
        lead = np.flatnonzero(raw == 0xC3)
        lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # × and ÷
        kinds[lead] = kinds[lead + 1] = LETTER
        cut = self.CUTS[(kinds[:-1] << 3) | kinds[1:]]
        inner = at[(at > 0) & (at < len(raw))]
        cut[inner - 1] = 0
        for i in whole:
            cut[at[i] : max(at[i], at[i + 1] - 1)] = 0
        begins = np.zeros(len(raw), bool)
        begins[1:] = cut & 1
        begins[:-1] |= cut > 1
        begins[inner] = begins[0] = True
        return np.flatnonzero(begins)

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and how many each text has; nulls are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset) if n else np.zeros(1, np.int64)
        if at[0] == at[-1]:
            return np.zeros(0, self.dtype), np.zeros(n, np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        if self.cutting:
            held = np.zeros(n, bool)
            for t in self.added:
                held |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
            begins = self._begins(raw, at, np.flatnonzero(held))
        else:
            begins = np.unique(at[:-1][np.diff(at) > 0])
        chunks = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
        ends, content = (b.to_pybytes() for b in chunks.dictionary.buffers()[1:])
        ends = np.frombuffer(ends, np.int64, len(chunks.dictionary) + 1).tolist()
        made = self._learn([content[a:b] for a, b in itertools.pairwise(ends)])
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // self.dtype.itemsize
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(made), self.dtype))
        ids = lists.take(chunks.indices).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[chunks.indices.to_numpy()])])
        return ids, np.diff(ends[np.searchsorted(begins, at)])

    def encode(self, text: str) -> list[int]:
        return self.arrays(pa.array([text], pa.large_string()))[0].tolist()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def build(keys: np.ndarray, ends: np.ndarray, tokens: np.ndarray, bits: int, nulls: int = 0) -> bytes:
    """The file of a shard, whose first ``nulls`` documents have no key."""
    parts = [zlib.compress(keys.astype("<i8").tobytes() + ends.astype("<i8").tobytes() + struct.pack("<q", nulls), 1)]
    ranks, sizes = [], []
    now = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
    for level in range(bits - 1, -1, -1):
        one = (now >> now.dtype.type(level)) & now.dtype.type(1) != 0
        plane = np.packbits(one, bitorder="little").tobytes()
        blocks = [plane[i : i + BLOCK_BYTES] for i in range(0, len(plane), BLOCK_BYTES)]
        counts = [int(np.bitwise_count(np.frombuffer(b, np.uint8)).sum(dtype=np.int64)) for b in blocks]
        ranks.append(np.cumsum([0, *counts]))
        packed = [zlib.compress(b, 1) for b in blocks]
        sizes.append(np.cumsum([0, *map(len, packed)]))
        parts.append(b"".join(packed))
        now = np.concatenate([now[~one], now[one]])
    directory = np.concatenate([*ranks, *sizes]).astype("<u8").tobytes() if bits else b""
    return MAGIC + struct.pack(f"<4I{len(parts)}Q", len(keys), len(tokens), bits, len(ranks[0]), *map(len, parts)) + directory + b"".join(parts)


class WaveletMatrix:
    """An opened file: the rank directory and the document table are read at once, blocks of planes when they are asked for."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        docs, self.n, self.bits, entries = struct.unpack_from("<4I", content, 4)
        sizes = struct.unpack_from(f"<{self.bits + 1}Q", content, 20)
        at = 20 + 8 * len(sizes)
        table = np.frombuffer(content, "<u8", 2 * self.bits * entries, at).astype(np.int64).reshape(2, self.bits, entries)
        at += table.nbytes
        #: Ones before each block of each plane, and where its compressed bytes begin.
        self.before, begins = table
        self._content, starts = memoryview(content), at + np.concatenate([[0], np.cumsum(sizes[:-1])])
        self._at = begins + starts[1:, None]
        table = np.frombuffer(zlib.decompress(content[at : at + sizes[0]]), "<i8")
        self.keys, self.ends, self.nulls = table[:docs], table[docs : 2 * docs], int(table[-1])
        self._words: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def document_keys(self, begin: int = 0, end: int | None = None) -> pa.Array:
        keys = self.keys[begin:end]
        return pa.array(keys, mask=np.arange(begin, begin + len(keys)) < self.nulls)

    def _bytes(self, level: int, block: int) -> bytes:
        return zlib.decompress(self._content[self._at[level, block] : self._at[level, block + 1]])

    def _block(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit words of a block, and the ones before each of them in the block."""
        if (level, block) not in self._words:
            raw = self._bytes(level, block)
            words = np.frombuffer(raw + bytes(-len(raw) % 8 + 8), "<u8")
            self._words[level, block] = words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return self._words[level, block]

    def _zeros(self, level: int) -> int:
        return self.n - int(self.before[level, -1])

    def _ones(self, level: int, i: int) -> int:
        block, rest = divmod(i, 8 * BLOCK_BYTES)
        if block + 1 >= self.before.shape[1]:  # the end of the last block
            return int(self.before[level, -1])
        words, before = self._block(level, block)
        return int(self.before[level, block]) + int(before[rest >> 6]) + (int(words[rest >> 6]) & ((1 << (rest & 63)) - 1)).bit_count()

    def access(self, i: int) -> int:
        """The token at position i: one block of each plane is read."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.bits):
            block, rest = divmod(i, 8 * BLOCK_BYTES)
            bit, ones = int(self._block(level, block)[0][rest >> 6]) >> (rest & 63) & 1, self._ones(level, i)
            token, i = token << 1 | bit, self._zeros(level) + ones if bit else i - ones
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        for level in range(self.bits):
            a, b = self._ones(level, low), self._ones(level, high)
            zeros = self._zeros(level)
            low, high = (zeros + a, zeros + b) if token >> (self.bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, end: int | None = None) -> int:
        """How often the token occurs before position ``end``."""
        end = self.n if end is None else min(end, self.n)
        if token >> self.bits:
            return 0
        low, high = self._range(token, end)
        return high - low

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence, from 0."""
        if not 0 <= k < self.rank(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            k = i - self._zeros(level) if one else i
            ones = self.before[level]
            counts = ones if one else np.minimum(np.arange(len(ones)) * 8 * BLOCK_BYTES, self.n) - ones
            block = int(np.searchsorted(counts, k, side="right")) - 1
            k -= int(counts[block])
            words, before = self._block(level, block)
            inside = before if one else np.arange(len(before)) * 64 - before
            w = int(np.searchsorted(inside, k, side="right")) - 1
            k -= int(inside[w])
            word = int(words[w]) ^ (0 if one else 2**64 - 1)
            for _ in range(k):
                word &= word - 1
            i = block * 8 * BLOCK_BYTES + w * 64 + (word & -word).bit_length() - 1
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token))]

    def tokens(self) -> np.ndarray:
        """All tokens in order: the planes are undone from the lowest."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            plane = np.frombuffer(b"".join(self._bytes(level, b) for b in range(self.before.shape[1] - 1)), np.uint8)
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            up = np.empty_like(now)
            zeros = self.n - int(np.count_nonzero(one))
            up[~one] = now[:zeros]
            up[one] = now[zeros:] | now.dtype.type(1 << (self.bits - 1 - level))
            now = up
        return now


def write_shards(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode all texts and write files in order of the key. Returns the manifest: (file, shard, n_docs, n_tokens, start).

    vocabulary: a file of the tokenizers library that each executor can open. ``start`` counts the tokens of all shards before.
    """
    make_folder(path)
    size = docs.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // (4 * shard_bytes)))
    ranged = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(parts, F.col("k").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        part, number, held = None, 0, 0
        keys: list[pa.Array] = []
        made: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush():
            nonlocal keys, made, counts, held, number
            name = f"{path}/part-{part:05d}-{number:05d}.wvm"
            ids, ends = pa.chunked_array(keys, pa.int64()), np.cumsum(np.concatenate(counts))
            # Documents without a key come first.
            write_file(name, build(ids.fill_null(0).to_numpy(), ends, np.concatenate(made), e.bits, ids.null_count))
            row = pa.record_batch([pa.array([name]), pa.array([part * 100_000 + number]), pa.array([len(ids)]), pa.array([int(ends[-1])])], names=["file", "shard", "n_docs", "n_tokens"])
            keys, made, counts, held, number = [], [], [], 0, number + 1
            return row

        for b in batches:
            part = b.column(2)[0].as_py() if part is None and b.num_rows else part
            sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(), dtype=np.int64)])
            i = 0
            while i < b.num_rows:
                # The rows that fill the shard, the one that reaches its size among them.
                j = min(b.num_rows, max(i + 1, int(np.searchsorted(sizes, sizes[i] + shard_bytes - held))))
                ids, n = e.arrays(b.column(1).slice(i, j - i))
                keys.append(b.column(0).slice(i, j - i))
                made.append(np.insert(ids, np.cumsum(n), e.dtype.type(end_id)))
                counts.append(n + 1)
                held += int(sizes[j] - sizes[i])
                i = j
                if held >= shard_bytes:
                    yield flush()
        if keys:
            yield flush()

    rows = ranged.select("k", "t", F.spark_partition_id().alias("p")).mapInArrow(run, "file string, shard long, n_docs long, n_tokens long")
    manifest = materialize(rows, "wavelet-manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row for each shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, tokens array<int>) of each document, read from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = WaveletMatrix(read_file(file))
                ids = m.tokens().astype(np.int32)
                begins = np.concatenate([[0], m.ends[:-1]])
                for i in range(0, len(m.keys), 512):
                    a, b = int(begins[i]), int(m.ends[i : i + 512][-1])
                    offsets = np.concatenate([begins[i : i + 512], [b]]) - a
                    keys = m.document_keys(i, i + 512)
                    yield pa.record_batch([keys, pa.array(start + begins[i : i + 512]), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids[a:b]))], names=[key, "start", "n_tokens", "tokens"])

    files = manifest.select("file", "start")
    n = max(1, files.count())
    return files.repartition(min(n, 10_000), "file").mapInArrow(run, f"`{key}` long, start long, n_tokens long, tokens array<int>")


def checksums(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32): crc32 of the ids as little-endian unsigned 32-bit integers, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = WaveletMatrix(read_file(file))
                raw = memoryview(m.tokens().astype("<u4").tobytes())
                begins = np.concatenate([[0], m.ends[:-1]])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), m.ends.tolist(), strict=True)]
                yield pa.record_batch([m.document_keys(), pa.array(start + begins), pa.array(m.ends - begins), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "start")
    n = max(1, files.count())
    return files.repartition(min(n, 10_000), "file").mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def write_new(docs: DataFrame, vocabulary: str, **more) -> DataFrame:
    """write_shards() into a new folder of the shared one."""
    return write_shards(docs, fresh_path(docs.sparkSession, "wavelet"), vocabulary, **more)
