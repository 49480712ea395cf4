"""BPE encoding by backtracking over longest token matches, and decoding by an offset table.

A piece is scanned once by an Aho-Corasick automaton of all tokens; the longest match at each place
is tried first. Two neighbours are kept only if the pair-compatibility table says that merging their
joined text would give just these two; else the next shorter token is tried, and a place from which
nothing works is never tried again. The one sequence whose neighbours are all compatible is what the
merges give, so the result is exact in time linear in the piece.

Compatibility of (l, r) is found by undoing merges: of the two tokens at the border, the one merged
later is taken apart, and if a merge across the border had come before it, the pair is incompatible.

Defined results: a null or empty text has no tokens and decodes to an empty text; null ids and
repeated rows are rows like any other; an empty table gives an empty result; columns other than key
and text are ignored, so their names can't clash. Texts are encoded whole.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.pieces import byte_alphabet, words

#: Entries after which the tables of seen pieces and pairs start anew.
SEEN_PIECES, SEEN_PAIRS = 600_000, 2_000_000
#: Added to a character's code point when the word ends with it.
_ENDS = 0x10000
#: Documents in one returned batch.
_FLUSH = 256


class Vocabulary:
    """A vocabulary file of the kind "BPE with word ends": tokens, merges and what encoding and decoding need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"]
        names: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.id_of = {self._symbols(t): i for t, i in names.items()}
        self.text_of = {i: t for t, i in self.id_of.items()}
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.rank = dict.fromkeys(self.text_of, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left, right = names[a], names[b]
            made = names[a + b]
            self.merge_rank[left, right] = r
            if made not in self.parts:
                self.parts[made], self.rank[made] = (left, right), r
        self.pairs: dict[int, bool] = {}
        usable = {i for i in self.text_of if i not in self.parts or self.compatible(*self.parts[i], self.rank[i])}
        # A token whose parts are never left as they are by the merges can't come out of them.
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(self.text_of[i], (i, len(self.text_of[i])))
        self.automaton.make_automaton()
        self.usable = usable
        self.shorter: dict[int, int | None] = {}
        self.bytes_to_symbols = {b: c for b, c in enumerate(byte_alphabet())}
        self.seen = _Seen(self)
        everything = names | self.special
        table = [b""] * (max(everything.values()) + 1)
        for t, i in everything.items():
            table[i] = t.encode() + b" "
        #: Decoding: token i is blob[offsets[i]:offsets[i + 1]], with the space that follows it.
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(table), np.uint8)

    def _symbols(self, token: str) -> str:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + _ENDS)
        return token

    def compatible(self, left: int, right: int, limit: int | None = None) -> bool:
        """Whether merging the joined text leaves these two tokens side by side (before the merge ``limit``, if given)."""
        before = len(self.merge_rank) if limit is None else limit
        while True:
            if self.merge_rank.get((left, right), before) < before:
                return False
            if self.rank[left] > self.rank[right]:
                # The left one was merged later (of equal ones, the left comes first): undo it.
                before, left = self.rank[left], self.parts[left][1]
            elif self.rank[right] >= 0:
                before, right = self.rank[right] + 1, self.parts[right][0]
            else:
                return True

    def pair(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= SEEN_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.compatible(left, right)
        return known

    def next_shorter(self, token: int) -> int | None:
        """The longest other token that this one starts with."""
        if token not in self.shorter:
            text = self.text_of[token]
            cuts = (self.id_of.get(text[:n]) for n in range(len(text) - 1, 0, -1))
            self.shorter[token] = next((i for i in cuts if i in self.usable), None)
        return self.shorter[token]

    def encode_symbols(self, text: str) -> list[int]:
        n = len(text)
        longest: list[int | None] = [None] * n
        reach = [0] * n
        for end, (token, size) in self.automaton.iter(text):
            start = end - size + 1
            if size > reach[start]:
                longest[start], reach[start] = token, size
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while token is not None:
            end = at + len(self.text_of[token])
            if end not in dead and (not out or self.pair(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            token = self.next_shorter(token)
            if token is None:
                dead.add(at)
                token = out.pop()
                at -= len(self.text_of[token])
        raise ValueError("a symbol is not in the vocabulary")

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, as the tokenizers library gives them without added special tokens."""
        if not text:
            return np.empty(0, np.uint32)
        out: list[bytes] = []
        for i, part in enumerate(self.special_split.split(text)):
            if i % 2:
                out.append(np.uint32(self.special[part]).tobytes())
            elif part:
                out.extend(map(self.seen.__getitem__, words(normalize(part))))
        return np.frombuffer(b"".join(out), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """Token texts with a space between, special tokens included."""
        if not len(ids):
            return ""
        starts = self.offsets[ids]
        sizes = self.offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self.blob[at[:-1]].tobytes().decode()


class _Seen(dict):
    """Ids of pieces, as bytes; encodes a piece when it is first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= SEEN_PIECES:
            self.clear()
        symbols = piece.encode().decode("latin-1").translate(self.vocabulary.bytes_to_symbols)
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + _ENDS)
        made = self[piece] = np.array(self.vocabulary.encode_symbols(symbols), np.uint32).tobytes()
        return made


def normalize(text: str) -> str:
    """Composed, in lower case character by character (a final sigma is like any other); white space is left to the pieces."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker and file."""
    return Vocabulary(path)


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded string): ids of each whole text, and the text decoded from these ids.

    path: a vocabulary file that each executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for at in range(0, whole.num_rows, _FLUSH):
                b = whole.slice(at, _FLUSH)
                ids = [v.encode(t.as_py() or "") for t in b.column(1)]
                decoded = [v.decode(i) for i in ids]
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32))
                yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(decoded, pa.string())], names=[key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")
