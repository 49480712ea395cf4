"""Markdown-aware chunking (RAG1-RAG7, STR3, WN3, AG20-21): a small kernel for one text, run over Arrow batches.

The kernel is a scanner whose state (headings, fences, what was merged before) runs through the text, so
it can't be said in column expressions; everything around it can. A text is read in one piece and its
chunks are independent of other texts.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import english_path

VERSION = "structure-1"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:larkspur:chunks")
# What begins a heading, a fence, a table and a list, and what ends a sentence, decides the chunks.
_HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+(.*)$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_RULER = re.compile(r"\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$")
_ITEM = re.compile(r" {0,3}(?:[-*+]|\d+[.)])[ \t]")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+")


@dataclass(frozen=True)
class Options:
    size: int = 1000
    overlap: int = 200
    least: int = 120
    most_code: int = 4000

    def __post_init__(self):
        if not 0 <= self.overlap < self.size or self.least < 0 or self.most_code < self.size:
            raise ValueError("0 <= overlap < size <= most_code, least >= 0")


@dataclass(frozen=True)
class Block:
    kind: str
    start: int
    end: int
    path: tuple[str, ...]
    section: int
    text: str | None = None  # set where the content is not the source slice
    flags: dict = field(default_factory=dict, hash=False)


def _title(found: re.Match[str] | None) -> str:
    """A heading's text, without the marks that close it."""
    return found[2].rstrip(" \t").rstrip("#").strip(" \t") if found else ""


def _lines(text: str) -> list[tuple[int, str]]:
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        out.append((at, line))
        at += len(line)
    return out


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    piece = text[start:end]
    lead = len(piece) - len(piece.lstrip())
    return (start + lead, start + lead + len(piece.strip())) if piece.strip() else (start, start)


class _Scanner:
    def __init__(self, text: str):
        self.text, self.lines = text, _lines(text)
        self.stack: list[tuple[int, str]] = []
        self.section = 0

    def _bare(self, i: int) -> str:
        return self.lines[i][1].rstrip("\r\n\v\f\x1c\x1d\x1e\x85  ") if i < len(self.lines) else ""

    def _table(self, i: int) -> bool:
        return "|" in self._bare(i) and i + 1 < len(self.lines) and bool(_RULER.match(self._bare(i + 1).strip()))

    def _starts(self, i: int) -> str | None:
        line = self._bare(i)
        if not line.strip():
            return "blank"
        if _FENCE.match(line):
            return "fence"
        if _title(_HEADING.match(line)):
            return "heading"
        if self._table(i):
            return "table"
        return "list" if _ITEM.match(line) else None

    def _block(self, kind: str, i: int, j: int, **more) -> Block | None:
        end = self.lines[j - 1][0] + len(self.lines[j - 1][1])
        a, b = _trimmed(self.text, self.lines[i][0], end)
        return Block(kind, a, b, tuple(t for _, t in self.stack), self.section, **more) if b > a else None

    def blocks(self) -> Iterator[Block]:
        i, n = 0, len(self.lines)
        while i < n:
            kind, j = self._starts(i), i + 1
            if kind == "blank":
                i = j
                continue
            if kind == "fence":
                mark = _FENCE.match(self._bare(i))[1]
                closing = re.compile(r" {0,3}" + re.escape(mark[0]) + "{" + str(len(mark)) + r",}\s*$")
                while j < n and not closing.match(self._bare(j)):
                    j += 1
                if j < n:
                    made = self._block("code", i, j + 1)
                    i = j + 1
                else:
                    made = self._block("code", i, n)
                    body = self.text[made.start : made.end]
                    made = replace(made, text=f"{body}\n{mark}", flags={"malformed_fence": True, "synthetic_closing_fence": True, "rendered_content_differs": True})
                    i = n
                yield made
                continue
            if kind == "heading":
                found = _HEADING.match(self._bare(i))
                level = len(found[1])
                self.stack = [s for s in self.stack if s[0] < level] + [(level, _title(found))]
                self.section = self.lines[i][0]
            elif kind == "table":
                while j < n and "|" in self._bare(j):
                    j += 1
            elif kind == "list":
                while j < n and (self._starts(j) == "list" or (self._starts(j) is None and self._bare(j)[:1] in (" ", "\t"))):
                    j += 1
            else:
                while j < n and self._starts(j) is None:
                    j += 1
            if made := self._block(kind or "prose", i, j):
                yield made
            i = j


def _packed(parts: list[str], most: int) -> list[str]:
    """Parts put together up to a length; a longer part is cut."""
    out, now = [], ""
    for p in (q[k : k + most] for q in parts for k in range(0, max(1, len(q)), most)):
        if now and len(now) + len(p) > most:
            out.append(now)
            now = ""
        now += p
    return [*out, now] if now else out


def _placed(text: str, b: Block, pieces: list[str], reason: str) -> list[Block]:
    """Pieces found in the block, from left to right."""
    out, at = [], b.start
    for p in pieces:
        bare = p.strip()
        if bare and (found := text.find(bare, at, b.end)) >= 0:
            out.append(replace(b, start=found, end=found + len(bare), flags={**b.flags, "split_reason": reason}))
            at = found + len(bare)
    return out


def _characters(text: str, b: Block, o: Options) -> list[Block]:
    out, at = [], b.start
    while at < b.end:
        s, e = _trimmed(text, at, min(b.end, at + o.size))
        if e > s:
            out.append(replace(b, start=s, end=e, flags={**b.flags, "split_reason": "characters"}))
        if at + o.size >= b.end:
            break
        at += o.size - o.overlap
    return out


def _split(text: str, b: Block, o: Options) -> list[Block]:
    body = b.text if b.text is not None else text[b.start : b.end]
    if len(body) <= o.size:
        return [b]
    if b.kind == "code":
        if len(body) <= o.most_code:
            return [replace(b, flags={**b.flags, "oversized_code": True, "allowed_oversized_code": True})]
        rows = body.split("\n")
        mark = _FENCE.match(rows[0])[1] if _FENCE.match(rows[0]) else "```"
        inner = [r + "\n" for r in rows[1:-1]]
        pieces = _packed(inner, max(1, o.size - (len(rows[0]) + len(mark) + 2)))
        flags = {**b.flags, "oversized_code": True, "rendered_content_differs": True, "split_reason": "code_lines"}
        return [replace(b, text=f"{rows[0]}\n{p.rstrip(chr(10))}\n{mark}", flags=flags) for p in pieces]
    if b.kind == "table":
        rows = body.splitlines()
        head = "\n".join(rows[:2])
        pieces = _packed([r + "\n" for r in rows[2:]], max(1, o.size - len(head) - 1))
        return [replace(b, text=f"{head}\n{p.rstrip(chr(10))}", flags={"rendered_content_differs": True, "split_reason": "table_rows"}) for p in pieces]
    if b.kind == "list":
        return _placed(text, b, _packed(body.splitlines(keepends=True), o.size), "list_items")
    if b.kind == "prose":
        cuts = [0, *(m.end() for m in _SENTENCE.finditer(body)), len(body)]
        parts = [body[x:y] for x, y in zip(cuts, cuts[1:], strict=False) if y > x]
        if len(parts) > 1:
            return _placed(text, b, _packed(parts, o.size), "sentences")
        tokens = re.findall(r"\S+\s*", body)
        if all(len(t.strip()) <= o.size for t in tokens):
            return _placed(text, b, _packed(tokens, o.size), "whitespace")
    return _characters(text, b, o)


@dataclass(frozen=True)
class Draft:
    kind: str
    start: int
    end: int
    path: tuple[str, ...]
    section: int
    content: str
    synthetic: bool
    flags: dict = field(default_factory=dict, hash=False)


def _assemble(text: str, blocks: list[Block], o: Options) -> list[Draft]:
    out: list[Draft] = []
    run: list[Block] = []

    def close():
        if run:
            kinds = [b.kind for b in run if b.kind != "heading"]
            flags = {k: v for b in run for k, v in b.flags.items()}
            only = run[0] if run[0].text is not None else None
            out.append(Draft(kinds[0] if kinds else "prose", run[0].start, run[-1].end, run[-1].path, run[-1].section, only.text if only else text[run[0].start : run[-1].end], only is not None, flags))
            run.clear()

    for b in blocks:
        kinds = {x.kind for x in [*run, b]} - {"heading"}
        fits = run and b.text is None and run[-1].text is None and (b.path, b.section) == (run[-1].path, run[-1].section) and len(kinds) <= 1 and len(text[run[0].start : b.end].strip()) <= o.size
        if not fits:
            close()
        run.append(b)
    close()
    return out


def _merge_tiny(text: str, drafts: list[Draft], o: Options) -> list[Draft]:
    threshold = min(o.least, o.size)
    sizes: dict[tuple, int] = {}
    for d in drafts:
        sizes[d.path, d.section] = sizes.get((d.path, d.section), 0) + 1
    small = lambda d: len(d.content) < threshold and d.kind not in ("code", "table") and sizes[d.path, d.section] > 1

    def joined(a: Draft, b: Draft) -> Draft | None:
        if (a.path, a.section) != (b.path, b.section) or a.synthetic or b.synthetic:
            return None
        start, end = min(a.start, b.start), max(a.end, b.end)
        content = text[start:end]
        if len(content.strip()) > o.size:
            return None
        return Draft(a.kind if a.kind == b.kind else "mixed", start, end, a.path, a.section, content, False, {**a.flags, **b.flags, "tiny_chunk_merged": True})

    out: list[Draft] = []
    i = 0
    while i < len(drafts):
        d = drafts[i]
        if threshold and small(d):
            if out and (both := joined(out[-1], d)):
                out[-1] = both
                i += 1
                continue
            if i + 1 < len(drafts) and (both := joined(d, drafts[i + 1])):
                out.append(both)
                i += 2
                continue
        out.append(d)
        i += 1
    return out


def chunk_id(document: str, digest: str, path: tuple[str, ...], occurrence: int) -> str:
    """STR3: from the canonical JSON of what makes the chunk itself."""
    name = json.dumps({"document": document, "content_hash": digest, "heading_path": list(path), "occurrence": occurrence, "version": VERSION}, sort_keys=True, separators=(",", ":"))
    return str(uuid.uuid5(NAMESPACE, name))


def chunk_text(document: str, text: str | None, o: Options) -> list[dict]:
    """All chunks of a text, in order."""
    text = re.sub(r"\r\n?", "\n", text or "")
    blocks = [p for b in _Scanner(text).blocks() for p in _split(text, b, o)]
    out, seen = [], {}
    for i, d in enumerate(_merge_tiny(text, _assemble(text, blocks, o), o)):
        digest = hashlib.sha256(d.content.encode()).hexdigest()
        n = seen[digest, d.path] = seen.get((digest, d.path), -1) + 1
        out.append(
            {
                "chunk_id": chunk_id(document, digest, d.path, n), "chunk_index": i, "content": d.content, "content_hash": digest, "char_start": d.start, "char_end": d.end, "heading_path": list(d.path),
                "section_heading": d.path[-1] if d.path else None, "chunk_type": d.kind, "occurrence": n, "chunker_version": VERSION, "metadata": [(k, json.dumps(v) if not isinstance(v, str) else v) for k, v in sorted(d.flags.items())],
            }
        )
    return out


_FIELDS = [
    ("chunk_id", pa.string()), ("chunk_index", pa.int32()), ("content", pa.string()), ("content_hash", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("heading_path", pa.list_(pa.string())), ("section_heading", pa.string()), ("chunk_type", pa.string()),
    ("occurrence", pa.int32()), ("chunker_version", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())),
]
_DDL = "chunk_id string, chunk_index int, content string, content_hash string, char_start int, char_end int, heading_path array<string>, section_heading string, chunk_type string, occurrence int, chunker_version string, metadata map<string,string>"


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text", options: Options | None = None) -> DataFrame:
    """RAG1, RAG5: (document_id, chunk fields) of each document."""
    o = options or Options()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i, (k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True), 1):
                made = chunk_text(str(k), t.as_py(), o)
                ids += [k] * len(made)
                rows += made
                if len(rows) < 500 and i < b.num_rows:
                    continue
                yield pa.record_batch([pa.array(ids, b.schema.field(0).type), *(pa.array([r[n] for r in rows], kind) for n, kind in _FIELDS)], names=["document_id", *(n for n, _ in _FIELDS)])
                ids, rows = [], []

    return docs.select(key, text).mapInArrow(run, f"document_id {docs.schema[key].dataType.simpleString()}, {_DDL}")


def prepared(docs: DataFrame, path: str, text: str) -> DataFrame:
    """RAG7: the outcome of each file before chunking: non_english, empty or prepared."""
    return docs.withColumn("status", F.when(~english_path(F.col(path)), "skipped_non_english").when(F.trim(F.coalesce(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(""))) == "", "skipped_empty").otherwise("prepared"))


def summary(outcomes: DataFrame) -> DataFrame:
    """AG14."""
    s = F.col("status")
    return outcomes.agg(F.count("*").alias("discovered"), *[F.count_if(s == k).alias(k) for k in ("prepared", "skipped_non_english", "skipped_empty")])


def hash_embedder(dimensions: int) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder for tests: hashed words, unit length."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimensions
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                v[h % dimensions] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    return run
