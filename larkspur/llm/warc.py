"""WARC archives with a globally ordered capture index.

1. Pages are grouped by payload digest (SHA-1); the record with the largest id of a group is the
   response, the others are revisits of it. Grouping counts before it shuffles, so a payload that a
   third of all pages share is one row for each task. Groups of two and more are joined to the pages by
   broadcast, the largest first, up to a checked number. If there are more, the rest is joined by a shuffle in which
   the payloads of all pages travel once.
2. Each task writes gzip members, one for each record, into archive files, and with each file a run of
   its index, sorted by URL key and timestamp.
3. The runs are cut at common bounds (range partitioning); in each range the pieces of all runs are
   merged by a loser tree. The result is ordered inside and across partitions, so the captures of one
   URL stand together in time order.
4. Records are read by the index alone, in its order: file, place and length of each entry. A task
   checks that order, and that each record is the one its entry names.

URL key: host labels reversed and joined by commas, without ``www.``, then ``)`` and the path and query
in lower case; the scheme, the fragment and a default port are dropped.

Defined results: a null payload is empty; payloads shorter than ``least_bytes`` are always responses; a
null URL has the key ``)/``; repeated rows of the largest id are each a response; an empty table gives no files and no rows; extra columns are ignored, so their names can't
clash. A null id is never the largest: rows without an id revisit the others, or are responses where no row has one.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import BROADCAST_ROWS, fresh_path, materialize
from larkspur.llm.files import make_folder, read_file, write_file

INDEX = "urlkey string, ts string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, file string, at long, length long"
_INDEX_SCHEMA = pa.schema([("urlkey", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64())])
#: Entries of a part of the merged index, and compressed bytes of their records.
PART_ROWS, PART_BYTES = 50_000, 8 << 20
#: Compressed bytes after which a new archive file begins.
FILE_BYTES = 32 << 20
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def url_key(url: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), r"^(?:[^@]*@)?(?:www\.)?", ""), r":(?:80|443)?$", "")
    path = F.regexp_replace(F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)))


def record(kind: str, page_id: int | None, url: str | None, ts: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>",
        f"WARC-Date: {ts}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", *([] if refers_to is None else [f"X-Refers-To-Page: {refers_to}"])]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if kind == "response" else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one uncompressed record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def timestamp(page_id: int | None) -> str:
    """Pages have no capture time: a second for each id from a fixed time on."""
    return (EPOCH + datetime.timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, file_bytes: int = FILE_BYTES, most_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """Write archive files and return their index runs (INDEX), each file's rows sorted by URL key, timestamp and id."""
    make_folder(path)
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("u"), url_key(F.col(url)).alias("urlkey"), body.alias("body"), F.sha1(body).alias("digest"))
    prints = pages.select(F.col(key).cast("long").alias("id"), F.sha1(body).alias("digest"), F.octet_length(body).alias("n"))
    groups = materialize(prints.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.count("*").alias("m"), F.max("id").alias("last")).where("m > 1"), "warc-groups")
    if groups.count() <= most_broadcast:
        marked = rows.join(F.broadcast(groups), "digest", "left")
    else:
        largest = materialize(groups.orderBy(F.desc("m"), "digest").limit(most_broadcast), "warc-largest")
        others = groups.join(largest, "digest", "left_anti").select("digest", F.col("last").alias("also"))
        marked = rows.join(F.broadcast(largest), "digest", "left").join(others, "digest", "left").withColumn("last", F.coalesce("last", "also"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[bytes] = []
        index: list[tuple] = []
        at = 0
        name = ""

        def flush():
            nonlocal made, index, at, name
            write_file(name, b"".join(made))
            index.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
            out = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True), _INDEX_SCHEMA, strict=True)], schema=_INDEX_SCHEMA)
            made, index, at, name = [], [], 0, ""
            return out

        for b in batches:
            for entry in zip(*(b.column(c) for c in ("id", "u", "urlkey", "body", "last")), strict=True):
                i, u, key_, data, last = entry[0].as_py(), entry[1].as_py(), entry[2].as_py(), entry[3].as_buffer().to_pybytes(), entry[4].as_py()
                raw = hashlib.sha1(data)
                digest, ts = base64.b32encode(raw.digest()).decode(), timestamp(i)
                first = last is None or i == last
                kind = "response" if first else "revisit"
                refers = None if first else last
                member = gzip.compress(record(kind, i, u, ts, data, digest, refers), 1, mtime=0)
                name = name or f"{path}/{uuid.uuid4().hex}.warc.gz"
                index.append((key_, ts, i, kind, digest, len(data), refers, name, at, len(member)))
                made.append(member)
                at += len(member)
                if at >= file_bytes:
                    yield flush()
        if index:
            yield flush()

    return materialize(marked.select("id", "u", "urlkey", "body", "last").mapInArrow(run, INDEX), "warc-runs")


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, so a step costs one comparison a level."""

    def __init__(self, runs: list[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            held = self.tree[node]
            if held == -1:
                self.tree[node] = winner
                return
            if self._beats(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            winner, node = w, (w + self.k) // 2
            while node > 0:
                if self._beats(self.tree[node], winner):
                    self.tree[node], winner = winner, self.tree[node]
                node //= 2
            self.tree[0] = winner


def merge_index(runs: DataFrame, parts: int | None = None) -> DataFrame:
    """One index in order of (URL key, timestamp, id), over all partitions; ``part`` numbers them."""
    size = runs.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
    n = parts or max(1, -(-size["n"] // PART_ROWS), -(-size["b"] // PART_BYTES))
    ranged = runs.repartitionByRange(n, F.col("urlkey"), F.col("ts"), F.col("page_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[list[tuple]]] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                entry = (row[0], row[1], row[2] is not None, row[2] or 0, row[8], row)
                own = pieces.setdefault(row[7], [[]])
                if own[-1] and own[-1][-1] > entry:  # a piece that came in another order is a run of its own
                    own.append([])
                own[-1].append(entry)
        out: list[tuple] = []
        make = lambda: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _INDEX_SCHEMA, strict=True)], schema=_INDEX_SCHEMA)
        for entry in LoserTree([p for own in pieces.values() for p in own]):
            out.append(entry[-1])
            if len(out) >= 20_000:
                yield make()
                out = []
        if out:
            yield make()

    return ranged.mapInArrow(run, INDEX).withColumn("part", F.spark_partition_id())


#: Bytes between two records of a file up to which one read takes both.
GAP_BYTES = 256 << 10
#: Index entries that a task looks at together, and compressed bytes that it holds at most, about.
LOOK_AHEAD, HELD_BYTES = 5000, 32 << 20


def _fetch(entries: list[tuple[str, int, int]]) -> list[bytes]:
    """The bytes of each (file, at, length), with one read for neighbours in a file."""
    out: list[bytes] = [b""] * len(entries)
    order = sorted(range(len(entries)), key=entries.__getitem__)
    i = 0
    while i < len(order):
        file, begin, length = entries[order[i]]
        end, j = begin + length, i + 1
        while j < len(order) and entries[order[j]][0] == file and entries[order[j]][1] <= end + GAP_BYTES:
            end, j = max(end, sum(entries[order[j]][1:])), j + 1
        content = read_file(file, begin, end - begin)
        for k in order[i:j]:
            _, at, size = entries[k]
            out[k] = content[at - begin : at - begin + size]
        i = j
    return out


def read_archives(index: DataFrame) -> DataFrame:
    """The records that a merged index names, read back by file, place and length, in its order.

    page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload (null for revisits). An index out of order in
    a part, or an entry that names another record than is there, is an error.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    schema = pa.schema(fields)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        now, held = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                now.append(row)
                held += row[-1]
                if held > HELD_BYTES or len(now) >= LOOK_AHEAD:
                    yield now
                    now, held = [], 0
        if now:
            yield now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for rows in steps(batches):
            out, size = [], 0
            for (part, key, ts, page, digest, file, at, _), raw in zip(rows, _fetch([r[5:] for r in rows]), strict=True):
                place = (key, ts, page is not None, page or 0)
                if part != now:  # a task may read several parts, in any order
                    now, last = part, None
                if last is not None and place < last:
                    raise ValueError(f"the index is out of order at {place}")
                last = place
                headers, payload = parse(gzip.decompress(raw))
                number = lambda k: int(headers[k]) if k in headers else None  # noqa: E731, B023
                kind = headers["warc-type"]
                told = headers["warc-payload-digest"].removeprefix("sha1:")
                if (number("x-page-id"), told) != (page, digest) or (kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != told):
                    raise ValueError(f"another or a damaged record in {file} at {at}")
                out.append((page, headers["warc-target-uri"], kind, told, number("x-payload-length"), number("x-refers-to-page"), payload if kind == "response" else None))
                size += len(payload)
                if size > 4 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], schema=schema)

    wanted = index.select("part", "urlkey", "ts", "page_id", "payload_digest", "file", "at", "length")
    return wanted.mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def write_new(pages: DataFrame, **more) -> DataFrame:
    """write_archives() into a new folder of the shared one, with the runs merged; written, so that it can be read many times."""
    return materialize(merge_index(write_archives(pages, fresh_path(pages.sparkSession, "warc"), **more)), "warc-index")

