"""SimHash near-duplicates by tiled exact comparison.

1. Each text gets a fingerprint (64 bits for each lane): a bit is 1 if it is set in over half of the
   XXH64 values of the text's word shingles, repeats included.
2. Equal fingerprints are collapsed by a grouping, so copies cost nothing from here on.
3. The different fingerprints are range-partitioned by population count and cut into tiles; pairs of
   tiles whose population counts can't come within the radius are never made. What remains is
   compared in full by numpy: exclusive-or, then bit counts. Inside a tile pair, blocks are skipped
   by the population counts of the four quarters of the fingerprint.
4. A tile pair gives back a spanning forest of its links, never all links of a dense group; Spark
   joins the forests into components by alternating large-star and small-star steps, each of which
   is written to the shared folder. Nodes are ordered by their smallest id, so the smallest node of a
   component names it.

near_copies() takes links of a wider radius only as candidates: texts are compared by their sets of
shingles inside each group that the candidates join, in pairs of blocks, and the links that hold are joined anew.

The comparison of fingerprints is exact for the radius and, with several lanes, the screen of the first lane. Its
work grows with the square of the number of *different* fingerprints. The tile size grows with that number, so a
fingerprint is sent to at most TILES + 1 tasks up to TILES * TILE_MAX fingerprints.

Defined results: a null or empty text has no words and the fingerprint zero, linked like any other;
a text with fewer words than a shingle is one shingle; repeated rows and null ids are rows like any
other (a component's id is its smallest id, null only if all are null); an empty table gives an
empty result; columns other than id and text are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import few, materialize, shared_dir

#: Rows compared at once: a block of the left tile against a whole right tile.
BLOCK = 256
#: Fingerprints in a tile, and the number of tiles aimed at between these bounds.
TILE_MIN, TILE_MAX, TILES = 16_384, 1 << 20, 64
#: Sets, and bytes of their hashes, in a block of a group of candidates.
GROUP_ROWS, GROUP_BYTES = 2048, 24 << 20
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle of the text, A-Z in lower case; the whole sequence if it has fewer words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(line, 42)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.array([h(line[a : b - 1], 42) for a, b in zip(starts, ends[k - 1 :])], np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """Big-endian majority bits; more lanes take more bits from mixed copies of the hashes."""
    out = []
    for lane in range(lanes):
        h = hashes
        if lane:
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * lane)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(32))
        octets = h.astype(">u8").view(np.uint8).reshape(-1, 8)
        if len(h) < 64:
            counts = np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
        else:
            counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
        out.append(np.packbits(2 * counts > len(h)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 3, lanes: int = 1) -> DataFrame:
    """(key, fp): fp is binary, 8 bytes for each lane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), shingle_words), lanes) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.binary())], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp binary")


def _population(c):
    """Bits set in the first 8 bytes."""
    return F.bit_count(F.conv(F.hex(F.substring(c, 1, 4)), 16, 10).cast("long")) + F.bit_count(F.conv(F.hex(F.substring(c, 5, 4)), 16, 10).cast("long"))


def _quarters(words: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters of the first lane."""
    first = words[:, 0]
    return np.stack([np.bitwise_count((first >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (48, 32, 16, 0)], axis=1).astype(np.int16)


def _words(blob: bytes, lanes: int) -> np.ndarray:
    return np.frombuffer(blob, ">u8").astype(np.uint64).reshape(-1, lanes)


def _tiles(distinct: DataFrame, lanes: int, tile: int, parts: int) -> DataFrame:
    """(tile, lo, hi, fps): fingerprints in order of population count, ``tile`` in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [v for b in batches for v in b.column(0).to_pylist()]
        if not got:
            return
        words = _words(b"".join(got), lanes)
        q = _quarters(words)
        order = np.lexsort((words[:, 0], q[:, 2], q[:, 1], q[:, 0], q.sum(axis=1)))
        words, pop = words[order], q.sum(axis=1)[order]
        for i in range(0, len(words), tile):
            part = words[i : i + tile]
            blob = part.astype(">u8").tobytes()
            yield pa.record_batch([pa.array([xxhash.xxh64_intdigest(blob) >> 1]), pa.array([int(pop[i])], pa.int32()), pa.array([int(pop[i : i + tile][-1])], pa.int32()), pa.array([blob], pa.binary())], names=["tile", "lo", "hi", "fps"])

    ranged = distinct.select("fp", _population("fp").alias("pop")).repartitionByRange(parts, "pop", "fp")
    return ranged.select("fp").mapInArrow(run, "tile long, lo int, hi int, fps binary")


class _Forest:
    """Links between the rows of one or two tiles, kept as a label for each row."""

    def __init__(self, label: np.ndarray):
        self.label = label

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        differ = a != b
        if not differ.any():
            return
        pairs = np.unique(np.stack([np.minimum(a, b)[differ], np.maximum(a, b)[differ]], axis=1), axis=0)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        to = np.arange(len(self.label))
        for x in up:
            to[x] = root(x)
        self.label = to[self.label]


def compare(left: np.ndarray, right: np.ndarray, radius: int, screen: int, same: bool, label: np.ndarray | None = None) -> np.ndarray:
    """Labels of the rows of left and then right: equal for rows that links of at most ``radius`` bits join, or that had equal labels before."""
    n = len(left)
    forest = _Forest(np.arange(n + (0 if same else len(right))) if label is None else label)
    ql, qr = _quarters(left), _quarters(right)
    starts = range(0, len(right), BLOCK)
    boxes = [(qr[s : s + BLOCK].min(axis=0), qr[s : s + BLOCK].max(axis=0)) for s in starts]
    low, high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
    for i in range(0, n, BLOCK):
        lo, hi = ql[i : i + BLOCK].min(axis=0), ql[i : i + BLOCK].max(axis=0)
        gap = np.maximum(0, np.maximum(low - hi, lo - high)).sum(axis=1)
        for k in np.flatnonzero(gap <= screen).tolist():
            j = k * BLOCK
            if same and j < i:
                continue
            a, b = left[i : i + BLOCK], right[j : j + BLOCK]
            near = np.bitwise_count(a[:, :1] ^ b[:, 0][None, :]) <= screen
            x, y = np.nonzero(near)
            if left.shape[1] > 1 and len(x):
                ok = np.bitwise_count(a[x] ^ b[y]).sum(axis=1, dtype=np.int64) <= radius
                x, y = x[ok], y[ok]
            if len(x):
                forest.link(x + i, y + j + (0 if same else n))
    return forest.label


def links(distinct: DataFrame, radius: int, lanes: int = 1, screen: int | None = None) -> DataFrame:
    """(a, b): links between different fingerprints, as many as join what belongs together; ``distinct`` has one column fp.

    screen: with several lanes, the first lane may differ in at most so many bits (radius if there is one lane).
    """
    screen = radius if screen is None or lanes == 1 else screen
    n = distinct.count()
    tile = min(TILE_MAX, max(TILE_MIN, -(-n // TILES)))
    parts = max(1, -(-n // (4 * tile)))  # a task sorts four tiles, however many there are
    tiles = materialize(_tiles(distinct, lanes, tile, parts), "tiles")
    raw = lambda w: pa.array([r.tobytes() for r in w.astype(">u8")], pa.binary())

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _words(batch.column(3)[i].as_py(), lanes)
                label = compare(x, x, radius, screen, True)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), pa.array([label.astype("<u4").tobytes()], pa.binary())], names=[*batch.schema.names, "labels"])

    # First each tile by itself, so that a pair of tiles gives only the links that join what is apart in them.
    n_tiles = n // tile + 1
    known = materialize(tiles.repartition(max(1, min(4096, n_tiles)), "tile").mapInArrow(inside, "tile long, lo int, hi int, fps binary, labels binary"), "tiles-inside")

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fps, labels in zip(batch.column(0), batch.column(1), strict=True):
                x, label = _words(fps.as_py(), lanes), np.frombuffer(labels.as_py(), "<u4").astype(np.int64)
                at = np.flatnonzero(label != np.arange(len(label)))
                yield pa.record_batch([raw(x[at]), raw(x[label[at]])], names=["a", "b"])

    own = known.select("fps", "labels").mapInArrow(forests, "a binary, b binary")
    spans = known.select("tile", "lo", "hi")
    # Tiles meet on a population count that both can have; the least such count names the pair once.
    left = spans.select(F.col("tile").alias("a"), F.col("lo").alias("alo"), F.explode(F.sequence(F.col("lo") - screen, F.col("hi") + screen)).alias("pop"))
    right = spans.select(F.col("tile").alias("b"), F.col("lo").alias("blo"), F.explode(F.sequence("lo", "hi")).alias("pop"))
    pairs = left.join(right, "pop").where((F.col("pop") == F.greatest(F.col("alo") - screen, F.col("blo"))) & (F.col("a") < F.col("b"))).select("a", "b")
    # A tile goes once to each pair that it is part of.
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("tile"))
    work = ends.join(known.select("tile", "fps", "labels"), "tile").repartition(max(1, min(4096, n_tiles * (n_tiles - 1) // 2)), "a", "b")

    def across(key: tuple[pa.Scalar, ...], pair: pa.Table) -> pa.Table:
        blobs = {t: (_words(f, lanes), np.frombuffer(v, "<u4").astype(np.int64)) for t, f, v in zip(*(pair[c].to_pylist() for c in ("tile", "fps", "labels")), strict=True)}
        (x, lx), (y, ly) = (blobs[k.as_py()] for k in key)
        before = np.concatenate([lx, ly + len(x)])
        label = compare(x, y, radius, screen, False, before.copy())
        rows = np.concatenate([x, y])
        at = np.flatnonzero((before == np.arange(len(before))) & (label != before))
        return pa.table([raw(rows[at]), raw(rows[label[at]])], names=["a", "b"])

    return own.unionByName(work.groupBy("a", "b").applyInArrow(across, "a binary, b binary"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of edges (a, b), by large-star and small-star steps."""
    now = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == state or seen["n"] == 0:
            break
        state = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = materialize(small.where("a != b").distinct(), "edges")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def _ordered(key: str, *more: str):
    """A struct that is ordered by key, null last, and then by the other columns."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), *more)


def classes(edges: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """(by, root): the smallest node reachable from each node. edges (a, b) name nodes by ``by``; nodes: (by, node), node as _ordered() makes it."""
    end = lambda c: nodes.select(F.col(by).alias(c), F.struct("node", F.col(by).alias("id")).alias(f"node_{c}"))
    named = edges.join(end("a"), "a").join(end("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    roots = components(named).select(F.col("node.id").alias(by), F.col("root.node").alias("root"))
    return nodes.join(roots, by, "left").select(by, F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 3, radius: int = 3, lanes: int = 1, screen: int | None = None) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable over links of at most ``radius`` bits."""
    shared_dir(docs.sparkSession)
    prints = materialize(fingerprints(docs, key, text, shingle_words, lanes), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(_ordered(key)).alias("node")), "nodes")
    by_print = classes(links(nodes.select("fp"), radius, lanes, screen), nodes, "fp")
    return prints.join(by_print, "fp").select(key, "fp", F.col("root.k").alias("component_id"))


def _sets(docs: DataFrame, key: str, text: str, shingle_words: int, lanes: int) -> DataFrame:
    """(key, th, set_id, n, fp): hash of the text; 128-bit hash, size and fingerprint of its set of shingles, repeats left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.unique(shingle_hashes(t.as_py(), shingle_words)) for t in b.column(2)]
            ids = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in made], pa.binary())
            yield pa.record_batch([b.column(0), b.column(1), ids, pa.array([len(h) for h in made], pa.int64()), pa.array([fingerprint(h, lanes) for h in made], pa.binary())], names=[key, "th", "set_id", "n", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.xxhash64(text).alias("th"), text).mapInArrow(run, f"`{key}` {kind}, th long, set_id binary, n long, fp binary")


def same_enough(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Jaccard similarity of two sorted arrays without repeats is at least ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) * (1 - 1e-9):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return len(a) + len(b) == both or both / (len(a) + len(b) - both) >= least


def verified(label: np.ndarray, words: np.ndarray, sets: list[np.ndarray], left: np.ndarray | None, least: float, radius: int) -> np.ndarray:
    """Labels joined by the links that hold among all rows (left is None), or else between the rows of left and the others."""
    label = label.copy()
    rest = np.flatnonzero(~left) if left is not None else None
    for i in range(len(label)) if left is None else np.flatnonzero(left).tolist():
        others = np.arange(i + 1, len(label)) if left is None else rest
        others = others[label[others] != label[i]]
        near = others[np.bitwise_count(words[others] ^ words[i]).sum(axis=1, dtype=np.int64) <= radius]
        for j in near.tolist():
            if label[i] != label[j] and same_enough(sets[i], sets[j], least):
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
    return label


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 5, least: float = 0.8, radius: int = 64, lanes: int = 4, screen: int = 22) -> DataFrame:
    """(key, th, component_id, stays) of each row.

    component_id is the smallest key reachable over links of texts whose sets of shingles have a Jaccard similarity of at
    least ``least``. th: Spark's xxhash64 of the text. stays: the row has the component's smallest (key, th); repeated rows
    all have it.

    radius and screen choose the pairs that are compared. At 0.8 the expected distance is 39 of 256 bits with a
    deviation of 5.7, so a radius of 64 is more than four deviations off; of the first 64 bits, 10 with a deviation of 2.9.
    """
    shared_dir(docs.sparkSession)
    prints = materialize(_sets(docs, key, text, shingle_words, lanes), "sets")
    sets = materialize(prints.groupBy("set_id", "fp", "n").agg(F.min(_ordered(key, "th")).alias("node")), "set-nodes")
    roots = components(links(sets.select("fp").distinct(), radius, lanes, screen)).select(F.col("node").alias("fp"), "root")
    placed = sets.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = placed.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("hashes")).where("rows > 1")
    blocks = F.ceil(F.greatest(F.col("rows") / GROUP_ROWS, 8 * F.col("hashes") / GROUP_BYTES)).cast("int")
    sized = materialize(groups.select("root", blocks.alias("blocks")), "candidate-groups")
    wanted = materialize(placed.join(few(sized), "root").select("set_id", "fp", "root", "blocks", F.col("node.k").alias("__k"), F.col("node.th").alias("__th")), "wanted")
    # One text for each set that has candidates is read again.
    mine = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    texts = mine.join(few(wanted), F.col("k").eqNullSafe(F.col("__k")) & (F.col("th") == F.col("__th")))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([np.unique(shingle_hashes(t.as_py(), shingle_words)).tobytes() for t in b.column(0)], pa.binary())], names=[*b.schema.names[1:], "hs"])

    with_sets = texts.select("t", "set_id", "fp", "root", "blocks").mapInArrow(shingled, "set_id binary, fp binary, root binary, blocks int, hs binary")
    shingles = materialize(with_sets.withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")), "candidate-sets")

    def unpacked(rows: pa.Scalar) -> tuple[list[dict], np.ndarray, list[np.ndarray]]:
        got = sorted(rows.as_py(), key=lambda r: r["set_id"])
        return got, _words(b"".join(r["fp"] for r in got), lanes), [np.frombuffer(r["hs"], np.uint64) for r in got]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column(0):
                got, words, sets = unpacked(rows)
                label = verified(np.arange(len(got)), words, sets, None, least, radius)
                at = np.flatnonzero(label != np.arange(len(got))).tolist()
                yield pa.record_batch([pa.array([got[i]["set_id"] for i in at], pa.binary()), pa.array([got[label[i]]["set_id"] for i in at], pa.binary())], names=["a", "b"])

    # First each block by itself, so that a pair of blocks gives only the links that join what is apart in them.
    entry = F.struct("set_id", "fp", "hs")
    own = materialize(shingles.groupBy("root", "own").agg(F.collect_list(entry).alias("rows")).select("rows").mapInArrow(inside, "a binary, b binary"), "verified-inside")
    large = shingles.where("blocks > 1").join(own.select(F.col("a").alias("set_id"), F.col("b").alias("first")).distinct(), "set_id", "left")
    met = large.select("root", "own", "set_id", F.coalesce("first", "set_id").alias("first"), "fp", "hs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("own != other")
    pairs = met.groupBy("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list(F.struct("own", "set_id", "first", "fp", "hs")).alias("rows"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, rows in zip(batch.column(0), batch.column(1), strict=True):
                got, words, sets = unpacked(rows)
                place = {r["set_id"]: i for i, r in enumerate(got)}
                before = np.array([place[r["first"]] for r in got])
                label = verified(before, words, sets, np.array([r["own"] == lo.as_py() for r in got]), least, radius)
                at = np.flatnonzero((before == np.arange(len(got))) & (label != before)).tolist()
                yield pa.record_batch([pa.array([got[i]["set_id"] for i in at], pa.binary()), pa.array([got[label[i]]["set_id"] for i in at], pa.binary())], names=["a", "b"])

    edges = own.unionByName(materialize(pairs.select("lo", "rows").mapInArrow(across, "a binary, b binary"), "verified-across"))
    named = classes(edges, sets.select("set_id", "node"), "set_id")
    stays = F.col(key).eqNullSafe(F.col("root.k")) & (F.col("th") == F.col("root.th"))
    return prints.select(key, "th", "set_id").join(named, "set_id").select(key, "th", F.col("root.k").alias("component_id"), stays.alias("stays"))
