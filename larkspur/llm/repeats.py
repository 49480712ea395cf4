"""What the two exact repeat operators share: shards of whole texts, rolling hashes, and the exchange of keys between shards.

A shard is a row: consecutive documents (in order of key), their texts in one piece. Keys of a shard
(hashes of its windows) go, sorted and each once, to buckets by hash, so a window that millions of
documents share is one entry for each shard. A bucket answers each entry; the answers go back to the
shard, in the order in which the entries came. Nothing else is shuffled, and no task holds more than a
shard, or what all shards have in one bucket; the number of buckets grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import dropping_shuffles, fresh_path

#: Bytes of text in a shard, and of the text whose keys meet in a bucket, about.
SHARD_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
_U = np.uint64
#: Two odd bases for rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n at least."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, base, _U), np.full(size, pow(base, -1, 2**64), _U)
        up[0] = down[0] = 1
        _powers[base] = (np.cumprod(up), np.cumprod(down))
    return _powers[base]


def prefix_hashes(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


def window_hashes(prefix: np.ndarray, base: int, length: int) -> np.ndarray:
    """Hash of the window of ``length`` values from each place; empty if there are fewer values."""
    n = len(prefix) - 1 - length + 1
    if n <= 0:
        return np.empty(0, _U)
    return mix((prefix[length:] - prefix[:-length]) * powers(base, n)[1][:n])


def run_hashes(prefix: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of values, its length included."""
    h = (prefix[ends] - prefix[starts]) * powers(base, len(prefix))[1][starts]
    return mix(h + mix((ends - starts).astype(_U)))


def pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of hashes as 16-byte strings, whose order is that of the pairs."""
    return np.stack([a, b], axis=1).astype(">u8").view("S16").ravel()


def shards(docs: DataFrame, key: str, text: str, shard_bytes: int = SHARD_BYTES, others: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """(shard, ids, ends, blob, others), written to the shared folder, and the bytes of all texts. The order of the shards is that of the keys, null first.

    others: columns that go along with the texts, as structs.
    """
    size = docs.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // (8 * shard_bytes)))
    more = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("boolean")
    ranged = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), more.alias("o")).repartitionByRange(parts, F.col("k").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = 0, 0, 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        along: list[pa.Array] = []

        def flush():
            nonlocal ids, texts, along, number, held
            lists = [pa.array([ids], pa.list_(pa.int64())), pa.array([np.cumsum([len(t) for t in texts]).tolist()], pa.list_(pa.int64()))]
            beside = pa.concat_arrays(along)
            row = pa.record_batch([pa.array([part * 1_000_000 + number]), *lists, pa.array([b"".join(texts)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(beside)], pa.int32()), beside)], names=["shard", "ids", "ends", "blob", "others"])
            ids, texts, along, number, held = [], [], [], number + 1, 0
            return row

        for b in batches:
            part = b.column(2)[0].as_py() if b.num_rows else part
            begin = 0
            for i, (k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                body = (t.as_py() or "").encode()
                if ids and held + len(body) > shard_bytes:
                    along.append(b.column(3).slice(begin, i - begin))
                    begin = i
                    yield flush()
                ids.append(k)
                texts.append(body)
                held += len(body)
            along.append(b.column(3).slice(begin))
        if ids:
            yield flush()

    kind = ranged.schema["o"].dataType
    fields = "shard long, ids array<long>, ends array<long>, blob binary"
    made = ranged.select("k", "t", F.spark_partition_id().alias("p"), "o").mapInArrow(run, T.StructType([*T.StructType.fromDDL(fields).fields, T.StructField("others", T.ArrayType(kind))]))
    # Bucketed by shard, the texts need no shuffle when answers are joined to them.
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (4 * shard_bytes)))
    path = fresh_path(spark, "shards")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with dropping_shuffles(spark):
        made.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "shard").saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog only had to carry the bucketing; the files stay
    return written, size


def bucket_bits(size: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(2, int(np.ceil(np.log2(max(1, size / bucket_bytes)))))


def each_shard(df: DataFrame, work: Callable[[dict], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Run ``work`` on each row; a value is handed over as it is in Arrow, one row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out = work({n: b.column(j)[i] for j, n in enumerate(b.schema.names)})
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def to_buckets(shard: int, keys: np.ndarray, buckets: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows for the exchange: ``keys`` (any fixed-size type) stand in order of ``buckets``."""
    at = np.searchsorted(buckets, np.arange((1 << bits) + 1))
    full = np.flatnonzero(at[1:] > at[:-1])
    return pa.record_batch([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), shard, np.int64)), pa.array([keys[at[i] : at[i + 1]].tobytes() for i in full], pa.binary())], names=["bucket", "shard", "keys"])


EXCHANGE = "bucket int, shard long, keys binary"


def exchange(rows: DataFrame, answer: Callable[[list[bytes]], list[np.ndarray]]) -> DataFrame:
    """(shard, answers): for each shard its answers from all buckets, in order of the buckets. ``answer`` gets the keys of all shards in one bucket, in order of the shards, and gives a byte for each entry."""

    def meet(group: pa.Table) -> pa.Table:
        order = np.argsort(group["shard"].to_numpy())
        keys = group["keys"].to_pylist()
        got = answer([keys[i] for i in order])
        return pa.table([group["bucket"].take(pa.array(order)), group["shard"].take(pa.array(order)), pa.array([g.astype(np.uint8).tobytes() for g in got], pa.binary())], names=["bucket", "shard", "keys"])

    met = rows.groupBy("bucket").applyInArrow(meet, EXCHANGE)
    # A shard has no more answers than keys.
    return met.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "keys"))).alias("a")).select("shard", F.col("a.keys").alias("answers"))


def joined(answers) -> np.ndarray:
    """The answers of a shard as one array of bytes."""
    parts = answers.as_py() or []
    return np.frombuffer(b"".join(parts), np.uint8)


def seen_before(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For each entry of each sorted run of distinct keys: whether an earlier run has it. Runs are merged pairwise, by binary search."""
    flags = [np.zeros(len(r), np.uint8) for r in runs]

    def merge(low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if high - low == 1:
            n = len(runs[low])
            return runs[low], np.full(n, low, np.int32), np.arange(n, dtype=np.int32)
        middle = (low + high) // 2
        (a, arun, aat), (b, brun, bat) = merge(low, middle), merge(middle, high)
        if not len(a) or not len(b):
            return (b, brun, bat) if not len(a) else (a, arun, aat)
        place = np.searchsorted(a, b)
        old = a[np.minimum(place, len(a) - 1)] == b
        order = np.argsort(brun[old], kind="stable")
        hit_run, hit_at = brun[old][order], bat[old][order]
        for r in np.unique(hit_run):
            x, y = np.searchsorted(hit_run, [r, r + 1])
            flags[r][hit_at[x:y]] = 1
        new = ~old
        return np.insert(a, place[new], b[new]), np.insert(arun, place[new], brun[new]), np.insert(aat, place[new], bat[new])

    if runs:
        merge(0, len(runs))
    return flags


def first_windows(parts: list[bytes]) -> list[np.ndarray]:
    """An answer for exchange(): 1 where an earlier shard has the same 16-byte key."""
    return seen_before([np.frombuffer(p, "S16") for p in parts])


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n places the runs of ``length`` from ``starts`` cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0
