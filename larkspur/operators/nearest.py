"""Exact nearest chunks for a batch of queries (RAG10, JN1, JN13, SO1): a blocked matrix product and a bounded heap for each query.

Queries are broadcast in blocks of a stated number of bytes. A task multiplies each slice of its chunks with the block's
queries and keeps the k nearest of each query, so it holds k rows a query however many chunks it reads; these rows are all
that is shuffled. There is no sort over pairs and no pair is a row.

The product only screens: what can be among the k nearest, rounding included, has its distance summed component by
component, in one order. So equal vectors have equal distances wherever they are stored, and ties go to the smaller
chunk id.

Defined results: a vector that is null, zero, holds a null or a number that is not finite, overflows when squared, or has another length than the query has no
distance: such chunks come last, by id, and are returned only where fewer than k others are left; distance and
similarity are null then. A null chunk id comes last among equal distances. Repeated chunks count each. Of queries with one id the
one with the smallest vector counts, those without a vector last. Without queries or chunks there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a block of queries, and of the product with a slice of chunks.
QUERY_BYTES, PRODUCT_BYTES = 16 << 20, 16 << 20
#: More than the rounding of a product of unit vectors.
SLACK = 1e-9
OUTPUT_ROWS = 10_000


def unit_rows(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, norms) of a column of lists; rows that have no distance are zero with norm 0."""
    n = len(vectors)
    out, norms = np.zeros((n, dims)), np.zeros(n)
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero((lengths == dims) & vectors.is_valid().to_numpy(zero_copy_only=False))
    if len(whole) and dims:
        values = vectors.take(pa.array(whole)).flatten().cast(pa.float64())
        x = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).reshape(len(whole), dims)
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(length) & (length > 0)
        out[whole[good]], norms[whole[good]] = x[good], length[good]
    return out, norms


class Nearest:
    """The k nearest rows of each query so far."""

    def __init__(self, queries: np.ndarray, norms: np.ndarray, k: int):
        self.queries, self.norms, self.k = queries, norms, k
        self.unit = queries / np.where(norms > 0, norms, 1)[:, None]
        self.worst = np.full(len(queries), np.inf)  # the k-th distance
        self.full = np.zeros(len(queries), bool)
        self.query, self.row, self.distance = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.rows: pa.Table | None = None

    def add(self, batch: pa.RecordBatch, vectors: pa.Array, ids: str) -> None:
        step = max(1, PRODUCT_BYTES // (8 * max(1, len(self.queries))))
        for at in range(0, batch.num_rows, step):
            self._slice(batch.slice(at, step), vectors.slice(at, step), ids)

    def _slice(self, batch: pa.RecordBatch, vectors: pa.Array, ids: str) -> None:
        x, norms = unit_rows(vectors, self.queries.shape[1])
        none = (self.norms[:, None] == 0) | (norms == 0)
        near = 1 - self.unit @ (x / np.where(norms > 0, norms, 1)[:, None]).T
        near[none] = np.inf
        # What has no distance can only be wanted while a query has fewer than k rows.
        hit = (near <= self.worst[:, None] + SLACK) & (np.isfinite(near) | ~self.full[:, None] | ~np.isfinite(self.worst)[:, None])
        if len(norms) > self.k:
            hit &= near <= np.partition(near, self.k - 1, axis=1)[:, self.k - 1 : self.k] + SLACK
        i, j = np.nonzero(hit)
        if not len(i):
            return
        distance = np.full(len(i), np.inf)
        for c in range(0, len(i), 1 << 15):
            a, b = i[c : c + (1 << 15)], j[c : c + (1 << 15)]
            size = self.norms[a] * norms[b]
            distance[c : c + (1 << 15)] = np.where(size > 0, 1 - (self.queries[a] * x[b]).sum(axis=1) / np.where(size > 0, size, 1), np.inf)
        used, place = np.unique(j, return_inverse=True)
        old = 0 if self.rows is None else self.rows.num_rows
        fresh = pa.Table.from_batches([batch.take(pa.array(used))])
        rows = fresh if self.rows is None else pa.concat_tables([self.rows, fresh])
        query, row, distance = np.concatenate([self.query, i]), np.concatenate([self.row, place + old]), np.concatenate([self.distance, distance])
        by_id = pc.rank(rows[ids], sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
        order = np.lexsort((by_id[row], distance, query))
        query = query[order]
        rank = np.arange(len(order)) - np.searchsorted(query, query)
        kept = order[rank < self.k]
        self.query, self.distance = query[rank < self.k], distance[kept]
        last = query[rank == self.k - 1]
        self.worst[last], self.full[last] = distance[order[rank == self.k - 1]], True
        used, self.row = np.unique(row[kept], return_inverse=True)
        self.rows = rows.take(pa.array(used)).combine_chunks()

    def found(self, query_ids: pa.Array) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.query), OUTPUT_ROWS):
            part = slice(at, at + OUTPUT_ROWS)
            rows = self.rows.take(pa.array(self.row[part])).combine_chunks()
            distance = self.distance[part]
            columns = [query_ids.take(pa.array(self.query[part])), *[c.combine_chunks() for c in rows.columns], pa.array(distance, mask=~np.isfinite(distance))]
            yield pa.record_batch(columns, names=["query_id", *rows.column_names, "distance"])


def _block(queries: DataFrame, dims: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, vectors and norms of a block of queries, on the driver: its bytes are bounded."""
    table = queries.toArrow()
    ids, vectors = table["query_id"].combine_chunks(), table["vector"].combine_chunks()
    names, lists = ids.to_pylist(), vectors.to_pylist()
    first: dict = {}
    for i, name in enumerate(names):
        key = (lists[i] is None, [(x is None, x or 0.0) for x in lists[i] or []])
        if name not in first or key < first[name][0]:
            first[name] = (key, i)
    chosen = pa.array([i for _, i in first.values()], pa.int64())
    return (ids.take(chosen), *unit_rows(vectors.take(chosen), dims))


def nearest(chunks: DataFrame, queries: DataFrame, k: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, the columns of chunks without the embedding, distance, rank, similarity).

    chunks: chunk_id, embedding and what else is wanted (narrow columns; k of them a query and task are shuffled), filtered by
    contract and activity before. queries: (query_id, vector). With more than one block of queries the chunks are read once
    for each, and what a block finds is written to the checkpoint folder (without one, all blocks are one plan).
    """
    spark = chunks.sparkSession
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dims")).first()
    dims = max(0, size["dims"])
    n_blocks = -(-size["n"] * max(1, dims) * 8 // query_bytes) or 1
    others = [c for c in chunks.columns if c != "embedding"]
    given = chunks.select(F.col("embedding").cast("array<double>").alias("embedding"), *others)
    schema = T.StructType([asked.schema["query_id"], *[given.schema[c] for c in others], T.StructField("distance", T.DoubleType())])
    order = W.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), F.asc_nulls_last("chunk_id"))

    def one(block: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast(_block(block, dims))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, norms = sent.value
            state = Nearest(vectors, norms, k)
            for b in batches:
                if b.num_rows and len(ids):
                    state.add(pa.record_batch(b.columns[1:], names=others), b.column(0), "chunk_id")
            yield from state.found(ids)

        found = given.mapInArrow(run, schema)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    if n_blocks == 1:
        found = one(asked)
    else:
        # A query's rows all have one hash, so each block has its final ranks.
        number = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
        kept = spark.sparkContext.getCheckpointDir() is not None
        made = (one(asked.where(number == i)) for i in range(n_blocks))
        found = reduce(DataFrame.unionByName, [m.checkpoint() if kept else m for m in made])
    return found.withColumn("similarity", 1 - F.col("distance"))
