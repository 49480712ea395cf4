"""Filter interaction audit: what each filter removes in every order of the filters, by an incidence matrix product.

1. Each text gives a mask, a bit for each filter that it fails. What depends on the text alone comes from the
   text; whether a smaller id has the same text comes from counts: rows are grouped by (id, text), the
   smallest id of each text is found, and a row is a first one if (text, id) is that pair. All joins are on
   keys that one record has, so a text that a third of all documents share is no hot key.
2. Masks are counted by part. A part has three rows of 2**n counts: all documents, those of good quality,
   those that are toxic.
3. These rows, stacked, are multiplied by integer matrices of 2**n rows and a column for each step of each
   order (32 by 600 for five filters): 1 where a document of that mask is kept after the step, removed in it,
   fails it but was removed before, or fails nothing else. The sum over all orders of what a filter removes is
   the same product, folded by filter.

Texts are compared by SHA-256.

Defined results: a null text is empty and the same text as an empty one; a null part is the empty string. A row
without an id is no smaller id of any other and has none before it. Repeated rows count each; of equal texts under
one smallest id all are first. Labels that repeat an id count once: quality or toxic if one of them says so; labels of
null ids are ignored. An empty table gives no rows. Very long texts are measured whole. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import materialize, text_or_empty

OUTCOMES = ("kept", "removed", "redundant", "unique_fails")


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def orders(filters: str) -> list[str]:
    return ["".join(p) for p in itertools.permutations(filters)]


def incidence(filters: str) -> dict[str, np.ndarray]:
    """A matrix for each outcome: a row for each mask, a column for each step of each order."""
    n, sequences = len(filters), orders(filters)
    masks = np.arange(1 << n)
    at = np.array([[filters.index(f) for f in o] for o in sequences])
    own = (1 << at).ravel()
    before = np.concatenate([np.zeros((len(sequences), 1), np.int64), np.cumsum(1 << at, axis=1)[:, :-1]], axis=1).ravel()
    fails, gone = (masks[:, None] & own) != 0, (masks[:, None] & before) != 0
    out = {"kept": ~gone & ~fails, "removed": ~gone & fails, "redundant": gone & fails, "unique_fails": masks[:, None] == own}
    return {name: m.astype(np.int64) for name, m in out.items()}


def fold(filters: str) -> np.ndarray:
    """From steps to filters and back: 1 where two columns have the same filter."""
    own = np.array([filters.index(f) for o in orders(filters) for f in o])
    return (own[:, None] == own).astype(np.int64)


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask of the filters A to E that they fail."""
    body = text_or_empty(text)
    bits = [F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, failed in enumerate(text_failures(body).values())]
    narrow = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("same"), sum(bits[1:], bits[0]).alias("mask"))
    # Repeated rows become one; a text is read once.
    rows = materialize(narrow.groupBy("id", "same", "part", "mask").agg(F.count("*").alias("n")), "masks")
    first = rows.where("id is not null").groupBy("same").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    said = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = rows.join(first, ["id", "same"], "left").join(said, "id", "left")
    repeats = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    where = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0).cast("long"))).alias(c)
    return known.withColumn("mask", F.col("mask") + repeats).groupBy("part", "mask").agg(F.sum("n").alias("n"), where("good"), where("toxic"))


def audit(counts: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step."""
    steps = [(o, i + 1) for o in orders(filters) for i in range(len(filters))]
    matrices, same = incidence(filters), fold(filters)
    size, names = 1 << len(filters), [*OUTCOMES, "good_lost", "toxic_lost", "shapley"]

    def stack(lists: pa.Array) -> np.ndarray:
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Parts take 600 rows each: a few at a time.
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                n = some.num_rows
                rows = np.concatenate([stack(some.column(i)) for i in (1, 2, 3)])
                removed = rows @ matrices["removed"]
                made = [removed[:n] if name == "removed" else rows[:n] @ matrices[name] for name in OUTCOMES] + [removed[n : 2 * n], removed[2 * n :], removed[:n] @ same]
                parts = some.column(0).take(pa.array(np.repeat(np.arange(n), len(steps))))
                yield pa.record_batch([parts, pa.array([o for o, _ in steps] * n, pa.string()), pa.array([s for _, s in steps] * n, pa.int32()), *[pa.array(m.ravel(), pa.int64()) for m in made]], names=["part", "filter_order", "step", *names])

    def histogram(c: str) -> Column:
        """Counts in order of the masks; those that do not occur are 0."""
        held = F.map_from_entries(F.collect_list(F.struct("mask", c)))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.coalesce(held[m], F.lit(0).cast("long"))).alias(c)

    # A part has no more entries than there are masks.
    stacked = counts.groupBy("part").agg(*[histogram(c) for c in ("n", "good", "toxic")])
    return stacked.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names))


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The audit of the five filters over documents."""
    return audit(mask_counts(docs, labels, **columns))
