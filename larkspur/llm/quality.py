"""Quality rules: a decision list learned from labelled documents.

1. Each whole text is measured (MEASURES). Measures turn into features by Spark expressions (FEATURES).
2. Sequential covering on a bounded sample of labelled documents: a rule is a conjunction of threshold
   tests, grown by information gain on two thirds of what is still uncovered, pruned on the last third,
   and kept only while it is precise enough. What it covers is taken away and the next rule is learned.
3. The rules, in order, become one Spark conditional expression: the first that holds rejects.

A second list, for toxic documents, tests the words of a lexicon (learn_toxic). The lexicon holds the words
whose labelled documents are toxic far more often than chance gives, all words tried taken into account; near
copies count once. Toxic documents without any such word can't be told by it and stay.

The sample is the ``max_labelled`` labelled documents with the smallest hash of the id, so its size is
bounded and it is the same in every run; the measures and the verdict cover all documents.

Defined results: a null or empty text has no words, measures of zero and features of zero, and fails the
base rule (fewer than 10 words); without labels of both classes the list is empty and only the base rule
rejects; labels without a document, null labels and null ids are left out of the sample; a document
labelled twice counts twice; repeated rows are judged each; an empty table gives an empty result; extra
columns pass through decide() under any name, and don't matter elsewhere.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import materialize
from larkspur.llm.simhash import shingle_hashes

#: What is counted in a text; all are bigint.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_exclaims", "n_stops")
#: Feature: SQL expression over the measures. Zero where the divisor is zero.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "exclaims_per_word": "n_exclaims / greatest(n_words, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
}
# The characters that count as symbols, and white space.
SYMBOLS, WHITE = "#*$%&|<>", " \t\n\x0b\x0c\r"
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
WINDOW = 5
#: Features of the toxic list, over n_words and n_toxic.
TOXIC_FEATURES = {"toxic_words": "cast(n_toxic as double)", "toxic_words_per_word": "n_toxic / greatest(n_words, 1)"}
# Fixed: what parts the words of a lexicon, and A-Z in lower case. General punctuation and « » part words too.
_PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode() + _DIGITS, string.ascii_lowercase.encode() + b" " * (len(string.punctuation) + 10))
_QUOTES = re.compile(rb"\xe2\x80[\x80-\xbf]|\xc2[\xa0\xab\xbb\xbf\xa1]")


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that a window found twice or more in the text covers, the first finding included."""
    runs = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(runs)) == len(runs):
        return 0
    counts, covered, upto = Counter(runs), 0, 0
    for i, r in enumerate(runs):
        if counts[r] > 1:
            covered += i + window - max(i, upto)
            upto = i + window
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    data = text.encode()
    words = data.split()
    lines, seen, dup = 0, set(), 0
    for line in text.split("\n"):
        if line and line.strip(WHITE):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeat_words(words),
        lines,
        len(data) - len(data.translate(None, _UPPER)),
        len(data) - len(data.translate(None, _DIGITS)),
        text.count("!"),
        text.count("."),
    )


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and MEASURES of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([measure(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, len(MEASURES))
            yield pa.record_batch([b.column(0), *(pa.array(got[:, i]) for i in range(len(MEASURES)))], names=[key, *MEASURES])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def plain_words(text: str | None) -> list[bytes]:
    """Words without case, digits and punctuation, as a lexicon holds them."""
    data = (text or "").encode()
    return (data if data.isascii() else _QUOTES.sub(b" ", data)).translate(_PLAIN).split()


def count_toxic(text: str | None, lexicon: frozenset[bytes]) -> int:
    """Words of the text that stand in the lexicon, repeats included."""
    words = plain_words(text) if lexicon else []
    return 0 if lexicon.isdisjoint(words) else sum(w in lexicon for w in words)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def sql(self) -> str:
        return f"({(FEATURES | TOXIC_FEATURES)[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    precision: float
    covered: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([t.holds(x) for t in self.tests])

    def sql(self) -> str:
        return " and ".join(t.sql() for t in self.tests)


def _candidates(v: np.ndarray, most: int) -> np.ndarray:
    """Cut points: midway between neighbouring values, thinned to quantiles."""
    u = np.unique(v)
    cuts = (u[1:] + u[:-1]) / 2
    return cuts if len(cuts) <= most else np.unique(cuts[np.linspace(0, len(cuts) - 1, most).astype(int)])


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int, longest: int) -> list[Test]:
    alive, tests = np.ones(len(bad), bool), []
    while len(tests) < longest:
        p, n = int(bad[alive].sum()), int((~bad[alive]).sum())
        if n == 0 or p == 0:
            break
        base, best, gain = np.log2(p / (p + n)), None, 1e-9
        for f, v in x.items():
            own, hit = v[alive], bad[alive]
            order = np.argsort(own, kind="stable")
            sorted_v, up = own[order], np.concatenate([[0], np.cumsum(hit[order])])
            at = np.searchsorted(sorted_v, c := _candidates(own, cuts), side="right")
            for above, pos, size in ((False, up[at], at), (True, p - up[at], len(own) - at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pos > 0, pos * (np.log2(pos / np.maximum(size, 1)) - base), 0)
                if len(g) and g.max() > gain:
                    gain, best = float(g.max()), Test(f, above, float(c[int(g.argmax())]))
        if best is None:
            break
        tests.append(best)
        alive &= best.holds(x)
    return tests


def learn(x: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.9, least_covered: int = 3, most_rules: int = 20, longest: int = 4, cuts: int = 256, seed: int = 7) -> list[Rule]:
    """The decision list for rejecting ``bad`` rows."""
    rules: list[Rule] = []
    left, rng = np.ones(len(bad), bool), np.random.default_rng(seed)
    while len(rules) < most_rules and bad[left].any():
        at = rng.permutation(np.flatnonzero(left))
        grow, prune = at[: -(len(at) // 3) or None], at[len(at) - len(at) // 3 :]
        tests = _grow({f: v[grow] for f, v in x.items()}, bad[grow], cuts, longest)
        if not tests:
            break
        part = {f: v[prune] for f, v in x.items()}

        def worth(tests: list[Test], part=part, prune=prune) -> tuple[float, int]:
            hit = np.logical_and.reduce([t.holds(part) for t in tests])
            p, n = int(bad[prune][hit].sum()), int((~bad[prune][hit]).sum())
            return (p - n) / max(1, p + n), p

        best = max((tests[:k] for k in range(len(tests), 0, -1)), key=worth)
        hit = left & np.logical_and.reduce([t.holds(x) for t in best])
        p, n = int(bad[hit].sum()), int(hit.sum())
        if p < least_covered or p / n < least_precision:
            break
        rules.append(Rule(tuple(best), p / n, p))
        left &= ~hit
    return rules


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_labelled: int) -> DataFrame:
    """(k, y, t) of the documents of at most ``max_labelled`` labels; labels without a document are not counted."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    there = rows.join(docs.select(F.col(key).alias("k")), "k", "left_semi")
    sample = there.orderBy(F.xxhash64("k"), "k", "y").limit(max_labelled)
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k")  # no more than max_labelled rows


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = 20_000) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features of at most ``max_labelled`` labelled documents, and whether each is labelled 0."""
    texts = _sample(docs, labels, key, text, label, max_labelled)
    kept = measures(texts.select(F.struct("k", "y").alias("k"), "t"), "k", "t")
    got = kept.select("k.k", "k.y", *[F.expr(e).cast("double").alias(f"f_{f}") for f, e in FEATURES.items()])
    got = got.orderBy(F.xxhash64("k"), "k", "y").limit(max_labelled).toPandas()  # an id may stand in docs more than once
    return {f: got[f"f_{f}"].to_numpy(float) for f in FEATURES}, got["y"].to_numpy() == 0


def learn_toxic(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = 20_000, least_precision: float = 0.95, chance: float = 0.01, most_words: int = 10_000
) -> tuple[frozenset[bytes], list[Rule]]:
    """(lexicon, rules over TOXIC_FEATURES) for rejecting documents with label 1.

    A word is taken if at least ``least_precision`` of its documents are toxic and chance would give any such word with a
    probability of at most ``chance`` (bound of Chernoff, all words of the sample tried). Documents with the same least
    shingle hash count as one, toxic if all are.
    """
    texts = materialize(_sample(docs, labels, key, text, label, max_labelled).select("y", "t"), "toxic-sample")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [t.as_py() for t in b.column(1)]
            least = [int(min(shingle_hashes(t, WINDOW), default=0)) >> 1 for t in said]
            yield pa.record_batch([b.column(0), pa.array(least, pa.int64()), pa.array([list(set(plain_words(t))) for t in said], pa.list_(pa.binary()))], names=["y", "like", "ws"])

    made = texts.mapInArrow(split, "y int, like long, ws array<binary>")
    groups = made.groupBy("like").agg(F.min((F.col("y") == 1).cast("int")).alias("y"))
    toxic, n_groups = groups.agg(F.sum("y"), F.count("*")).first()
    if not toxic or toxic == n_groups:
        return frozenset(), []
    by_group = made.select("like", (F.col("y") == 1).cast("int").alias("y"), F.explode("ws").alias("w")).groupBy("w", "like").agg(F.min("y").alias("y"))
    by_word = materialize(by_group.groupBy("w").agg(F.count("*").alias("n"), F.sum("y").alias("k")), "toxic-words")
    base, p = toxic / n_groups, F.col("k") / F.col("n")
    gain = F.col("k") * F.log(p / base) + F.when(p < 1, (F.col("n") - F.col("k")) * F.log((1 - p) / (1 - base))).otherwise(0)
    need = float(np.log(max(1, by_word.count()) / chance))
    found = by_word.where((p >= max(least_precision, base)) & (gain >= need)).orderBy(F.desc(gain), "w").limit(most_words)
    lexicon = frozenset(bytes(r["w"]) for r in found.select("w").collect())  # no more than most_words rows
    if not lexicon:
        return lexicon, []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [t.as_py() or "" for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([len(t.encode().split()) for t in said], pa.int64()), pa.array([count_toxic(t, lexicon) for t in said], pa.int64())], names=["y", "n_words", "n_toxic"])

    counted = texts.mapInArrow(count, "y int, n_words long, n_toxic long")
    alike = counted.select("y", *[F.expr(e).cast("double").alias(f) for f, e in TOXIC_FEATURES.items()]).groupBy("y", *TOXIC_FEATURES).agg(F.count("*").alias("n")).toPandas()
    got = alike.sort_values(["y", *TOXIC_FEATURES])
    got = got.loc[got.index.repeat(got["n"])]
    return lexicon, learn({f: got[f].to_numpy(float) for f in TOXIC_FEATURES}, got["y"].to_numpy() == 1, least_precision)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: number of the first rule that holds (from 1), 0 if none."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(F.expr(r.sql()), i) if out is None else out.when(F.expr(r.sql()), i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """key, MEASURES, base_failed, rule (0: none), kept."""
    rules = learn(*labelled_sample(docs, labels, key, text), **more)
    made = measures(docs, key, text).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return made.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def decide(docs: DataFrame, rules: list[Rule], text: str = "text", toxic: tuple[frozenset[bytes], list[Rule]] = (frozenset(), [])) -> DataFrame:
    """The rows of docs that the base rule, the list and the toxic list of learn_toxic() keep, all columns unchanged."""
    names, added, (lexicon, toxic_rules) = [f"c{i}" for i in range(len(docs.columns))], [*MEASURES, "n_toxic"], toxic
    columns, text = docs.columns, names[docs.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([(*measure(t.as_py()), count_toxic(t.as_py(), lexicon)) for t in b.column(text)], np.int64).reshape(-1, len(added))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(got[:, i]) for i in range(len(added)))], names=[*names, *added])

    # Columns go through under names of our own, so that theirs can't clash with the measures.
    schema = T.StructType([*(T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema.fields, strict=True)), *(T.StructField(m, T.LongType()) for m in added)])
    kept = docs.toDF(*names).mapInArrow(run, schema).where(~base_failed() & (verdict(rules) == 0) & (verdict(toxic_rules) == 0))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)])
