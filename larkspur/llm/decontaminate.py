r"""Benchmark decontamination by template windows.

1. Words (runs of anything but ASCII white space, outer punctuation cut off) become template words: a
   number becomes ``<num>``, a unit behind a number ``<unit>``, a number with its unit in one word
   ``<qty>``, a capitalised word inside a sentence ``<name>``; any other word is itself in lower case.
2. Windows of ``window`` template words are hashed on both sides and joined. An item with fewer words
   than a window is one window. What the first word of an item is depends on what stands before it in a
   text, so the item's first window is indexed with each of its readings (word, name, unit).
3. Hits are compared word by word. A window with more placeholders than words says little as a template;
   it must have the same words as they are, so that it matches copies only. Then hits are checked for slot
   consistency: along one alignment of an item and a text, equal slot values of the item must stand
   against equal values in the text. A question with other numbers or names passes, words that only look
   alike don't.

Only DataFrame and SQL functions run. The hashes of the benchmark's windows, and the ids of texts with hits,
are broadcast up to a checked number of rows, the words of these windows up to a checked number of bytes; beyond
it the same joins shuffle.

Defined results: null and empty texts have no windows and no hits, null and empty items likewise;
repeated rows give one result row, and so do rows with one id and other texts; null ids are ids like any other;
an empty table on either side gives an empty result, and drop_contaminated() then keeps all; it judges rows by id
and text, so of rows that share an id only those with a hit go; extra columns are ignored, so their names
can't clash. Texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import few, materialize, unused

WINDOW = 8
#: Bytes of words up to which the windows of the benchmark are broadcast.
BROADCAST_BYTES = 32 << 20
# Words that count as units behind a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg t oz lb lbs gram grams kilogram kilograms tonne tonnes ton tons pound pounds ounce ounces ml l litre litres liter liters gallon gallons "
    "ms s sec secs min mins h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "percent usd eur gbp dollar dollars euro euros cent cents v w kw kwh j kj n pa hz khz mhz ghz b kb mb gb tb mph kmh k c f degrees"
).split()
_NUMBER = r"[+\-$€£]*\p{N}+(?:[.,:/]\p{N}+)*"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _from(w: Column, first: str, behind: str) -> Column:
    """Begins with a character from ``first`` on and before ``behind``: a comparison of bytes, far cheaper than a pattern."""
    return (w >= first) & (w < behind)


def _body(w: Column) -> Column:
    cut = F.regexp_replace(w, r"^[^\p{L}\p{N}$€£+\-]+|[^\p{L}\p{N}%]+$", "")
    return F.when(w.rlike(r"^[\p{L}\p{N}]+$"), w).when(cut == "", w).otherwise(cut)


def bodies(ws: Column) -> Column:
    return F.transform(ws, _body)


def templates(ws: Column, bs: Column) -> Column:
    """Template words of words and their bodies."""

    def one(b: Column, i: Column) -> Column:
        before, told = F.get(bs, i - 1), F.get(ws, i - 1)
        inside = (i > 0) & ~told.rlike(r"[.!?:][\p{Pe}\p{Pf}\p{Po}]*$")
        return (
            F.when(_from(b, "a", "{") & ~F.lower(b).isin(*UNITS), F.lower(b))  # most words: no further test
            .when(b.rlike(r"^\p{Ll}") & ~F.lower(b).isin(*UNITS), F.lower(b))
            .when(b.rlike(rf"^{_NUMBER}%?$"), F.lit("<num>"))
            .when(b.rlike(rf"^{_NUMBER}\p{{L}}{{1,3}}$") & F.regexp_extract(F.lower(b), r"(\p{L}+)$", 1).isin(*UNITS), F.lit("<qty>"))
            .when(F.lower(b).isin(*UNITS) & (i > 0) & before.rlike(rf"^{_NUMBER}$"), F.lit("<unit>"))
            .when(inside & b.rlike(r"^\p{Lu}"), F.lit("<name>"))
            .otherwise(F.lower(b))
        )

    return F.transform(bs, one)


def _placeholder(t: Column) -> Column:
    return t.isin("<num>", "<qty>", "<unit>", "<name>")


def _parsed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, th, bs, ts): the hash of the text, its words and its template words."""
    split = df.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), words(F.col(text)).alias("ws")).withColumn("bs", bodies(F.col("ws")))
    return split.select("id", "th", "bs", templates(F.col("ws"), F.col("bs")).alias("ts"))


def _hashed(ts: Column) -> Column:
    return F.transform(ts, lambda t: F.xxhash64(t))


def _starts(ts: Column, n: Column | int) -> Column:
    return F.when(F.size(ts) >= n, F.sequence(F.lit(0), F.size(ts) - n)).otherwise(F.array().cast("array<int>"))


def _windows(hs: Column, n: int) -> Column:
    """array<struct<at, n, h>> over hashes of template words: each window of n of them; none if there are fewer."""
    return F.transform(_starts(hs, n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.xxhash64(F.slice(hs, i + 1, n)).alias("h")))


def _said(ts: Column, bs: Column) -> Column:
    """What a window is compared by besides its template: nothing, or its words as they are if more than half are placeholders."""
    return F.when(2 * F.size(F.filter(ts, _placeholder)) > F.size(ts), F.xxhash64(bs)).otherwise(F.lit(0).cast("long"))


def _index(benchmark: DataFrame, item_key: str, item_text: str, window: int) -> DataFrame:
    """(item, words, iat, its, ibs, n, h, said): each window of each item; the first one once for each reading of its first word."""
    items = _parsed(benchmark, item_key, item_text).where(F.size("ts") > 0)
    n = F.least(F.lit(window), F.size("ts"))
    cut = items.select(F.col("id").alias("item"), F.size("ts").alias("words"), n.alias("n"), "ts", "bs", F.explode(_starts(F.col("ts"), n)).alias("iat")).select(
        "item", "words", "n", "iat", F.slice("ts", F.col("iat") + 1, F.col("n")).alias("its"), F.slice("bs", F.col("iat") + 1, F.col("n")).alias("ibs")
    )
    first = F.get("ibs", 0)
    others = F.filter(
        F.array(F.get("its", 0), F.when(first.rlike(r"^\p{Lu}"), F.lit("<name>")), F.when(F.lower(first).isin(*UNITS), F.lit("<unit>"))),
        lambda t: t.isNotNull(),
    )
    readings = F.when((F.col("iat") == 0) & ~F.get("its", 0).isin("<num>", "<qty>"), F.array_distinct(others)).otherwise(F.array(F.get("its", 0)))
    every = cut.withColumn("head", F.explode(readings)).withColumn("its", F.concat(F.array("head"), F.slice("its", F.lit(2), F.size("its")))).drop("head")
    return every.distinct().withColumns({"h": F.xxhash64(_hashed(F.col("its"))), "said": _said(F.col("its"), F.col("ibs"))})


def _matched(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item_key: str, item_text: str, window: int) -> DataFrame:
    """(id, th, item, item_words, item_windows, windows, same_values, exact, plain, exact_words) of each alignment.

    windows: found with slots consistent; exact: found with the same values; plain: item words in found windows that
    are no placeholders; exact_words: item words in the windows with the same values.
    """
    index = materialize(_index(benchmark, item_key, item_text, window), "benchmark-windows")
    lengths = sorted(r["n"] for r in index.select("n").distinct().collect())  # no more than ``window`` rows
    size = index.agg(F.sum(F.octet_length(F.array_join("its", " ")) + F.octet_length(F.array_join("ibs", " "))).alias("b")).first()["b"] or 0
    small = F.broadcast(index) if size <= BROADCAST_BYTES else index
    hashes = materialize(index.select("n", "h").distinct(), "benchmark-hashes")
    parsed = _parsed(docs, key, text).select("id", "th", _hashed(F.col("ts")).alias("hs"))
    every = F.flatten(F.array(*[_windows(F.col("hs"), n) for n in lengths])) if lengths else F.array().cast("array<struct<at:int,n:int,h:bigint>>")
    found = parsed.select("id", "th", F.inline(every)).join(few(hashes), ["n", "h"], "left_semi")
    at = materialize(found.select("id", "th", "at", "n", "h").distinct(), "window-hits")
    # Texts with a hit are read again, to compare words and slots.
    own, own_hash = unused(docs, "id"), unused(docs, "th")
    ids = materialize(at.select(F.col("id").alias(own), F.col("th").alias(own_hash)).distinct(), "texts-with-hits")
    with_hit = docs.join(few(ids), F.col(key).eqNullSafe(F.col(own)) & F.xxhash64(text).eqNullSafe(F.col(own_hash)), "left_semi")
    again = _parsed(with_hit, key, text).distinct()
    met = again.join(at.withColumnsRenamed({"id": "__id", "th": "__th"}), F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))).select(
        "id", "th", "at", "n", "h", F.slice("ts", F.col("at") + 1, F.col("n")).alias("dts"), F.slice("bs", F.col("at") + 1, F.col("n")).alias("dbs")
    )
    same = met.withColumn("said", _said(F.col("dts"), F.col("dbs"))).join(small, ["n", "h", "said"]).where((F.col("dts") == F.col("its")) & ((F.col("said") == 0) | (F.col("dbs") == F.col("ibs"))))
    slots = F.filter(F.transform("its", lambda t, j: F.struct(F.when(_placeholder(t), F.get("ibs", j)).alias("i"), F.when(_placeholder(t), F.get("dbs", j)).alias("d"))), lambda s: s["i"].isNotNull())
    plain = F.filter(F.transform("its", lambda t, j: F.when(~_placeholder(t), F.col("iat") + j)), lambda j: j.isNotNull())
    span = F.sequence("iat", F.col("iat") + F.col("n") - 1)
    lined = same.select("id", "th", "item", "words", "iat", (F.col("at") - F.col("iat")).alias("line"), slots.alias("slots"), plain.alias("plain"), span.alias("span")).withColumn("changed", F.exists("slots", lambda s: s["i"] != s["d"]))
    unchanged = lambda c: F.when(~F.col("changed"), F.col(c))
    union = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c))))
    # Along one alignment there are no more slots than the item has words.
    by_line = lined.groupBy("id", "th", "item", "words", "line").agg(
        F.countDistinct("iat").alias("all"), F.countDistinct(unchanged("iat")).alias("exact"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
        union(F.col("plain")).alias("plain"), union(unchanged("plain")).alias("exact_plain"), union(unchanged("span")).alias("exact_words"),
    )
    agree = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["i"])))
    counted = by_line.select(
        "id", "th", "item", F.col("words").alias("item_words"), F.when(agree, F.col("all")).otherwise(F.col("exact")).alias("windows"), "exact",
        (F.col("exact") == F.col("all")).alias("same_values"), F.when(agree, F.col("plain")).otherwise(F.col("exact_plain")).alias("plain"), "exact_words",
    ).where("windows > 0")
    sizes = materialize(index.groupBy(F.col("item").alias("__item")).agg(F.countDistinct("iat").alias("item_windows")), "benchmark-items")
    return counted.join(few(sizes), F.col("item").eqNullSafe(F.col("__item"))).drop("__item")


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, item key, item_windows, windows, coverage, same_values): items of which at least one window stands in a text, slots consistent.

    windows: how many of the item's windows were found; same_values: no slot was changed.
    """
    by_item = _matched(docs, benchmark, key, text, item_key, item_text, window).groupBy("id", "item", "item_windows").agg(F.max(F.struct("windows", "same_values")).alias("best"))
    return by_item.select(F.col("id").alias(key), F.col("item").alias(item_key), F.col("item_windows"), F.col("best.windows").cast("long").alias("windows"), (F.col("best.windows") / F.col("item_windows")).alias("coverage"), "best.same_values")


def evidence(window: int = WINDOW, least_words: int = 5, least_coverage: float = 0.5, least_plain: int = 6, run_words: int = 13) -> Column:
    """Whether an alignment of _matched() is enough to remove a document.

    Items under ``least_words`` words never are, and items under a window only whole and with the same values. Longer
    ones are if ``least_coverage`` of the item stands there with the same values, or with others and ``least_plain``
    words that are no placeholders, or if ``run_words`` words stand there unchanged or as words that are no placeholders.
    """
    share = lambda c: F.col(c) >= least_coverage * F.col("item_windows")
    whole = share("exact") & (F.col("item_words") >= least_words)
    part = (share("windows") & (F.col("plain") >= least_plain)) | (F.col("plain") >= run_words) | (F.col("exact_words") >= run_words)
    return whole | (part & (F.col("item_words") >= window))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, **more) -> DataFrame:
    """The rows of docs without a hit that is enough by evidence(), all columns unchanged."""
    found = _matched(docs, benchmark, key, text, item_key, item_text, window).where(evidence(window, **more))
    own, own_hash = unused(docs, "id"), unused(docs, "th")
    bad = materialize(found.select(F.col("id").alias(own), F.col("th").alias(own_hash)).distinct(), "contaminated")
    return docs.join(few(bad), F.col(key).eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(own_hash)), "left_anti")
