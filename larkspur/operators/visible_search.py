"""Search of visible text (FLT12, AG22) over a stored index: the text that a reader sees, once for each message, and postings of its trigrams.

A search looks up the rarest trigram of each term only, so a trigram that nearly every message has is not joined unless a term has
none rarer; candidates are then verified on the text. So results are exact and their cost follows the rarest trigram.

Defined results: terms are trimmed and compared in lower case. A blank term matches every message, with count 0. A term of one or
two characters has no trigram: it is looked for in every message. Matches are counted without overlap. A null message has an empty text;
repeated messages each count; terms that repeat a term_id are searched each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import citations


def trigrams(c: Column) -> Column:
    """The different runs of three characters of a text; none of a shorter one."""
    n = F.length(c)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(c, i, 3)))).otherwise(F.array().cast("array<string>"))


def build(messages: DataFrame, root: str, keys: list[str], text: str = "content") -> None:
    """Write the index of messages: ``texts`` (row, keys, visible) and ``postings`` (gram, row), ordered by gram, so a look-up reads few files."""
    spark = messages.sparkSession
    shown = messages.select(*keys, F.lower(citations.visible_text(F.col(text))).alias("visible"))
    # The number of a row is fixed by writing it once.
    shown.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{root}/texts")
    grams = spark.read.parquet(f"{root}/texts").select("row", F.explode(trigrams(F.col("visible"))).alias("gram"))
    grams.repartitionByRange("gram", "row").sortWithinPartitions("gram", "row").write.parquet(f"{root}/postings")
    spark.read.parquet(f"{root}/postings").groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{root}/grams")


def search(spark: SparkSession, root: str, terms: DataFrame) -> DataFrame:
    """(term_id, the messages' keys, n) of each message that a term (term_id, term) is found in."""
    texts, postings, grams = (spark.read.parquet(f"{root}/{n}") for n in ("texts", "postings", "grams"))
    keys = [c for c in texts.columns if c not in ("row", "visible")]
    wanted = terms.select(F.monotonically_increasing_id().alias("__t"), "term_id", F.lower(F.trim(F.coalesce("term", F.lit("")))).alias("term"))
    long = wanted.where(F.length("term") >= 3)
    asked = long.select("__t", "term_id", "term", F.explode(trigrams(F.col("term"))).alias("gram"))
    # A trigram that no message has is the rarest: its term is found nowhere.
    rarest = asked.join(grams, "gram", "left").groupBy("__t", "term_id", "term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0").select("term_id", "term", "g.gram")
    candidates = postings.join(rarest, "gram").drop("gram").join(texts, "row")
    # Terms without a trigram meet every message: a stated set of terms against all rows.
    short = wanted.where(F.length("term") < 3).select("term_id", "term")
    everywhere = texts.join(short, F.lit(True))
    found = candidates.select("term_id", "term", "visible", *keys).unionByName(everywhere.select("term_id", "term", "visible", *keys)).where((F.col("term") == "") | F.contains("visible", F.col("term")))
    n = F.when(F.col("term") == "", 0).otherwise((F.length("visible") - F.length(F.replace("visible", F.col("term")))) / F.length("term")).cast("long")
    return found.select("term_id", *keys, n.alias("n"))
