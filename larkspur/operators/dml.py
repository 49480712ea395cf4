"""Upserts, soft deletes and replacements as snapshot merges (DML, SET): old rows and changes in, the new snapshot out.

Defined results: an empty side gives the other; keys that are null match nothing, such old rows stay and such new rows come in as they are. New rows that repeat a key
must be reduced before (``latest``) where the operator does not do it itself; repeated old rows each stay. A null time in a change is older than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """JN12: one row for each key, the first in order."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def upsert_documents(old: DataFrame, new: DataFrame, now: Column, keys: tuple[str, ...] = ("source_type", "source_path")) -> DataFrame:
    """DML1: new values win, the row is active again; id and created_at stay."""
    fresh = ("title", "course_name", "content_hash", "metadata")
    n = new.select(*keys, F.col("id").alias("n_id"), *[F.col(c).alias(f"n_{c}") for c in fresh if c in new.columns], F.lit(True).alias("__new"))
    both = old.join(n, list(keys), "full")
    hit = F.col("__new")
    pick = lambda c: F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)) if f"n_{c}" in n.columns else F.col(c)
    return both.select(
        F.coalesce("id", "n_id").alias("id"), *keys, *[pick(c).alias(c) for c in fresh if c in old.columns],
        F.when(hit, True).otherwise(F.col("is_active")).alias("is_active"), F.when(~F.coalesce(hit, F.lit(False)), F.col("deleted_at")).alias("deleted_at"),
        F.coalesce("created_at", now).alias("created_at"), F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def deactivate(old: DataFrame, paths: DataFrame, now: Column, source_type: str, course_name: str | None = None, missing: bool = True) -> DataFrame:
    """DML4 (missing from the scan), DML5 (listed). Adds ``changed``. An empty list of paths is an error."""
    if paths.isEmpty():
        raise ValueError("no paths")
    seen = paths.select(F.col("source_path")).distinct().withColumn("__seen", F.lit(True))
    scope = (F.col("source_type") == source_type) & F.col("is_active")
    if course_name is not None:
        scope = scope & F.coalesce(F.col("course_name") == course_name, F.lit(False))
    hit = scope & (F.col("__seen").isNull() if missing else F.col("__seen").isNotNull())
    out = old.join(seen, "source_path", "left").withColumn("changed", hit)
    return out.withColumns({"is_active": F.col("is_active") & ~F.col("changed"), "deleted_at": F.when(F.col("changed"), now).otherwise(F.col("deleted_at")), "updated_at": F.when(F.col("changed"), now).otherwise(F.col("updated_at"))}).drop("__seen")


def may_reconcile(asked: bool, dry_run: bool, discovered: int, failures: int, database_failures: int) -> bool:
    """DML6."""
    return asked and not dry_run and discovered > 0 and failures == 0 and database_failures == 0


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """DML2, DML3: all old rows of the keys that come anew are replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def merge_daily(old: DataFrame, new: DataFrame) -> DataFrame:
    """DML7: first seen stays, last seen follows the update, counts add up. Both sides have a row for each (user_id, activity_date)."""
    n = new.select("user_id", "activity_date", F.col("first_seen_at").alias("nf"), F.col("last_seen_at").alias("nl"), F.col("login_count").alias("nc"))
    both = old.join(n, ["user_id", "activity_date"], "full")
    return both.select("user_id", "activity_date", F.coalesce("first_seen_at", "nf").alias("first_seen_at"), F.coalesce("nl", "last_seen_at").alias("last_seen_at"), (F.coalesce("login_count", F.lit(0)) + F.coalesce("nc", F.lit(0))).alias("login_count"))


def merge_profiles(old: DataFrame, updates: DataFrame) -> DataFrame:
    """DML8: the newest update of a key applies if the stored time is null or not later. role and deleted_at stay. updates: clerk_id, first_name, last_name, profile_at, arrival."""
    newest = latest(updates, ["clerk_id"], F.desc("profile_at"), F.desc("arrival"))
    n = newest.select("clerk_id", F.col("first_name").alias("nf"), F.col("last_name").alias("nl"), F.col("profile_at").alias("nt"))
    both = old.join(n, "clerk_id", "full")
    wins = F.col("nt").isNotNull() & (F.col("clerk_profile_updated_at").isNull() | (F.col("nt") >= F.col("clerk_profile_updated_at")))
    pick = lambda a, b: F.when(wins, F.col(a)).otherwise(F.col(b)).alias(b)
    return both.select("clerk_id", pick("nf", "first_name"), pick("nl", "last_name"), F.coalesce("role", F.lit("student")).alias("role"), pick("nt", "clerk_profile_updated_at"), "deleted_at", F.coalesce(wins, F.lit(False)).alias("applied"))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """DML9, SET1: rows whose key is there already are left as they are; ``created`` tells the others."""
    more = latest(new, keys, *[F.asc(c) for c in new.columns]).join(old.select(*keys), keys, "left_anti")
    return old.withColumn("created", F.lit(False)).unionByName(more.withColumn("created", F.lit(True)), allowMissingColumns=True)


def repair_profile(df: DataFrame) -> DataFrame:
    """DML10: claims replace the names only before any webhook came, on live accounts, and where they differ."""
    differs = ~(F.col("first_name").eqNullSafe(F.col("claim_first")) & F.col("last_name").eqNullSafe(F.col("claim_last")))
    go = F.col("clerk_profile_updated_at").isNull() & F.col("deleted_at").isNull() & differs
    return df.withColumn("repaired", go).withColumns({"first_name": F.when(go, F.col("claim_first")).otherwise(F.col("first_name")), "last_name": F.when(go, F.col("claim_last")).otherwise(F.col("last_name"))})


def soft_delete(old: DataFrame, events: DataFrame, key: str = "clerk_id") -> DataFrame:
    """DML11: the first deletion counts."""
    first = events.groupBy(key).agg(F.min("event_at").alias("__at"))
    return old.join(first, key, "left").withColumn("deleted_at", F.coalesce("deleted_at", "__at")).drop("__at")


def delete_conversations(old: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """DML12."""
    hit = F.col("__hit").isNotNull()
    out = old.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return out.withColumns({"status": F.when(hit, "deleted").otherwise(F.col("status")), "deleted_at": F.when(hit, now).otherwise(F.col("deleted_at")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).drop("__hit")


def dispatch(events: DataFrame) -> dict[str, DataFrame]:
    """DML15."""
    return {"upserts": events.where(F.col("type").isin("user.created", "user.updated")), "deletes": events.where(F.col("type") == "user.deleted")}


def turn_rows(new: DataFrame, base: DataFrame) -> DataFrame:
    """DML13, AG9: each new message becomes a completed user row and a pending assistant row, numbered after the conversation's last."""
    numbered = new.withColumn("__n", F.row_number().over(W.partitionBy("conv_id").orderBy("arrival")))
    last = base.groupBy("conv_id").agg(F.max("sequence").alias("__base"))
    at = F.coalesce("__base", F.lit(0)) + 2 * (F.col("__n") - 1)
    pair = F.array(
        F.struct((at + 1).cast("long").alias("sequence"), F.lit("user").alias("role"), F.lit("completed").alias("status"), F.col("content")),
        F.struct((at + 2).cast("long").alias("sequence"), F.lit("assistant").alias("role"), F.lit("pending").alias("status"), F.lit("").alias("content")),
    )
    return numbered.join(last, "conv_id", "left").select("conv_id", F.inline(pair))


def backfill(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """DML16."""
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})
