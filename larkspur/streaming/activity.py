"""Structured Streaming forms of the event operators (DML7, DML8, DML15, EV2; the rate limit is in operators/ratelimit.py)."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import dml
from larkspur.sources.versions import Store, Transaction, batched
from larkspur.windows import eastern_date


def daily_activity(events: DataFrame, late: str = "1 day") -> DataFrame:
    """DML7: logins for each user and New York day; days that began more than ``late`` before the last one are closed, so state stays bounded."""
    day = eastern_date(F.col("ts").cast("timestamp_ntz"))
    t = events.withColumn("day_start", day.cast("timestamp")).withWatermark("day_start", late)
    found = t.groupBy("day_start", "user_id").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("login_count"))
    return found.select("user_id", F.to_date("day_start").alias("activity_date"), "first_seen_at", "last_seen_at", "login_count")


PROFILES = "clerk_id string, first_name string, last_name string, role string, clerk_profile_updated_at timestamp, deleted_at timestamp"


def merge_account_events(old: DataFrame, events: DataFrame) -> DataFrame:
    """DML8, DML11, DML15: profile updates and deletions of one batch. events: type, clerk_id, first_name, last_name, profile_at, arrival. A deletion of an unknown account does nothing, unless an update of the same batch makes the account."""
    sides = dml.dispatch(events)
    merged = dml.merge_profiles(old, sides["upserts"]).drop("applied")
    return dml.soft_delete(merged, sides["deletes"].select("clerk_id", F.col("profile_at").alias("event_at")))


def profile_sink(root: str, writer: str = "profiles", table: str = "user_account", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: only buckets with a changed account are rewritten, and a batch that comes again does nothing."""

    def run(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, root)

        def work(t: Transaction) -> None:
            if table not in t.tables:
                t.put(table, batch.sparkSession.createDataFrame([], PROFILES), ("clerk_id",), buckets)
            t.merge(table, batch.where("clerk_id is not null"), merge_account_events)

        batch.persist()
        try:
            batched(store, writer, number, work)
        finally:
            batch.unpersist()

    return run


def best_effort(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """EV2: a sink whose failures are logged and not raised, broken contracts (ValueError) excepted."""

    def run(batch: DataFrame, number: int) -> None:
        try:
            write(batch, number)
        except ValueError:
            raise
        except Exception:
            logging.getLogger(__name__).exception("batch %s was not written", number)

    return run
