"""Usage, roster, activity and health reports (AG, WN, SO, JN, RP operators).

Defined results: counts and sums over empty tables are 0, averages null; a null latency takes no part in an average, a null cost in no sum; rows without a user count
in totals and belong to no user; rows without a time are in no window. Repeated rows count each, repeated days of one user once. Nulls sort where each report says.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators import dml
from larkspur.windows import DateWindow, eastern_date


def count_where(c: Column) -> Column:
    return F.count_if(c)


def rounded_latency(c: Column) -> Column:
    """NM1: half to even; null stays null."""
    return F.bround(c, 0).cast("int")


def cost_text(c: Column) -> Column:
    """NM2: six decimals, half to even, plain notation."""
    return F.bround(F.coalesce(c, F.lit(0)), 6).cast("decimal(28,6)").cast("string")


def usage_metrics(messages: DataFrame, conversations: DataFrame, costs: DataFrame, window: DateWindow) -> DataFrame:
    """AG1-AG3: one row. Each table is read once; the three single rows are joined."""
    role, status = F.col("role"), F.col("status")
    m = messages.where(window.holds(F.col("created_at"))).agg(
        F.countDistinct("user_id").alias("active_users"),
        count_where(role == "user").alias("user_queries"),
        count_where(role == "assistant").alias("assistant_responses"),
        count_where((role == "assistant") & (status == "failed")).alias("failed_responses"),
        count_where((role == "assistant") & (status == "blocked")).alias("blocked_responses"),
        rounded_latency(F.avg("latency_ms")).alias("average_latency_ms"),
    )
    c = conversations.where(window.holds(F.col("created_at"))).agg(F.count("*").alias("conversations"))
    t = costs.where(window.holds(F.col("created_at"))).agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), cost_text(F.sum("estimated_cost_usd")).alias("estimated_cost_usd"))
    return m.crossJoin(c).crossJoin(t)  # single rows


def usage_daily(messages: DataFrame, costs: DataFrame, window: DateWindow) -> DataFrame:
    """AG4, AG5, JN7, WN5, DT5: a row for each day of the window, zero where nothing happened."""
    inside = window.holds(F.col("created_at"))
    day = F.to_date("created_at").alias("usage_date")
    m = messages.where(inside).groupBy(day).agg(count_where(F.col("role") == "user").alias("user_queries"), count_where(F.col("role") == "assistant").alias("assistant_responses"))
    t = costs.where(inside).groupBy(day).agg(F.sum("total_tokens").alias("total_tokens"))
    both = m.join(t, "usage_date", "full")
    spark = messages.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(window.from_date), F.lit(window.to_date - dt.timedelta(1)))).alias("usage_date"))
    filled = days.join(both, "usage_date", "left")
    return filled.select("usage_date", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("user_queries", "assistant_responses", "total_tokens")])


def user_activity(messages: DataFrame, window: DateWindow) -> DataFrame:
    """AG6: sent counts every user row, last_activity every row."""
    return messages.where(window.holds(F.col("created_at"))).groupBy("user_id").agg(
        count_where(F.col("role") == "user").alias("messages_sent"), count_where((F.col("role") == "assistant") & (F.col("status") == "blocked")).alias("blocked_responses"), F.max("created_at").alias("last_activity_at")
    )


def _with_activity(users: DataFrame, messages: DataFrame, window: DateWindow) -> DataFrame:
    """JN2, PRJ1: users without activity stay."""
    a = user_activity(messages, window)
    joined = users.join(a, users["id"] == a["user_id"], "left")
    return joined.select(
        "id", "clerk_id", "first_name", "last_name", F.concat_ws(" ", "first_name", "last_name").alias("display_name"), "role", F.coalesce("messages_sent", F.lit(0)).alias("messages_sent"), F.coalesce("blocked_responses", F.lit(0)).alias("blocked_responses"), "last_activity_at"
    )


def user_overview(users: DataFrame, messages: DataFrame, window: DateWindow, limit: int = 100, offset: int = 0) -> DataFrame:
    """RP2, SO2."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit is 1 to 500, offset 0 or more")
    order = [F.desc_nulls_last("last_activity_at"), F.asc_nulls_last("first_name"), F.asc_nulls_last("last_name"), F.asc_nulls_last("clerk_id"), F.asc("id")]
    return _with_activity(users, messages, window).orderBy(*order).offset(offset).limit(limit)


def roster(users: DataFrame, messages: DataFrame, window: DateWindow, limit: int = 100) -> DataFrame:
    """SO3: students that are not deleted."""
    students = users.where((F.col("role") == "student") & ~F.col("deleted"))
    return _with_activity(students, messages, window).orderBy(F.asc_nulls_last("last_name"), F.asc_nulls_last("first_name"), F.asc("id")).limit(limit)


def instructor_summary(users: DataFrame, messages: DataFrame, daily: DataFrame, window: DateWindow) -> DataFrame:
    """AG7, AG8, JN3, JN6: active students, and questions asked."""
    students = users.where((F.col("role") == "student") & ~F.col("deleted")).select("id")
    asked = messages.where((F.col("role") == "user") & window.holds(F.col("created_at")))
    seen = daily.where(F.col("activity_date").between(F.lit(window.from_date), F.lit(window.to_date - dt.timedelta(1)))).select("user_id")
    active = asked.select("user_id").union(seen).distinct()  # one semi-join for both conditions
    n = students.join(active, students["id"] == active["user_id"], "left_semi").agg(F.count("*").alias("active_students"))
    q = asked.join(students, asked["user_id"] == students["id"]).agg(F.count("*").alias("questions_asked"))
    return n.crossJoin(q)


def streaks(daily: DataFrame, today: dt.date, key: str = "user_id", day: str = "activity_date") -> DataFrame:
    """WN1: days in a row up to today, or yesterday."""
    rows = daily.where(F.col(day) <= F.lit(today)).select(key, day).distinct()
    island = F.date_sub(F.col(day), F.row_number().over(W.partitionBy(key).orderBy(day)))
    runs = rows.withColumn("island", island).groupBy(key, "island").agg(F.count("*").alias("n"), F.max(day).alias("last"))
    live = F.max(F.when(F.col("last") >= F.lit(today - dt.timedelta(1)), F.col("n")))
    return runs.groupBy(key).agg(F.coalesce(live, F.lit(0)).alias("current_streak"))


def record_logins(daily: DataFrame, logins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RP5: (the daily table with the logins in it, the answers). logins: user_id, seen_at (UTC), any number for a user.

    An answer is (user_id, activity_date, current_streak, logged_in_today): the New York day of the user's last login and the days in a row that end with it. Logins
    without a user or a time are ignored; of a user without logins there is no answer.
    """
    seen = logins.where("user_id is not null and seen_at is not null").select("user_id", "seen_at", eastern_date(F.col("seen_at")).alias("activity_date"))
    new = seen.groupBy("user_id", "activity_date").agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.count("*").alias("login_count"))
    merged = dml.merge_daily(daily, new)
    last = seen.groupBy("user_id").agg(F.max_by("activity_date", "seen_at").alias("activity_date"))
    days = merged.select("user_id", "activity_date").distinct()
    island = F.date_sub(F.col("activity_date"), F.row_number().over(W.partitionBy("user_id").orderBy("activity_date")))
    run = F.row_number().over(W.partitionBy("user_id", "island").orderBy("activity_date"))
    streak = days.withColumn("island", island).withColumn("current_streak", run.cast("long")).drop("island")
    return merged, last.join(streak, ["user_id", "activity_date"]).withColumn("logged_in_today", F.lit(True))


def calendar(daily: DataFrame, user_id: int, first: dt.date, last: dt.date) -> DataFrame:
    """FLT5, AG23: active days of one user, both ends included."""
    if first > last:
        raise ValueError("invalid_date_range")
    return daily.where((F.col("user_id") == user_id) & F.col("activity_date").between(F.lit(first), F.lit(last)))


def month_grid(months: DataFrame, first: str = "first_day") -> DataFrame:
    """WN6: cells of a month from Sunday on; blanks before the 1st and up to whole weeks."""
    lead = F.dayofweek(first) - 1
    total = F.ceil((lead + F.dayofmonth(F.last_day(first))) / 7) * 7
    cell = F.sequence(F.lit(0), (total - 1).cast("int"))
    rows = months.select(first, lead.alias("lead"), F.explode(cell).alias("cell"))
    day = F.col("cell") - F.col("lead") + 1
    inside = (day >= 1) & (day <= F.dayofmonth(F.last_day(first)))
    return rows.select(first, "cell", F.when(inside, F.date_add(F.col(first), day - 1)).alias("day"))


def marked_grid(months: DataFrame, daily: DataFrame, user_id: int) -> DataFrame:
    """WN8: the grid with the user's active days marked."""
    active = daily.where(F.col("user_id") == user_id).select(F.col("activity_date").alias("day"), F.lit(True).alias("hit"))
    return month_grid(months).join(active, "day", "left").select("first_day", "cell", "day", F.coalesce("hit", F.lit(False)).alias("active"))


def attempts_in_window(events: DataFrame, seconds: int = 60, most: int = 10) -> DataFrame:
    """WN7 as counted attempts: how many of a user's events lie in the seconds up to each event."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id").orderBy(F.col("at")).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.select("event_id", "user_id", at.alias("at")).withColumn("attempts", F.count("*").over(w)).select("event_id", "user_id", "attempts", (F.col("attempts") > most).alias("over"))


def status_rollup(checks: DataFrame) -> DataFrame:
    """AG11: the worst status wins."""
    rank = F.max(F.when(F.col("status") == "unhealthy", 3).when(F.col("status") == "degraded", 2).when(F.col("status") == "ok", 1).otherwise(0))
    return checks.agg(F.element_at(F.array(*map(F.lit, ("not_checked", "ok", "degraded", "unhealthy"))), F.coalesce(rank, F.lit(0)) + 1).alias("status"))


def rag_health(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, contract: Column) -> DataFrame:
    """AG10, AG12, JN4, JN5: counts, chunks without an embedding of the configured contract, and the verdict."""
    own = embeddings.where(contract)
    n = documents.agg(F.count("*").alias("documents"))
    c = chunks.agg(F.count("*").alias("chunks"))
    e = embeddings.agg(F.count("*").alias("embeddings"), count_where(contract).alias("configured_embeddings"))
    no_vector = chunks.join(embeddings, "chunk_id", "left_anti").agg(F.count("*").alias("chunks_without_embedding"))
    lacking = chunks.join(own, "chunk_id", "left_anti").agg(F.count("*").alias("chunks_without_contract"))
    row = n.crossJoin(c).crossJoin(e).crossJoin(no_vector).crossJoin(lacking)  # single rows
    return row.withColumn("status", F.when((F.col("chunks") > 0) & (F.col("chunks_without_contract") > 0), "degraded").otherwise("ok"))


def provider_check(checks: DataFrame) -> DataFrame:
    """RP7: verdict of a provider look-up by (resolved, error, models)."""
    return checks.withColumn("status", F.when(~F.col("resolved"), "not_checked").when(F.col("error").isNotNull(), "unhealthy").when(F.col("models") == 0, "degraded").otherwise("ok"))


def display_status(c: Column) -> Column:
    """PRJ9."""
    low = F.lower(c)
    return F.when(low.isin("ok", "healthy"), "healthy").when(low.isin("degraded", "warning"), "warning").when(low == "unhealthy", "unhealthy").otherwise("unknown")
