"""Views that bind the test tables to the service's data model. Times are UTC, without zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import table
from larkspur.windows import eastern_date


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    user = F.col("event_type").isin("click", "view")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "blocked").otherwise("completed")
    return e.select(
        F.col("event_id").alias("id"), "user_id", F.when(user, "user").otherwise("assistant").alias("role"), status.alias("status"), F.when(~user, F.floor(F.col("value") * 100).cast("long")).alias("latency_ms"), F.col("ts").alias("created_at")
    )


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    tokens = F.floor("value").cast("long")
    cost = (tokens * 150).cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(6,6)")
    return e.select(F.col("event_id").alias("id"), "user_id", tokens.alias("total_tokens"), cost.cast("decimal(18,12)").alias("estimated_cost_usd"), F.col("ts").alias("created_at"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    role = F.when(F.col("c_mktsegment") == "MACHINERY", "admin").when(F.col("c_mktsegment") == "FURNITURE", "instructor").otherwise("student")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("clerk_id"), F.substring_index("c_name", "#", 1).alias("first_name"), F.substring_index("c_name", "#", -1).alias("last_name"), role.alias("role"), (F.col("c_acctbal") < 0).alias("deleted")
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One conversation for each user and UTC day."""
    m = messages(spark, sf_dir)
    return m.groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.min("created_at").alias("created_at"))


def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML7 as a batch: first and last time seen, and count, for each user and New York day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", eastern_date(F.col("ts")).alias("activity_date")).agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("login_count"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    provider = F.when(F.col("label") >= 8, "legacy").otherwise("local")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), "embedding", provider.alias("embedding_provider"), F.lit("m1").alias("embedding_model"), F.size("embedding").alias("embedding_dimensions"), (F.col("label") != 0).alias("is_active"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", (F.col("turn") + 1).alias("sequence"), "role", F.col("text").alias("content"), F.lit("completed").alias("status"))


#: The same views as DuckDB common table expressions.
SQL_VIEWS = {
    "v_message": "SELECT event_id AS id, user_id, CASE WHEN event_type IN ('click','view') THEN 'user' ELSE 'assistant' END AS role, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'blocked' ELSE 'completed' END AS status, CASE WHEN event_type NOT IN ('click','view') THEN CAST(floor(value * 100) AS BIGINT) END AS latency_ms, ts AS created_at FROM events",
    "v_cost": "SELECT event_id AS id, user_id, CAST(floor(value) AS BIGINT) AS total_tokens, CAST(CAST(CAST(floor(value) AS BIGINT) * 150 AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(6,6)) AS DECIMAL(18,6)) AS estimated_cost_usd, ts AS created_at FROM events WHERE event_type = 'purchase'",
    "v_user": "SELECT c_custkey AS id, c_name AS clerk_id, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name, CASE c_mktsegment WHEN 'MACHINERY' THEN 'admin' WHEN 'FURNITURE' THEN 'instructor' ELSE 'student' END AS role, c_acctbal < 0 AS deleted FROM customer",
    "v_conversation": "SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS created_at FROM events GROUP BY 1, 2",
    "v_daily": "SELECT user_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS activity_date, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS login_count FROM events GROUP BY 1, 2",
    "v_embedding": "SELECT vec_id AS chunk_id, label AS document_id, embedding, CASE WHEN label >= 8 THEN 'legacy' ELSE 'local' END AS embedding_provider, 'm1' AS embedding_model, len(embedding) AS embedding_dimensions, label <> 0 AS is_active FROM embeddings",
    "v_turn": "SELECT conv_id, turn + 1 AS sequence, role, text AS content, 'completed' AS status FROM conversations",
}


def sql(body: str, *views: str) -> str:
    """A query with the named views in front."""
    head = ", ".join(f"{v} AS ({SQL_VIEWS[v]})" for v in views)
    rest = body.strip()
    for begin in ("WITH RECURSIVE ", "WITH "):
        if rest.startswith(begin):
            return f"{begin}{head}, {rest[len(begin) :]}"
    return f"WITH {head} {rest}"
