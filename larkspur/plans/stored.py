"""Queries that write to a store of versioned tables and read it back: turns, accounts, appends and the checks of an index, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur import adapters as A
from larkspur.operators import index
from larkspur.plans.registry import query
from larkspur.session import shared_path, table
from larkspur.sources.versions import Store, append_once
from larkspur.streaming import activity


@query(
    """WITH l AS (SELECT conv_id, max(turn + 1) AS last FROM conversations GROUP BY 1),
    n AS (SELECT doc_id // 3 AS conv_id, doc_id AS arrival, doc_id % 2 AS batch, coalesce(last, 0) AS last, CASE WHEN doc_id % 3 = 2 THEN 1 ELSE coalesce(last, 0) END AS base FROM documents LEFT JOIN l ON l.conv_id = doc_id // 3),
    r AS (SELECT *, base = last AS current, row_number() OVER (PARTITION BY conv_id, base = last ORDER BY batch, arrival) AS place FROM n),
    w AS (SELECT conv_id, batch AS won FROM r WHERE current AND place = 1)
    SELECT r.conv_id, arrival, CASE WHEN current AND place = 1 THEN 'won' ELSE 'MessageSequenceConflict' END AS outcome,
      CAST(CASE WHEN current AND place = 1 THEN last + 1 WHEN won <= batch THEN last + 2 ELSE last END AS BIGINT) AS sequence FROM r LEFT JOIN w ON w.conv_id = r.conv_id"""
)
def turn_claims(spark, d):
    """DML13: two batches of turns that saw the same sequences, the second one sent twice."""
    old = A.turns(spark, d).select("conv_id", F.col("sequence").cast("long").alias("sequence"), "role", "status", "content")
    last = old.groupBy("conv_id").agg(F.max("sequence").alias("last"))
    docs = table(spark, d, "documents").select(F.expr("doc_id div 3").alias("conv_id"), F.col("doc_id").alias("arrival"))
    base = F.when(F.col("arrival") % 3 == 2, F.lit(1).cast("long")).otherwise(F.coalesce("last", F.lit(0).cast("long")))
    new = docs.join(last, "conv_id", "left").select("conv_id", "arrival", F.concat(F.lit("turn "), F.col("arrival").cast("string")).alias("content"), base.alias("base_sequence"))
    store = Store(spark, shared_path(spark, "turns"))
    t = store.begin()
    t.put("messages", old, ("conv_id",), 16)
    t.put("conflicts", spark.createDataFrame([], "conv_id long, arrival long, content string, base_sequence long, error string, current_sequence long"))
    t.commit()
    for batch in (0, 1, 1):
        index.write_turns(store, new.where(F.col("arrival") % 2 == batch), "api", batch)
    added = store.read("messages").join(new.select("conv_id", "content", "arrival"), ["conv_id", "content"])
    won = added.where("role = 'user'").select("conv_id", "arrival", F.lit("won").alias("outcome"), "sequence")
    return won.unionByName(store.read("conflicts").select("conv_id", "arrival", F.col("error").alias("outcome"), F.col("current_sequence").alias("sequence")))


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, ts, event_id % 2 AS batch FROM events), c AS (SELECT c_custkey AS user_id, c_name AS name FROM customer),
    u AS (SELECT *, row_number() OVER (PARTITION BY user_id, batch ORDER BY ts DESC, event_id DESC) AS place FROM e WHERE event_type IN ('click', 'view')),
    u0 AS (SELECT user_id, ts, 'n' || event_id AS name FROM u WHERE batch = 0 AND place = 1), u1 AS (SELECT user_id, ts, 'n' || event_id AS name FROM u WHERE batch = 1 AND place = 1),
    every AS (SELECT user_id FROM c UNION SELECT user_id FROM u),
    d AS (SELECT user_id, min(ts) FILTER (batch = 0 AND (user_id IN (SELECT user_id FROM c) OR user_id IN (SELECT user_id FROM u0))) AS d0, min(ts) FILTER (batch = 1) AS d1 FROM e WHERE event_type = 'error' GROUP BY 1)
    SELECT CAST(y.user_id AS VARCHAR) AS clerk_id, CASE WHEN u1.ts IS NOT NULL AND (u0.ts IS NULL OR u1.ts >= u0.ts) THEN u1.name WHEN u0.ts IS NOT NULL THEN u0.name ELSE c.name END AS first_name, coalesce(d0, d1) AS deleted_at
    FROM every y LEFT JOIN c ON c.user_id = y.user_id LEFT JOIN u0 ON u0.user_id = y.user_id LEFT JOIN u1 ON u1.user_id = y.user_id LEFT JOIN d ON d.user_id = y.user_id"""
)
def account_changes(spark, d):
    """DML8, DML11, DML15: two batches of account events merged by bucket into stored accounts; the first one comes again at the end."""
    root = shared_path(spark, "accounts")
    store, none = Store(spark, root), F.lit(None).cast("timestamp")
    t = store.begin()
    t.put("user_account", table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("clerk_id"), F.col("c_name").alias("first_name"), F.lit("x").alias("last_name"), F.lit("student").alias("role"), none.alias("clerk_profile_updated_at"), none.alias("deleted_at")), ("clerk_id",), 16)
    t.commit()
    kind = F.when(F.col("event_type").isin("click", "view"), "user.updated").when(F.col("event_type") == "error", "user.deleted").otherwise("other")
    changes = table(spark, d, "events").select("event_id", kind.alias("type"), F.col("user_id").cast("string").alias("clerk_id"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("first_name"), F.lit("y").alias("last_name"), F.col("ts").cast("timestamp").alias("profile_at"), F.col("event_id").alias("arrival"))
    sink = activity.profile_sink(root)
    for batch in (0, 1, 0):
        sink(changes.where(F.col("event_id") % 2 == batch).drop("event_id"), batch)
    return store.read("user_account").select("clerk_id", "first_name", F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'no assistant_message_id' WHEN floor(value) < 20 THEN 'too few tokens' ELSE 'kept' END AS outcome FROM events"""
)
def cost_append(spark, d):
    """SNK2: cost components appended in two batches, each sent twice; what is refused is kept with its reason."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("string")).alias("assistant_message_id"), F.floor("value").cast("long").alias("tokens"))
    store = Store(spark, shared_path(spark, "costs"))
    refuse = {"no assistant_message_id": F.col("assistant_message_id").isNull(), "too few tokens": F.col("tokens") < 20}
    for batch in (0, 0, 1, 1):
        append_once(store, "costs", rows.where(F.col("event_id") % 2 == batch), "turns", batch, refuse)
    return store.read("costs").select("event_id", F.lit("kept").alias("outcome")).unionByName(store.read("costs_refused").select("event_id", F.col("reason").alias("outcome")))


@query(
    """WITH c AS (SELECT doc_id // 3 AS document_id, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN doc_id - 1 ELSE doc_id END AS chunk_id, CASE WHEN doc_id % 7 = 1 THEN 0 ELSE doc_id % 3 END AS chunk_index FROM documents),
    v AS (SELECT vec_id // 2 AS chunk_id, label = 3 AS unfit FROM embeddings), i AS (SELECT DISTINCT chunk_id FROM c WHERE chunk_id IS NOT NULL), n AS (SELECT chunk_id, count(*) AS k FROM v GROUP BY 1)
    SELECT error, CAST(n AS BIGINT) AS n FROM (
      SELECT 'chunk without id' AS error, count(*) AS n FROM c WHERE chunk_id IS NULL
      UNION ALL SELECT 'chunk id repeated', (SELECT count(chunk_id) FROM c) - (SELECT count(*) FROM i)
      UNION ALL SELECT 'chunk index repeated', (SELECT count(*) FROM c) - (SELECT count(*) FROM (SELECT DISTINCT document_id, chunk_index FROM c))
      UNION ALL SELECT 'chunk without embedding', count(*) FROM i WHERE chunk_id NOT IN (SELECT chunk_id FROM n)
      UNION ALL SELECT 'more than one embedding', coalesce(sum(k - 1), 0) FROM n WHERE k > 1 AND chunk_id IN (SELECT chunk_id FROM i)
      UNION ALL SELECT 'embedding without chunk', coalesce(sum(k), 0) FROM n WHERE chunk_id NOT IN (SELECT chunk_id FROM i)
      UNION ALL SELECT 'embedding breaks the contract', count(*) FROM v WHERE unfit) WHERE n > 0"""
)
def index_violations(spark, d):
    """DML2, NM5: what forbids the replacement of an index in which every rule is broken somewhere."""
    i = F.col("doc_id")
    chunks = table(spark, d, "documents").select(F.expr("doc_id div 3").alias("document_id"), F.when(i % 17 != 0, F.when(i % 11 == 1, i - 1).otherwise(i)).alias("chunk_id"), F.when(i % 7 == 1, 0).otherwise(i % 3).alias("chunk_index"))
    vectors = table(spark, d, "embeddings").select(F.expr("vec_id div 2").alias("chunk_id"), "embedding", F.lit("local").alias("provider"), F.when(F.col("label") == 3, "other").otherwise("m1").alias("model"), F.lit(64).alias("dimensions"))
    return index.violations(chunks, vectors, index.Contract("local", "m1", 64)).groupBy("error").agg(F.sum("n").alias("n"))
