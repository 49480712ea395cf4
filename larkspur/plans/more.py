"""Queries of the smaller operators: conversations, text forms, merges, costs, events and audits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur import adapters as A
from larkspur.functions import text as T
from larkspur.operators import audits, chunking, citations, conversations, dml, embedding, events, guardrails, ratelimit, reports, search, visible_search
from larkspur.operators.index import Contract
from larkspur.plans.registry import query
from larkspur.session import shared_path, table
from larkspur.sources import corpus, coursefiles
from larkspur.sources.versions import Store
from larkspur.windows import clerk_time, elapsed_ms

_NOW = "2024-02-01 00:00:00"


def _now():
    return F.to_timestamp_ntz(F.lit(_NOW))


def _conversations(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct()
    at = lambda h: F.timestamp_add("HOUR", h, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    return c.select("id", (F.col("id") % 5).alias("user_id"), F.when(F.col("id") % 11 == 0, "deleted").otherwise("active").alias("status"), at((F.col("id") * 37 % 1000).cast("int")).alias("updated_at"), F.when(F.col("id") % 7 == 0, _now()).alias("deleted_at"))


_CONV = f"v_conv AS (SELECT id, id % 5 AS user_id, CASE WHEN id % 11 = 0 THEN 'deleted' ELSE 'active' END AS status, TIMESTAMP '2024-01-01 00:00:00' + to_hours(id * 37 % 1000) AS updated_at, CASE WHEN id % 7 = 0 THEN TIMESTAMP '{_NOW}' END AS deleted_at FROM (SELECT DISTINCT conv_id AS id FROM conversations))"


@query(f"WITH {_CONV} SELECT id, user_id, status, updated_at, CAST(row_number() OVER (ORDER BY updated_at DESC, id) AS BIGINT) AS place FROM v_conv WHERE user_id = 2 AND deleted_at IS NULL AND status <> 'deleted'")
def conversation_list(spark, d):
    rows = conversations.listed(_conversations(spark, d), F.lit(2)).drop("deleted_at")
    before = F.row_number().over(conversations.W.orderBy(F.desc("updated_at"), "id"))  # one owner's list
    return rows.withColumn("place", before.cast("long"))


@query(f"WITH {_CONV} SELECT conv_id, turn + 1 AS sequence, role, text AS content, 'completed' AS status FROM conversations WHERE conv_id IN (SELECT id FROM v_conv WHERE user_id = 2 AND deleted_at IS NULL AND status <> 'deleted')")
def message_list(spark, d):
    return conversations.messages_of(A.turns(spark, d), _conversations(spark, d), F.lit(2))


@query(
    """WITH m AS (SELECT conv_id, turn, role, CASE turn % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN turn % 3 = 0 THEN NULL ELSE text END AS content, CASE WHEN turn % 5 = 4 THEN NULL ELSE 'x' END AS citations FROM conversations)
    SELECT conv_id, turn, role, status, CASE WHEN role = 'assistant' AND status IN ('pending', 'failed') THEN coalesce(content, '') ELSE content END AS content,
      CASE WHEN citations IS NULL THEN 'citations are missing' WHEN content IS NULL AND NOT (role = 'assistant' AND status IN ('pending', 'failed')) THEN 'content is missing' END AS error FROM m"""
)
def message_responses(spark, d):
    t = table(spark, d, "conversations")
    status = F.when(F.col("turn") % 4 == 0, "pending").when(F.col("turn") % 4 == 1, "failed").otherwise("completed")
    rows = t.select("conv_id", "turn", "role", status.alias("status"), F.when(F.col("turn") % 3 != 0, F.col("text")).alias("content"), F.when(F.col("turn") % 5 != 4, F.array(F.lit("x"))).alias("citations"))
    return conversations.response(rows).drop("citations")


@query("SELECT doc_id, 'heading=' || coalesce(lang, '~') || ';kept=1;source_path=' || coalesce(source, '~') AS merged FROM documents")
def chunk_metadata(spark, d):
    stored = F.create_map(F.lit("kept"), F.lit("1"), F.lit("source_path"), F.lit("old"))
    docs = table(spark, d, "documents").withColumn("m", conversations.merged_metadata(stored, heading=F.col("lang"), source_path=F.col("source")))
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("~"))))
    return docs.select("doc_id", F.array_join(entries, ";").alias("merged"))


@query("SELECT vec_id, CASE WHEN label = 3 THEN 'query is empty' WHEN len(embedding) <> 64 THEN 'vector has another length' WHEN label < 1 THEN 'top_k is below 1' END AS error FROM embeddings")
def retrieval_checks(spark, d):
    e = table(spark, d, "embeddings")
    text = F.when(F.col("label") == 3, "  ").otherwise("q")
    return e.select("vec_id", conversations.retrieval_error(text, F.size("embedding"), 64, F.col("label")).alias("error"))


@query("SELECT conv_id, turn, turn % 4 < 2 AND text IS NOT NULL AS valid, CASE WHEN turn % 4 < 2 AND text IS NOT NULL THEN sha256(text) END AS content FROM conversations")
def stored_history(spark, d):
    t = table(spark, d, "conversations")
    good = F.array(F.struct(F.lit("h").alias("heading"), F.col("text").alias("content")))
    extra = F.array(F.struct(F.col("text").alias("content"), F.lit(1).alias("rank")))
    bare, odd = F.array(F.struct(F.col("text").alias("content"))), F.lit("not json")
    stored = F.when(F.col("turn") % 4 == 0, F.to_json(conversations.context_of(good))).when(F.col("turn") % 4 == 1, F.to_json(bare)).when(F.col("turn") % 4 == 2, F.to_json(extra)).otherwise(odd)
    made = t.select("conv_id", "turn", conversations.stored_context(stored).alias("s"))
    return made.select("conv_id", "turn", "s.valid", F.sha2(F.get("s.contexts", 0)["content"], 256).alias("content"))


@query(f"SELECT page_id AS id, page_id % 9 AS user_id, url AS title, 'active' AS status, 'default' AS model_profile_key, 'v2' AS model_profile_version, NULL::VARCHAR AS guardrails_config_id, 'i7' AS rag_index_version, TIMESTAMP '{_NOW}' AS created_at, TIMESTAMP '{_NOW}' AS updated_at, NULL::TIMESTAMP AS deleted_at FROM pages")
def conversation_create(spark, d):
    asked = table(spark, d, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 9).alias("user_id"), F.col("url").alias("title"))
    return conversations.created(asked, "default", "v2", None, "i7", _now())


@query(A.sql("SELECT user_id, string_agg(CAST(activity_date AS VARCHAR), ',' ORDER BY activity_date) AS ascending, string_agg(CAST(activity_date AS VARCHAR), ',' ORDER BY activity_date DESC) AS descending FROM v_daily GROUP BY 1", "v_daily"))
def activity_dates(spark, d):
    made = conversations.activity_days(A.daily_activity(spark, d))
    return made.select("user_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("ascending", "descending")])


@query("SELECT user_id AS conversation_id, event_id AS id, CAST(event_id % 4 AS INT) AS n_chunks FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_logs(spark, d):
    ids = F.slice(F.array(*map(F.lit, "abc")), F.lit(1), (F.col("event_id") % 4).cast("int"))
    logs = table(spark, d, "events").select(F.col("user_id").alias("conversation_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), ids.alias("retrieved_chunk_ids"))
    return conversations.latest_log(logs)


@query("SELECT coalesce(lang, 'none') AS chunker_version, count(*) AS chunks, count(*) FILTER (source IS NULL) AS source, count(*) FILTER (text IS NULL) AS text FROM documents GROUP BY 1")
def chunker_versions(spark, d):
    docs = table(spark, d, "documents").withColumn("chunker_version", F.coalesce("lang", F.lit("none")))
    return audits.version_counts(docs, "chunker_version", ["source", "text"])


NO_VIOLATIONS = "SELECT * FROM (VALUES ('heading_missing', 0::BIGINT), ('bad_offsets', 0), ('bad_hash', 0), ('blank_content', 0), ('repeated_index', 0), ('repeated_id', 0)) t(rule, violations)"


_PARTS = """WITH c AS (SELECT doc_id // 3 AS document_id, CASE WHEN doc_id % 11 = 1 THEN doc_id - 1 ELSE doc_id END AS chunk_id, CASE WHEN doc_id % 7 = 1 THEN 0 ELSE doc_id % 3 END AS chunk_index, text, doc_id % 5 - 1 AS a, doc_id % 5 + n_chars - 20 AS z, lang, doc_id FROM documents),
    d AS (SELECT DISTINCT doc_id // 3 AS document_id FROM documents WHERE doc_id // 3 % 4 <> 3), e AS (SELECT CASE WHEN vec_id % 13 = 0 THEN -vec_id - 1 ELSE vec_id END AS chunk_id FROM embeddings)"""


@query(
    _PARTS
    + """ SELECT 'heading_missing' AS rule, count(*) FILTER (lang = 'de') AS violations FROM c
    UNION ALL SELECT 'bad_offsets', count(*) FILTER (a < 0 OR z <= a) FROM c UNION ALL SELECT 'bad_hash', count(*) FILTER (doc_id % 9 = 0) FROM c
    UNION ALL SELECT 'blank_content', count(*) FILTER (trim(text) = '') FROM c
    UNION ALL SELECT 'repeated_index', (SELECT count(*) FROM c) - (SELECT count(*) FROM (SELECT DISTINCT document_id, chunk_index FROM c)) UNION ALL SELECT 'repeated_id', (SELECT count(*) FROM c) - (SELECT count(*) FROM (SELECT DISTINCT chunk_id FROM c))
    UNION ALL SELECT 'chunk_without_document', count(*) FROM c WHERE document_id NOT IN (SELECT document_id FROM d) UNION ALL SELECT 'inactive_document', count(*) FROM c JOIN d ON d.document_id = c.document_id WHERE c.document_id % 4 = 1
    UNION ALL SELECT 'embedding_without_chunk', count(*) FROM e WHERE chunk_id NOT IN (SELECT chunk_id FROM c) UNION ALL SELECT 'chunk_without_embedding', count(*) FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM e)"""
)
def chunk_rules_hold(spark, d):
    """AU3 over stored rows in which every rule is broken somewhere."""
    docs, i = table(spark, d, "documents"), F.col("doc_id")
    document = F.expr("doc_id div 3").alias("document_id")
    chunks = docs.select(
        document, F.when(i % 11 == 1, i - 1).otherwise(i).alias("chunk_id"), F.when(i % 7 == 1, 0).otherwise(i % 3).alias("chunk_index"), F.col("text").alias("content"), (i % 5 - 1).alias("char_start"), (i % 5 + F.col("n_chars") - 20).alias("char_end"),
        F.when(F.col("lang") == "de", F.array(F.lit("h"))).otherwise(F.array().cast("array<string>")).alias("heading_path"), F.lit(None).cast("string").alias("section_heading"), F.when(i % 9 == 0, "short").otherwise(F.sha2("text", 256)).alias("content_hash"),
    )
    stored = docs.select(document).distinct().where("document_id % 4 <> 3").withColumn("is_active", F.col("document_id") % 4 != 1)
    vectors = table(spark, d, "embeddings").select(F.when(F.col("vec_id") % 13 == 0, -F.col("vec_id") - 1).otherwise(F.col("vec_id")).alias("chunk_id"))
    return audits.chunk_audit(chunks, stored, vectors)


_SPACE = "[ \\t\\n\\v\\f\\r]"


@query(
    f"""SELECT doc_id, CASE WHEN lang IS NULL OR lang = '' THEN nullif(source, '') ELSE lang || ' > x' END AS heading, CASE WHEN length(text) > 2000 THEN sha256(substring(text, 1, 2000) || '...') ELSE sha256(text) END AS capped,
      CASE WHEN doc_id % 2 = 0 THEN 'hidden' WHEN doc_id % 3 = 0 THEN 'src' || doc_id END AS provider, coalesce(nullif(lang, ''), '') <> '' AS has_lang, sha256(text) AS body,
      sha256(regexp_replace(text, '(the)', '<mark>\\1</mark>', 'gi')) AS marked, CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id END AS token, CASE WHEN doc_id % 3 = 0 THEN '10.0.0.' || doc_id WHEN doc_id % 3 = 1 THEN 'host' ELSE 'unknown' END AS client,
      nullif(regexp_replace(regexp_replace(source, '^{_SPACE}+', ''), '{_SPACE}+$', ''), '') AS non_blank, 'a b+' || doc_id || '%' AS decoded, coalesce(contains(lower(coalesce(lang, 'Untitled conversation')), 'e'), false) AS title_hit
    FROM documents"""
)
def text_forms(spark, d):
    docs, i = table(spark, d, "documents"), F.col("doc_id").cast("string")
    third, odd = F.col("doc_id") % 3, F.col("doc_id") % 2 == 1
    model = F.when(third == 0, F.concat(F.lit("src"), i, F.lit("/m"))).otherwise("plain")
    path = F.array(F.coalesce("lang", F.lit(" ")), F.when(F.coalesce("lang", F.lit("")) == "", "").otherwise(" x "))
    return docs.select(
        "doc_id", T.heading_label(path, F.col("source")).alias("heading"), F.sha2(T.capped(F.col("text")), 256).alias("capped"), T.provider_name(F.when(~odd, "hidden"), model).alias("provider"),
        F.coalesce(T.non_blank(F.col("lang")), F.lit("")).alias("__l"), F.sha2(T.without_front_matter(F.concat(F.lit("---\nt: 1\n---\n\n"), F.col("text"))), 256).alias("body"), F.sha2(T.highlighted(F.col("text"), "the"), 256).alias("marked"),
        T.bearer_token(F.concat(F.when(odd, "Basic T").otherwise("Bearer  T"), i)).alias("token"), T.client_key(F.when(third == 0, F.concat(F.lit("10.0.0."), i, F.lit(", 9"))), F.when(third == 1, "host")).alias("client"),
        T.non_blank(F.col("source")).alias("non_blank"), T.url_decoded(F.concat(F.lit("a%20b+"), i, F.lit("%"))).alias("decoded"), T.title_matches(F.col("lang"), "E ").alias("title_hit"),
    ).withColumn("has_lang", F.col("__l") != "").drop("__l")


@query("SELECT page_id, lower(substring(md5(url), 1, 8) || '-' || substring(md5(url), 9, 4) || '-' || substring(md5(url), 13, 4) || '-' || substring(md5(url), 17, 4) || '-' || substring(md5(url), 21, 12)) AS checked, 'Model Count' AS label, CASE WHEN page_id % 3 = 0 THEN 'Yes' WHEN page_id % 3 = 1 THEN 'No' ELSE 'Unavailable' END AS value FROM pages")
def checked_ids(spark, d):
    h = F.upper(F.md5("url"))
    made = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    third = F.col("page_id") % 3
    return table(spark, d, "pages").select("page_id", T.uuid_or_error(F.when(F.col("url").isNotNull(), made)).alias("checked"), T.detail_label(F.lit("modelCount")).alias("label"), T.detail_value(F.when(third == 0, True).when(third == 1, False)).alias("value"))


@query("SELECT conv_id, turn, 3 AS parts, sha256('intro|# A~' || rtrim('x' || regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ') || '|## B~y') AS joined FROM conversations WHERE text IS NOT NULL")
def heading_sections(spark, d):
    body = F.concat(F.lit("intro\n# A\nx"), F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit("\n\n## B\ny\n"))
    rows = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", T.sections(body).alias("s"))
    return rows.select("conv_id", "turn", F.size("s").alias("parts"), F.sha2(F.translate(F.array_join("s", "|"), "\n", "~"), 256).alias("joined"))


@query("SELECT event_id, make_timestamp(1700000000000000 + event_id * 1000) AS at, CASE WHEN value < 0 THEN 0 ELSE CAST(round_even(CAST(floor(value) AS DOUBLE) / 8 * 1000, 0) AS BIGINT) END AS elapsed FROM events")
def clock_forms(spark, d):
    e = table(spark, d, "events")
    millis = (F.lit(1_700_000_000_000) + F.col("event_id")).cast("string")
    return e.select("event_id", clerk_time(millis).cast("timestamp_ntz").alias("at"), elapsed_ms(F.floor("value").cast("double") / 8).alias("elapsed"))


@query("SELECT c_custkey, CASE WHEN r THEN 'new' ELSE c_name END AS first_name, CASE WHEN r THEN 'name' ELSE 'x' END AS last_name, r AS repaired FROM (SELECT *, c_custkey % 3 <> 0 AND c_acctbal >= 0 AS r FROM customer)")
def profile_repair(spark, d):
    stamp = F.when(F.col("c_custkey") % 3 == 0, _now())
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("first_name"), F.lit("x").alias("last_name"), F.lit("new").alias("claim_first"), F.lit("name").alias("claim_last"), stamp.alias("clerk_profile_updated_at"), F.when(F.col("c_acctbal") < 0, _now()).alias("deleted_at"))
    return dml.repair_profile(rows).select("c_custkey", "first_name", "last_name", "repaired")


@query(f"WITH {_CONV} SELECT id, user_id, CASE WHEN h THEN 'deleted' ELSE status END AS status, CASE WHEN h THEN TIMESTAMP '{_NOW}' ELSE updated_at END AS updated_at, CASE WHEN h THEN TIMESTAMP '{_NOW}' ELSE deleted_at END AS deleted_at FROM (SELECT *, id IN (SELECT user_id FROM events) AS h FROM v_conv)")
def conversation_delete(spark, d):
    return dml.delete_conversations(_conversations(spark, d), table(spark, d, "events").select(F.col("user_id").alias("id")), _now())


@query("SELECT CASE event_type WHEN 'signup' THEN 'upsert' WHEN 'click' THEN 'upsert' WHEN 'error' THEN 'delete' END AS kind, count(*) AS n FROM events WHERE event_type IN ('signup', 'click', 'error') GROUP BY 1")
def webhook_dispatch(spark, d):
    kind = F.col("event_type")
    named = F.when(kind == "signup", "user.created").when(kind == "click", "user.updated").when(kind == "error", "user.deleted").otherwise("other")
    parts = dml.dispatch(table(spark, d, "events").select("event_id", named.alias("type")))
    return parts["upserts"].select(F.lit("upsert").alias("kind")).unionByName(parts["deletes"].select(F.lit("delete").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, 'legacy_unknown') AS lang, coalesce(CASE WHEN doc_id % 3 = 0 THEN n_chars END, 384) AS n_chars FROM documents")
def backfilled(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("n_chars"))
    return dml.backfill(rows, {"lang": F.lit("legacy_unknown"), "n_chars": F.lit(384)})


@query("SELECT doc_id, 'new' AS v FROM labels UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def replaced_rows(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.lit("old").alias("v"))
    return dml.replace_rows(old, table(spark, d, "labels").select("doc_id", F.lit("new").alias("v")), "doc_id")


@query("SELECT c_custkey AS id, 'old' AS v, false AS created FROM customer UNION ALL SELECT DISTINCT user_id + 1000000, 'new', true FROM events WHERE user_id + 1000000 NOT IN (SELECT c_custkey FROM customer)")
def inserted_missing(spark, d):
    new = table(spark, d, "events").select((F.col("user_id") + 1_000_000).alias("id"), F.lit("new").alias("v"))
    both = new.unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("late").alias("v")))
    return dml.insert_missing(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("v")), both, ["id"])


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'cost_unavailable' ELSE 'completed' END AS status, CAST(CASE WHEN event_type = 'view' THEN NULL ELSE (event_id % 100) * 0.5 + 3 * 0.25 END AS DECIMAL(18,12))::VARCHAR AS cost FROM events")
def cost_estimates(spark, d):
    e = table(spark, d, "events")
    prices = e.select(F.col("event_type").alias("model")).distinct().where("model != 'view'").select("model", F.lit(0.5).alias("prompt_price"), F.lit(0.25).alias("completion_price"))
    rows = e.select("event_id", F.col("event_type").alias("model"), (F.col("event_id") % 100).alias("prompt_tokens"), F.lit(3).alias("completion_tokens"), (F.col("event_type") == "error").alias("failed"))
    return guardrails.estimated(rows, prices).select("event_id", "status", F.col("estimated_cost_usd").cast("string").alias("cost"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'regex:secrets' END AS rail, CASE WHEN turn % 2 = 1 THEN 1 ELSE 2 END AS passed, CASE WHEN turn % 3 = 0 THEN turn % 2 = 0 WHEN turn % 3 = 1 THEN true ELSE false END AS judged FROM conversations")
def guard_chain(spark, d):
    odd = F.col("turn") % 2 == 1
    second = guardrails.check_input(F.when(odd, "my password").otherwise("fine"))
    chain = guardrails.composite(F.array(guardrails.no_check(F.col("text")), second))
    third = F.col("turn") % 3
    answer = F.when(third == 0, F.when(odd, '{"blocked": false}').otherwise('```json\n{"blocked": true}\n```')).when(third == 1, "no verdict")
    verdict = guardrails.judge(answer, F.when(third == 2, "timeout"), fail_open=True)
    return table(spark, d, "conversations").select("conv_id", "turn", chain.alias("g"), verdict["blocked"].alias("judged")).select("conv_id", "turn", "g.verdict.rail", F.size("g.passed").alias("passed"), "judged")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN false ELSE true END AS blocked, CASE event_type WHEN 'click' THEN 'fine' ELSE 'no reason given' END AS reason, CASE event_type WHEN 'click' THEN CAST(0.5 AS DOUBLE) END AS confidence, CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 'blocked' ELSE '' END AS invalid FROM events")
def judge_answers(spark, d):
    kind = F.col("event_type")
    answer = F.when(kind == "click", 'so: {"blocked": false, "reason": "fine", "confidence": 0.5} .').when(kind == "view", '{"blocked": "yes"}').otherwise(F.col("props"))
    v = guardrails.normalised_verdict(guardrails.judge_json(answer))
    return table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", "v.blocked", "v.reason", "v.confidence", F.array_join("v.invalid", ",").alias("invalid"))


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 4 THEN true WHEN 5 THEN true ELSE user_id % 2 = 0 END AS blocked,
      CASE WHEN event_id % 6 < 4 THEN CASE event_id % 6 WHEN 1 THEN '}{ "' || event_type || '"' ELSE event_type END ELSE 'no reason given' END AS reason,
      CASE WHEN event_id % 6 < 4 THEN CAST(event_id AS DOUBLE) END AS confidence FROM events"""
)
def judge_objects(spark, d):
    """Verdicts inside other text: behind braces that open nothing, with braces and quotes in strings, nested, cut off, in a list."""
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    blocked = F.when(F.col("user_id") % 2 == 0, "true").otherwise("false")
    verdict = lambda reason: F.concat(F.lit('{"blocked": '), blocked, F.lit(', "reason": "'), reason, F.lit('", "confidence": '), number, F.lit(', "m": {"a": [{}]}}'))
    i = F.col("event_id") % 6
    answer = (
        F.when(i == 0, F.concat(F.lit("x {"), kind, F.lit('} {"'), kind, F.lit('" '), verdict(kind), F.lit(" }")))
        .when(i == 1, F.concat(F.lit("so "), verdict(F.concat(F.lit('}{ \\"'), kind, F.lit('\\"')))))
        .when(i == 2, F.concat(F.lit("```JSON\n"), verdict(kind), F.lit("\n```")))
        .when(i == 3, F.concat(F.lit('{"k": nothing} '), verdict(kind), verdict(F.lit("second"))))
        .when(i == 4, F.concat(F.lit("cut "), F.expr("left('{\"blocked\": false, \"reason\": \"x', 20)"), number))
        .otherwise(F.concat(F.lit("["), verdict(kind), F.lit("]")))
    )
    v = guardrails.normalised_verdict(guardrails.judge_json(answer))
    return table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", "v.blocked", "v.reason", "v.confidence")


@query(A.sql("SELECT conv_id, 'system' || string_agg('|' || role, '' ORDER BY sequence) AS roles, count(*) + 1 AS n FROM v_turn WHERE role IN ('user', 'assistant') GROUP BY 1", "v_turn"))
def assembled_messages(spark, d):
    made = search.assembled(search.history(A.turns(spark, d)), "be kind")
    return made.select("conv_id", F.array_join("messages.role", "|").alias("roles"), F.size("messages").cast("long").alias("n"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' AND r <= 3 THEN '{\"studentMessage\":\"m' || turn || '\"}' ELSE 'm' || turn END AS content FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant'))")
def history_payloads(spark, d):
    rows = A.turns(spark, d).withColumn("content", F.concat(F.lit("m"), (F.col("sequence") - 1).cast("string")))
    return search.history(rows).select("conv_id", (F.col("sequence") - 1).alias("turn"), "content")


@query("SELECT conv_id, turn, '1:' || coalesce(role, '') || ',2:t' || turn || ',3:' || conv_id AS records, CASE WHEN turn % 2 = 0 THEN '1,2' ELSE '1' END AS renderable FROM conversations")
def citation_lists(spark, d):
    heads = F.array(F.coalesce("role", F.lit("")), F.concat(F.lit("t"), F.col("turn").cast("string")), F.col("conv_id").cast("string"))
    made = search.citation_records(F.transform(heads, lambda h: F.struct(h.alias("heading"), F.lit("p").alias("source_path"), h.alias("content"))))
    odd = F.transform(made, lambda c, i: F.struct(F.when(i < 2 - F.col("turn") % 2, c["citationId"]).otherwise("").alias("citationId")))
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.array_join(F.transform(made, lambda c: F.concat(c["citationId"], F.lit(":"), c["heading"])), ",").alias("records"), F.array_join(F.transform(search.renderable(odd), lambda c: c["citationId"]), ",").alias("renderable"))


@query("SELECT 'seen' AS event, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS fields FROM events")
def event_log_rows(spark, d):
    return guardrails.event_rows(table(spark, d, "events"), "seen", ["event_type", "event_id"])


@query(
    """WITH e AS (SELECT *, event_id + 1 AS a, '"conversation_id":"c' || user_id % 9 || '"' AS c, '"user_id":"' || user_id || '","user_message_id":"' || event_id || '"' AS u, CAST(floor(value) AS BIGINT) AS n FROM events)
    SELECT event_id, 'guardrail.check.completed' AS event, '{"assistant_message_id":"' || a || '","blocked":' || (event_type = 'error') || ',"category":null,"confidence":"0.5",' || c || ',"fail_open":null,"guardrail_provider":"p-' || event_type || '","guardrail_stage":"input","judge_error":null,"latency_ms":' || n || ',"rail":"' || event_type || '","reason":"kind_' || event_type || '_' || user_id || '",' || u || '}' AS fields FROM e
    UNION ALL SELECT event_id, 'llm.generation.completed', '{"assistant_message_id":"' || a || '","completion_tokens":null,' || c || ',"finish_reason":"stop","generation_stage":"main","latency_ms":' || n || ',"model":"' || event_type || '","prompt_tokens":' || n || ',"request_id":"r' || event_id || '","total_tokens":null,' || u || '}' FROM e
    UNION ALL SELECT event_id, 'chat.repair.completed', '{"assistant_message_id":"' || a || '",' || c || ',"final_rail":"' || event_type || '","initial_blocked":true,"initial_rail":"x","latency_ms":' || n || ',"repair_passed":' || (event_type <> 'error') || ',' || u || '}' FROM e
    UNION ALL SELECT event_id, 'rag.retrieve.failed', '{"assistant_message_id":"' || a || '",' || c || ',"error_type":"Timeout","latency_ms":' || n || ',"retriever_class":"' || event_type || '",' || u || '}' FROM e WHERE event_type = 'error'"""
)
def request_events(spark, d):
    """EV1, PRJ6: events of four kinds with their own fields."""
    kind, i = F.col("event_type"), F.col("event_id")
    ids = {"user_message_id": i, "assistant_message_id": i + 1, "conversation_id": F.concat(F.lit("c"), (F.col("user_id") % 9).cast("string")), "latency_ms": F.floor("value").cast("long")}
    rows = table(spark, d, "events").withColumns(ids)
    result = F.struct((kind == "error").alias("blocked"), kind.alias("rail"), F.concat(F.lit(" Kind  "), kind, F.lit("\t"), F.col("user_id").cast("string")).alias("reason"), F.create_map(F.lit("provider"), F.concat(F.lit("p-"), kind), F.lit("confidence"), F.lit("0.5")).alias("metadata"))
    made = [
        (events.guardrail_fields(rows.withColumn("result", result).withColumn("guardrail_stage", F.lit("input"))), "guardrail.check.completed", None),
        (rows.withColumns({"generation_stage": F.lit("main"), "model": kind, "finish_reason": F.lit("stop"), "prompt_tokens": F.col("latency_ms"), "r": F.concat(F.lit("r"), i.cast("string"))}), "llm.generation.completed", "r"),
        (rows.withColumns({"repair_passed": kind != "error", "initial_blocked": F.lit(True), "initial_rail": F.lit("x"), "final_rail": kind}), "chat.repair.completed", None),
        (rows.where(kind == "error").withColumns({"error_type": F.lit("Timeout"), "retriever_class": kind}), "rag.retrieve.failed", None),
    ]
    every = [events.events(df, name, r).withColumn("event_id", F.get_json_object("fields", "$.user_message_id").cast("long")) for df, name, r in made]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])


@query(
    """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), r AS (SELECT conv_id, n, unnest(range(n)) AS k FROM c)
    SELECT conv_id, '{"backend":"b","candidate_count":' || any_value(n) || ',"chunk_count":' || ((any_value(n) + 1) // 2) || ',"chunks":[' || coalesce(string_agg('{"chunk_id":"k' || k || '","document_id":"' || conv_id || '"}', ',' ORDER BY k) FILTER (k % 2 = 0 AND k < 10), '')
      || '],"conversation_id":"' || conv_id || '","latency_ms":7,"retained_count":' || ((any_value(n) + 1) // 2) || ',"suppression_reasons":{' || CASE WHEN any_value(n) > 3 THEN '"chunk_id":' || count(*) FILTER (k % 4 = 3) || ',' ELSE '' END || CASE WHEN any_value(n) > 1 THEN '"content_hash":' || count(*) FILTER (k % 4 = 1) ELSE '' END || '},"user_id":null,"user_message_id":null}' AS fields FROM r GROUP BY conv_id"""
)
def retrieval_events(spark, d):
    """EV3: counts, reasons and the first five chunks of a search for each conversation, a candidate for each turn."""
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("candidates"))
    places = F.sequence(F.lit(0), F.col("candidates") - 1)
    chunk = lambda k: F.struct(F.concat(F.lit("k"), k.cast("string")).alias("chunk_id"), F.col("conv_id").cast("string").alias("document_id"), F.lit("not logged").alias("content"))
    retained = F.transform(F.filter(places, lambda k: k % 2 == 0), chunk)
    suppressed = F.transform(F.filter(places, lambda k: k % 2 == 1), lambda k: F.struct(F.when(k % 4 == 3, "chunk_id").otherwise("content_hash").alias("reason")))
    rows = per.withColumns({"retained": retained, "suppressed": suppressed, "conversation_id": F.col("conv_id"), "backend": F.lit("b"), "latency_ms": F.lit(7)})
    made = events.events(events.retrieval_fields(rows), "rag.provider.retrieve.completed")
    return made.select(F.get_json_object("fields", "$.conversation_id").cast("long").alias("conv_id"), "fields")


@query(
    A.sql(
        """WITH old AS (SELECT DISTINCT user_id, activity_date FROM v_daily WHERE activity_date < DATE '2024-01-15'), new AS (SELECT user_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS activity_date, ts FROM events WHERE event_type = 'signup'),
    every AS (SELECT * FROM old UNION SELECT user_id, activity_date FROM new), placed AS (SELECT *, activity_date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY activity_date) AS INTEGER) AS island FROM every),
    last AS (SELECT user_id, arg_max(activity_date, ts) AS activity_date FROM new GROUP BY 1)
    SELECT l.user_id, l.activity_date, (SELECT count(*) FROM placed q WHERE q.user_id = p.user_id AND q.island = p.island AND q.activity_date <= p.activity_date) AS current_streak, true AS logged_in_today FROM last l JOIN placed p ON p.user_id = l.user_id AND p.activity_date = l.activity_date""",
        "v_daily",
    )
)
def login_answers(spark, d):
    """RP5: signups as logins on top of the days before."""
    daily = A.daily_activity(spark, d).where("activity_date < DATE '2024-01-15'")
    return reports.record_logins(daily, table(spark, d, "events").where("event_type = 'signup'").select("user_id", F.col("ts").alias("seen_at")))[1]


@query(
    """SELECT conv_id, turn, to_json({'studentMessage': 'm' || turn, 'retrievedContext': [{'citationId': '1', 'heading': role, 'content': 'c "' || conv_id || '" é'}]}) AS current, to_json({'studentMessage': 'm' || turn, 'previousRetrievedContext': [role, 'é']}) AS earlier,
      to_json({'studentMessage': 'm' || turn, 'retrievedContext': [{'citationId': '1', 'heading': role, 'content': 'c "' || conv_id || '" é'}], 'draftAssistantResponse': CASE WHEN turn % 2 = 0 THEN 'd' || turn END}) AS repair FROM conversations"""
)
def prompt_payloads(spark, d):
    """JS3: the three payloads of a turn."""
    message, i = F.concat(F.lit("m"), F.col("turn").cast("string")), F.col("turn")
    chunks = F.array(F.struct(F.lit("1").alias("citationId"), F.col("role").alias("heading"), F.concat(F.lit('c "'), F.col("conv_id").cast("string"), F.lit('" é')).alias("content"), F.lit(1).alias("rank")))
    draft = F.when(i % 2 == 0, F.concat(F.lit("d"), i.cast("string")))
    return table(spark, d, "conversations").select("conv_id", "turn", events.prompt_payload(message, chunks).alias("current"), events.prompt_payload(message, previous=F.array("role", F.lit("é"))).alias("earlier"), events.prompt_payload(message, chunks, draft=draft).alias("repair"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'healthy' WHEN 'view' THEN 'warning' WHEN 'error' THEN 'unhealthy' ELSE 'unknown' END AS shown, CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'degraded' WHEN 'error' THEN 'unhealthy' ELSE 'not_checked' END AS checked FROM events")
def health_labels(spark, d):
    kind = F.col("event_type")
    raw = F.when(kind == "click", "OK").when(kind == "view", "degraded").when(kind == "error", "unhealthy").otherwise("?")
    checks = table(spark, d, "events").select("event_id", raw.alias("raw"), kind.isin("click", "view", "error").alias("resolved"), F.when(kind == "error", "x").alias("error"), F.when(kind == "view", 0).otherwise(3).alias("models"))
    return reports.provider_check(checks).select("event_id", reports.display_status(F.col("raw")).alias("shown"), F.col("status").alias("checked"))


_COPY = """WITH a AS (SELECT doc_id, lang, n_chars FROM documents), b AS (SELECT doc_id, lang, CASE WHEN doc_id % 50 = 7 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 97 <> 5),
    s AS (SELECT CASE WHEN doc_id % 20 = 0 THEN doc_id + 1 WHEN doc_id % 20 = 1 THEN doc_id - 1 ELSE doc_id END AS doc_id, lang, n_chars FROM documents)"""


def _copies(spark, d):
    """A table, one with changed and missing rows, and one in which neighbours have changed places."""
    a, i = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), F.col("doc_id")
    changed = a.where(i % 97 != 5).withColumn("n_chars", F.when(i % 50 == 7, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return a, changed, a.withColumn("doc_id", F.when(i % 20 == 0, i + 1).when(i % 20 == 1, i - 1).otherwise(i))


@query(
    _COPY
    + """ SELECT what, rows_a, rows_b, same_rows, same_order FROM (
      SELECT 'again' AS what, (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM a) AS rows_b, true AS same_rows, true AS same_order
      UNION ALL SELECT 'changed', (SELECT count(*) FROM a), (SELECT count(*) FROM b), NOT EXISTS (SELECT lang, n_chars FROM a EXCEPT ALL SELECT lang, n_chars FROM b), NOT EXISTS (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
      UNION ALL SELECT 'swapped', (SELECT count(*) FROM a), (SELECT count(*) FROM s), NOT EXISTS (SELECT lang, n_chars FROM a EXCEPT ALL SELECT lang, n_chars FROM s), NOT EXISTS (SELECT * FROM a EXCEPT ALL SELECT * FROM s))"""
)
def tables_compared(spark, d):
    a, changed, swapped = _copies(spark, d)
    made = [audits.verdict(a, b, ["doc_id"]).select(F.lit(what).alias("what"), "rows_a", "rows_b", "same_rows", "same_order") for what, b in (("again", a.repartition(3)), ("changed", changed), ("swapped", swapped))]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(_COPY + " SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def table_differences(spark, d):
    a, changed, _ = _copies(spark, d)
    return audits.differences(a, changed, ["doc_id"])


@query(
    """WITH c AS (SELECT doc_id, coalesce(text, '') AS content FROM documents), stored AS (SELECT DISTINCT content FROM c WHERE doc_id % 3 = 0)
    SELECT doc_id, content IN (SELECT content FROM stored) AS reused, CAST(CASE WHEN content IN (SELECT content FROM stored) THEN -1 ELSE length(content) END AS DOUBLE) AS first FROM c"""
)
def embedding_reuse(spark, d):
    """RAG8, SET4: vectors of a third of the documents are stored; the other contents are embedded, each once."""
    contract = Contract("local", "m1", 2)
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content")).withColumn("content_hash", F.sha2("content", 256))
    store = Store(spark, shared_path(spark, "vectors"))
    t = store.begin()
    known = chunks.where("chunk_id % 3 = 0").select("content_hash").distinct()
    t.put("vectors", known.select("content_hash", F.array(F.lit(-1.0), F.lit(0.0)).cast("array<float>").alias("embedding"), F.lit("local").alias("provider"), F.lit("m1").alias("model"), F.lit(2).alias("dimensions")), ("content_hash",), 16)
    t.commit()
    made = embedding.embed_into(store, chunks, lambda texts: [[float(len(t)), 1.0] for t in texts], contract, "ingest", 0)
    return made.select(F.col("chunk_id").alias("doc_id"), (F.get("embedding", 1) == 0).alias("reused"), F.get("embedding", 0).cast("double").alias("first"))


_SHOWN = "SELECT conv_id, turn, lower('T' || turn || ' ' || coalesce(role, '-') || ' said c ' || conv_id || ' in Turn ' || turn || ' and') AS v FROM conversations"


@query(
    f"""WITH m AS ({_SHOWN}), t(term_id, term) AS (VALUES (1, 'said'), (2, 'turn 1'), (3, 'er'), (4, ''), (5, 'said zz'), (6, 'c 1'), (7, 't'))
    SELECT term_id, conv_id, turn, CASE WHEN term = '' THEN 0 ELSE CAST((length(v) - length(replace(v, term, ''))) / length(term) AS BIGINT) END AS n FROM m, t WHERE contains(v, term)"""
)
def visible_text_search(spark, d):
    """FLT12, AG22: an index over Markdown made of each turn's columns, searched for terms of all kinds."""
    said = lambda *parts: F.concat(*[F.lit(p) if p not in ("turn", "conv_id", "role") else F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in parts])
    text = said("# T", "turn", "\n\n**", "role", "** said `c ", "conv_id", "` in [Turn ", "turn", "](http://x/er) and ![er](said)")
    root = shared_path(spark, "visible")
    visible_search.build(table(spark, d, "conversations").select("conv_id", "turn", text.alias("content")), root, ["conv_id", "turn"])
    terms = [(1, " Said"), (2, "turn 1"), (3, "ER"), (4, "  "), (5, "said zz"), (6, "c 1"), (7, "t")]
    asked = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("term_id"), F.lit(t).alias("term")) for i, t in terms])))
    return visible_search.search(spark, root, asked)


@query("SELECT page_id, 'day=' || page_id % 7 || ';week=' || coalesce(url, '') AS kept, coalesce(CASE WHEN page_id % 2 = 0 THEN '' END, 'camel') AS either FROM pages")
def log_metadata(spark, d):
    m = F.create_map(F.lit("week"), F.coalesce("url", F.lit("")), F.lit("day"), (F.col("page_id") % 7).cast("string"), F.lit("text"), F.coalesce("html", F.lit("")))
    kept = F.array_join(F.transform(F.array_sort(F.map_entries(T.allowed_metadata(m, ["week", "day"]))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    either = F.create_map(F.lit("source_path"), F.when(F.col("page_id") % 2 == 0, ""), F.lit("sourcePath"), F.lit("camel"))
    return table(spark, d, "pages").select("page_id", kept.alias("kept"), T.either_key(either, "source_path", "sourcePath").alias("either"))


@query("SELECT doc_id, CASE WHEN n_chars > 0 THEN least(n_chars, 10) / CAST(least(n_chars, 40) AS DOUBLE) END AS ratio FROM documents")
def overlaps(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", T.overlap_ratio(F.lit(0), n, F.lit(0) + F.greatest(n - 10, F.lit(0)), F.greatest(n - 10, F.lit(0)) + 40).alias("ratio"))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
    f AS (SELECT event_id, user_id, n, true AS admitted, [tm] AS times FROM e WHERE n = 1
      UNION ALL SELECT event_id, user_id, n, len(live) < 10, CASE WHEN len(live) < 10 THEN list_append(live, tm) ELSE live END
      FROM (SELECT e.event_id, e.user_id, e.n, e.tm, list_filter(f.times, lambda t: t > e.tm - 60000000) AS live FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
    SELECT event_id, user_id, admitted FROM f"""
)
def rate_limit_admissions(spark, d):
    return ratelimit.admitted(table(spark, d, "events"))


@query(
    """WITH f AS (SELECT coalesce(lang, 'xx') AS lang, doc_id % 40 AS part, doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS body FROM documents),
    n AS (SELECT lang || '/Week-' || part || '/day' || (part % 7) || '/' || doc_id || CASE part % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.py' ELSE '.ipynb' END AS source_path, part,
        CASE WHEN part % 5 = 3 THEN chr(10) || '[code cell]' || chr(10) || doc_id || chr(10) || chr(10) || chr(10) || '[unknown cell]' || chr(10) || body ELSE body END AS text FROM f WHERE part % 5 <> 4)
    SELECT source_path, 'Week-' || part AS week, 'day' || (part % 7) AS day, CASE part % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' WHEN 2 THEN 'py' ELSE 'ipynb' END AS file_type,
      sha256(regexp_replace(regexp_replace(text, '^[ \\t\\n\\v\\f\\r]+', ''), '[ \\t\\n\\v\\f\\r]+$', '')) AS sha FROM n"""
)
def course_files(spark, d):
    """SRC1-SRC5: each document is written as a file of one of the kinds, some below folders that are skipped, and read back."""
    part, text = F.col("part"), F.col("text")
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("xx")).alias("lang"), (F.col("doc_id") % 40).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    cells = F.to_json(F.struct(F.array(F.to_variant_object(F.struct(F.lit("code").alias("cell_type"), F.array(F.col("doc_id").cast("string"), F.lit("\n")).alias("source"))), F.to_variant_object(F.struct(text.alias("source")))).alias("cells")))
    suffix = F.element_at(F.array(*map(F.lit, (".md", ".TXT", ".py", ".ipynb", ".md"))), (part % 5 + 1).cast("int"))
    skipped = F.element_at(F.array(*map(F.lit, coursefiles.SKIPPED)), (F.expr("part div 5") % len(coursefiles.SKIPPED) + 1).cast("int"))
    folder = F.when(part % 5 == 4, skipped).otherwise(F.concat(F.lit("Week-"), part.cast("string")))
    path = F.concat_ws("/", "lang", folder, F.concat(F.lit("day"), (part % 7).cast("string")), F.concat(F.col("doc_id").cast("string"), suffix))
    root = shared_path(spark, "course-files")
    coursefiles.write(docs.select(path.alias("source_path"), F.encode(F.when(part % 5 == 3, cells).otherwise(text), "UTF-8").alias("content")), root)
    return corpus.documents(spark, root).select("source_path", "week", "day", "file_type", F.sha2("text", 256).alias("sha"))


#: What is planted behind a turn's text, the answer that is shown, and the records used.
_PLANTED = (
    ("See [1][2].", "See [1][2].", "1,2"),
    ("Cite [2](http://x), then `[3]` and [1].", "Cite [2], then `[3]` and [1].", "2,1"),
    ("Old [see](citation:3) and ![1](i.png).", "Old [see] and ![1](i.png).", ""),
    ("Ref [3][src]; [docs [1]](http://x).\n\n[src]: http://y\n[2]: http://z\n", "Ref [3]; [docs [1]](http://x).\n\n[src]: http://y\n", "3"),
)


@query(
    "SELECT conv_id, turn, CASE turn % 4 "
    + " ".join(f"WHEN {i} THEN sha256(regexp_replace(text, '[^A-Za-z ]', '', 'g') || ' ' || '{a}')" for i, (_, a, _) in enumerate(_PLANTED)).replace("\n", "' || chr(10) || '")
    + " END AS answer, CASE turn % 4 "
    + " ".join(f"WHEN {i} THEN '{u}'" for i, (_, _, u) in enumerate(_PLANTED))
    + " END AS used FROM conversations WHERE text IS NOT NULL"
)
def planted_citations(spark, d):
    rows = table(spark, d, "conversations").where("text is not null")
    planted = F.element_at(F.array(*[F.lit(t) for t, _, _ in _PLANTED]), (F.col("turn") % 4 + 1).cast("int"))
    records = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(i.cast("string").alias("citationId"), F.concat(F.lit("h"), i.cast("string")).alias("heading")))
    made = citations.validated(rows.select("conv_id", "turn", F.concat(F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit(" "), planted).alias("content"), records.alias("records")))
    return made.select("conv_id", "turn", F.sha2("answer", 256).alias("answer"), F.array_join("used.citationId", ",").alias("used"))
