"""Guardrails and costs (GR, CO, EV, JS1-2, NM6-7). Outcomes of models are input columns.

Defined results: a null text is not blocked and a null answer of a judge blocks; costs without a price, or with a null number of tokens, are null with their status; repeated rows are judged each;
empty tables give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import text as T


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    category: str
    reason: str
    #: Texts, one of which every match holds; without them the pattern itself is tried on each text.
    words: tuple[str, ...] = ()


#: Ordered; the first that matches blocks. Patterns are parameters, these are defaults of our own wording.
RULES = (
    Rule("prompt_injection", r"(?iU)\b(ignore|disregard|forget)\b\s+(all\s+|any\s+)?(previous|prior|above|earlier)\s+(instructions?|rules?|prompts?)\b", "prompt_injection", "The message tries to replace the rules of the conversation.", ("ignore", "disregard", "forget")),
    Rule("confidential_instructions", r"(?isU)\b(show|reveal|print|repeat|tell)\b.{0,60}\b(system prompt|hidden instructions?|developer message)\b", "confidential_instructions", "The message asks for instructions that are not shown.", ("system prompt", "hidden instruction", "developer message")),
    Rule("secrets", r"(?iU)\b(api[\s_-]?keys?|passwords?|secret[\s_-]?keys?|access[\s_-]?tokens?)\b", "secrets", "The message asks for, or holds, secrets.", ("password", "api", "secret", "access")),
    Rule("academic_integrity", r"(?iU)\b(do|solve|write|complete)\b\s+(my|the|this)\s+(homework|assignment|exam|quiz|essay)\b", "academic_integrity", "The message asks for finished graded work.", ("homework", "assignment", "exam", "quiz", "essay")),
)


def check_input(c: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """GR1, SO9: struct(blocked, rail, category, reason, length). A null text is not blocked."""
    length = F.length(c).alias("length")

    def verdict(r: Rule | None) -> Column:
        text = (lambda v: F.lit(v).cast("string")) if r is None else F.lit
        return F.struct(F.lit(r is not None).alias("blocked"), text(r and f"regex:{r.id}").alias("rail"), text(r and r.category).alias("category"), text(r and r.reason).alias("reason"), length)

    out = None
    for r in rules:
        hit = F.coalesce(c.rlike(r.pattern), F.lit(False))
        out = F.when(hit, verdict(r)) if out is None else out.when(hit, verdict(r))
    if out is None:
        return verdict(None)
    out = out.otherwise(verdict(None))
    if all(r.words for r in rules):
        # One look for any of the rules' words settles most texts.
        out = F.when(~c.rlike("(?iU)" + "|".join(re.escape(w) for r in rules for w in r.words)), verdict(None)).otherwise(out)
    return out


def no_check(c: Column) -> Column:
    """GR2."""
    return check_input(c, ())


def composite(checks: Column) -> Column:
    """GR4 over an array of verdicts: the first that blocks, and the rails passed before it."""
    blocked = F.filter(checks, lambda v: v["blocked"])
    at = F.coalesce(F.array_position(F.transform(checks, lambda v: v["blocked"]), True), F.lit(0))
    before = F.when(at > 0, F.slice(checks, F.lit(1), (at - 1).cast("int"))).otherwise(checks)
    return F.struct(F.get(blocked, 0).alias("verdict"), F.transform(before, lambda v: v["rail"]).alias("passed"))


def providers(enabled: bool, regex: bool, judge: bool, output: bool) -> dict[str, list[str]]:
    """GR5: which checks run on input and output."""
    if not enabled:
        return {"input": ["noop"], "output": ["noop"]}
    inputs = ["regex"] * regex + ["judge"] * judge
    return {"input": inputs or ["noop"], "output": ["judge"] if output and judge else ["noop"]}


#: Where an object can begin: its brace, then its end, or a key, a colon and how a value begins. Each text that parses from a brace begins so.
_START = r'\{[ \t\r\n]*+(?:\}|"[^"\\]*+(?:\\.[^"\\]*+)*+"[ \t\r\n]*+:[ \t\r\n]*+(?:["{\[0-9-]|true|false|null))'


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def first_object(c: Column) -> Column:
    """JS1: the first whole JSON object, from any brace on, as a variant; null if there is none. Linear in the text for each brace before it that a key with a value or a brace follows.

    Spark stops after the first value and ignores what follows, so what begins at a brace is parsed as it stands.
    """

    def parsed(text: Column) -> Column:
        return F.when(text != "", F.coalesce(F.try_parse_json(text), _once(F.split(text, rf"(?s)(?={_START})"), later)))

    def later(parts: Column) -> Column:
        rest = lambda i: F.try_parse_json(F.array_join(F.slice(parts, i, F.size(parts)), ""))
        step = lambda found, i: F.when(found.isNotNull(), found).otherwise(rest(i))
        return F.when(F.size(parts) > 1, F.aggregate(F.sequence(F.lit(2), F.size(parts)), F.lit(None).cast("variant"), step))

    # Mostly the first start is it; only otherwise the text from there on is cut before each.
    return F.when(F.contains(c, F.lit("}")), _once(F.regexp_extract(c, rf"(?s){_START}.*+", 0), parsed))


def judge_json(c: Column) -> Column:
    """JS1: the verdict as a variant, null if unreadable: a fence at the start and one at the end are taken off; then the whole text if it is JSON (null if that is no object), else the first object in it.

    Of JSON as Spark reads it: an object that names a key twice is unreadable. A null answer is null.
    """
    # Spark stops after the first value and ignores what follows: the text is whole if an end mark behind it is the next value.
    end = "end of the text"
    item = lambda v, i: F.try_variant_get(v, f"$[{i}]", "string")

    def whole(text: Column) -> Column:
        framed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{end}"]')))
        return _once(framed, lambda v: F.coalesce(item(v, 1) == end, F.lit(False)) & F.try_variant_get(v, "$[2]", "variant").isNull())

    def read(text: Column) -> Column:
        # A whole object is the first one in it, and other values than lists and strings hold no brace.
        return F.when(~(text.rlike(r'(?s)^(?:\[.*\]|".*")$') & whole(text)), first_object(text))

    bare = lambda text: F.when(F.startswith(text, F.lit("```")), F.regexp_replace(F.regexp_replace(text, r"^```(?i:json)?\s*", ""), r"\s*```$", "")).otherwise(text)
    return _once(_once(T.strip(c), bare), read)


def normalised_verdict(v: Column) -> Column:
    """JS2, GR3, NM7: blocked must be a boolean; anything else is a block. A reason or rail that is no text is invalid and replaced, an empty rail as well; a confidence is a number or null.

    missing: fields that are not there; invalid: fields with a value that is not used, JSON null for rail, confidence and blocked included. A null verdict misses all fields.
    """
    names = ("blocked", "reason", "rail", "confidence")

    def made(f: Column, kind: Column) -> Column:
        text = lambda k: F.when(kind[k] == "STRING", F.nullif(F.try_variant_get(f[k], "$", "string"), F.lit("")))
        good = {"blocked": kind["blocked"] == "BOOLEAN", "reason": kind["reason"].isin("STRING", "VOID"), "rail": text("rail").isNotNull(), "confidence": kind["confidence"].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")}
        return F.struct(
            F.when(good["blocked"], F.try_variant_get(f["blocked"], "$", "boolean")).otherwise(True).alias("blocked"),
            F.coalesce(text("reason"), F.lit("no reason given")).alias("reason"),
            F.coalesce(text("rail"), F.lit("judge")).alias("rail"),
            F.when(good["confidence"], F.try_variant_get(f["confidence"], "$", "double")).alias("confidence"),
            F.array_compact(F.array(*[F.when(f[k].isNull(), k) for k in names])).alias("missing"),
            F.array_compact(F.array(*[F.when(f[k].isNotNull() & ~good[k], k) for k in names])).alias("invalid"),
        )

    kinds = lambda f: F.struct(*[F.coalesce(F.schema_of_variant(f[k]), F.lit("")).alias(k) for k in names])
    fields = F.try_variant_get(v, "$", f"struct<{', '.join(f'{k}: variant' for k in names)}>")
    return _once(fields, lambda f: _once(kinds(f), lambda kind: made(f, kind)))


def judge(answer: Column, error: Column, fail_open: bool) -> Column:
    """GR3: an error of the provider follows the flag; an unreadable answer blocks."""
    read = _once(normalised_verdict(judge_json(answer)), lambda v: F.struct(v["blocked"].alias("blocked"), v["reason"].alias("reason")))
    return F.when(error.isNotNull(), F.struct(F.lit(not fail_open).alias("blocked"), F.lit("provider error").alias("reason"))).otherwise(read)


def final_content(turns: DataFrame) -> DataFrame:
    """GR6, GR7, DML14: content and status from precomputed outcomes (input_reason, output_reason, provider_content, provider_error, repaired_content, repaired_reason)."""
    repaired = F.col("output_reason").isNotNull() & F.col("repaired_content").isNotNull() & F.col("repaired_reason").isNull()
    blocked = F.col("input_reason").isNotNull() | (F.col("output_reason").isNotNull() & ~repaired)
    content = F.when(F.col("input_reason").isNotNull(), F.col("input_reason")).when(repaired, F.col("repaired_content")).when(F.col("output_reason").isNotNull(), F.coalesce("repaired_reason", "output_reason")).otherwise(F.col("provider_content"))
    failed = ~blocked & ~repaired & F.col("provider_error").isNotNull()
    status = F.when(blocked, "blocked").when(failed, "failed").otherwise("completed")
    return turns.withColumns({"content": F.when(failed, F.lit("")).otherwise(content), "status": status, "repaired": repaired, "blocked_reason": F.when(blocked, content)})


def estimated(costs: DataFrame, prices: DataFrame) -> DataFrame:
    """NM6, CO1: cost by a price table (model, prompt_price, completion_price for a token; a row for each model, so it is broadcast). Unpriced: null and cost_unavailable; failed stays failed."""
    priced = costs.join(F.broadcast(prices), "model", "left")
    cost = (F.col("prompt_tokens") * F.col("prompt_price") + F.col("completion_tokens") * F.col("completion_price")).cast("decimal(18,12)")
    return priced.withColumn("estimated_cost_usd", cost).withColumn("status", F.when(F.col("failed"), "failed").when(cost.isNull(), "cost_unavailable").otherwise("completed")).drop("prompt_price", "completion_price")


def ledger(costs: DataFrame, request: str = "user_id", at: str = "created_at", tie: str = "id") -> DataFrame:
    """AG15, WN4: components of a request, numbered in order of time."""
    return costs.withColumn("component_order", F.row_number().over(W.partitionBy(request).orderBy(at, tie)))


def event_rows(df: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """EV1, EV3, EV4, SNK3, PRJ6, PRJ7: structured events, keys sorted, nested values as JSON."""
    return df.select(F.lit(kind).alias("event"), F.to_json(F.struct(*[F.col(f) for f in sorted(fields)])).alias("fields"))
