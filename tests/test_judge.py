"""Verdicts of a judge: which object is read, and what its fields become, against the json module."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from larkspur.operators import guardrails


def read(text):
    """The object that is read, or None."""
    text = text.strip()
    if text.startswith("```"):
        text = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", text, flags=re.I))
    try:
        v = json.loads(text)
        return v if isinstance(v, dict) else None
    except ValueError:
        pass
    for i in (m.start() for m in re.finditer(r"\{", text)):
        try:
            return json.JSONDecoder().raw_decode(text, i)[0]
        except ValueError:
            continue
    return None


PROBES = [
    '{"blocked": true}', ' \n{"blocked": true}\t', '```json\n{"a": 1}\n```', '```{"a": 1}```', '```JSON {"a": [1, {"b": 2}]}', 'text ```{"a": 1}```', '{"a": 1}```', "{}", "x {} {\"a\": 1}",
    'x {not json} {"blocked": false, "m": {"a": 1}}', 'a {b} {"blocked": false}', '{"a": {"b": "}"}} tail }', '{"a": "\\"}{"} {"b": 2}', '{"a": "x\\\\"} {"b": 2}', '{"open {"a": 1}', '{ "a" : 1 , } {"b": 2}', '{"a": {"b": 1}', '{"a": {"b": 1} {"c": 3}',
    "[1, 2]", '[{"a": 1}]', '[{"a": 1}', '"text {}"', "12", "null", "", "   ", "{", "}", "}{", '{"', '{"a": "\n"} {"b": 1}', '{{"a": 1}}', '{"é": "ü{"} ', '{"a": tru} {"a": true}', "{\n\n\"a\": 1}", '{ }{"a":1}',
]


def result(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    v = guardrails.judge_json(F.col("t"))
    return [r.j for r in df.select("i", F.to_json(v).alias("j")).orderBy("i").collect()]


def test_probes(spark):
    got = result(spark, [*PROBES, None])
    assert got[-1] is None
    for text, j in zip(PROBES, got, strict=False):
        assert (json.loads(j) if j is not None else None) == read(text), text


def test_made_texts(spark):
    rng = random.Random(11)
    bits = ["{", "}", '"', "\\", '{"a": ', "1", '"x"', ",", " ", '{"b": {"c": "}"}}', ":", "[", "]", "{}", "\\\"", "word "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    texts = [t for t in texts if len(re.findall(r'"a"', t)) < 2]  # a key twice is read otherwise, and said so
    for text, j in zip(texts, result(spark, texts), strict=True):
        assert (json.loads(j) if j is not None else None) == read(text), text


def test_long_texts(spark):
    strings = '{"k": "' + "\\n{" * 20_000 + '", "blocked": true}'
    assert [json.loads(j)["blocked"] for j in result(spark, ["so " + strings, "{x} " * 20_000 + '{"blocked": true}'])] == [True, True]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('{"blocked": false, "reason": "r", "rail": "x", "confidence": 1}', (False, "r", "x", 1.0, [], [])),
        ('{"blocked": 1}', (True, "no reason given", "judge", None, ["reason", "rail", "confidence"], ["blocked"])),
        ('{"blocked": null, "reason": null}', (True, "no reason given", "judge", None, ["rail", "confidence"], ["blocked"])),
        ('{"blocked": false, "reason": 5, "rail": 5, "confidence": true}', (False, "no reason given", "judge", None, [], ["reason", "rail", "confidence"])),
        ('{"blocked": true, "reason": "", "rail": "", "confidence": null}', (True, "no reason given", "judge", None, [], ["rail", "confidence"])),
        ('{"blocked": false, "confidence": "0.5", "rail": {"a": 1}, "reason": []}', (False, "no reason given", "judge", None, [], ["reason", "rail", "confidence"])),
        ('{"blocked": false, "confidence": 2.5e-1}', (False, "no reason given", "judge", 0.25, ["reason", "rail"], [])),
        ("nothing", (True, "no reason given", "judge", None, ["blocked", "reason", "rail", "confidence"], [])),
    ],
)
def test_fields(spark, text, expected):
    v = spark.range(1).select(guardrails.normalised_verdict(guardrails.judge_json(F.lit(text))).alias("v")).first().v
    assert tuple(v) == expected


def test_an_answer_is_parsed_once_for_all_its_fields(spark):
    v = guardrails.normalised_verdict(guardrails.judge_json(F.concat(F.lit("so "), F.col("id").cast("string"))))
    plan = spark.range(1).select(v.alias("v")).select("v.blocked", "v.reason", "v.rail", "v.confidence")._jdf.queryExecution().optimizedPlan().toString()
    # The text as a list's item, the first object, and any later one.
    assert plan.count("parseJson") == 3 and plan.count("concat(so ") == 1


def test_starts_that_are_no_objects(spark):
    texts = [
        '{"a" {"b": 1}', '{"a": nothing} {"b": 1}', '{"a": 1 {"b": {"c": 2} {"d": 3}', '{"a": 1, "a": {"b": 1}}', '{"a": "cut {"b": 1}', 'x {"a": fals', 'x {"a": -1.5e3, "b": [{}]} {"c": 1}', '{"a\\"{": 1} y',
        '"{}" {"a": 1} "', '[1] {"a": 1} [2]', '["{", {"a": 1}]', '[{"a": 1}, ]', '"end of the text"', '{"a": true},"end of the text"', '1,"end of the text"', '```\n[{"a": 1}]\n```', '{"a"\n:\t{"b"\r: null}} {', '{"a": +1} {"b": 01} {"c": .5} {"d": 5}',
    ]
    for text, j in zip(texts, result(spark, texts), strict=True):
        expected = {"b": 1} if text == '{"a": 1, "a": {"b": 1}}' else read(text)  # a key twice is unreadable
        assert (json.loads(j) if j is not None else None) == expected, text


def test_many_keys_without_values(spark):
    assert [json.loads(j)["blocked"] for j in result(spark, ['{"' * 20_001 + ' {"blocked": true}', '{"k" ' * 20_000 + '{"blocked": true}'])] == [True, True]
