"""The service's queries against their SQL, and its kernels against small cases."""

import datetime as dt
import decimal
import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import chunking, citations, dml, embedding, guardrails, ingestion, reports, search
from larkspur.plans import queries
from larkspur.sources import corpus
from larkspur.windows import instructor_window, month_range, resolve

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else str(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, db, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rows = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rows.fetchall()), key=repr)


def test_windows():
    w = instructor_window("2026-03-08", "2026-03-09")
    assert w.start.hour == 5 and (w.end - w.start) == dt.timedelta(hours=23)
    for bad in (("2026-5-01", None), ("2026-05-02", "2026-05-02"), ("2024-01-01", "2026-01-01")):
        with pytest.raises(ValueError):
            resolve(*bad)
    assert resolve(None, None, now=dt.datetime(2026, 1, 10, tzinfo=dt.UTC)).from_date == dt.date(2026, 1, 4)
    assert month_range(dt.date(2024, 2, 11)) == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))


def test_text_functions(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    assert one(T.collapse(F.lit(" a  \n\x1c b "))) == "a b"
    assert [one(T.canonical_path(F.lit(p))) for p in ("./a//b/./c", "", "a\\b", "../x", "/a/")] == ["a/b/c", ".", "a/b", "../x", "/a"]
    import uuid

    assert one(T.uuid5(str(uuid.NAMESPACE_DNS), F.lit("x.example"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "x.example"))
    assert one(T.heading_label(F.array(F.lit(" A "), F.lit(" "), F.lit("B")), F.lit("s"))) == "A > B"
    assert one(T.bearer_token(F.lit("Bearer  abc"))) == "abc" and one(T.bearer_token(F.lit("Bearer a b"))) is None
    assert one(T.url_decoded(F.lit("a%20b+c"))) == "a b+c"
    assert one(T.highlighted(F.lit("Cat cats"), "cat")) == "<mark>Cat</mark> <mark>cat</mark>s"
    assert one(T.client_key(F.lit(" 1.1.1.1, 2"), F.lit("h"))) == "1.1.1.1" and one(T.client_key(F.lit(None).cast("string"), F.lit(""))) == "unknown"
    assert one(reports.rounded_latency(F.lit(2.5))) == 2 and one(reports.cost_text(F.lit("1.2345665").cast("decimal(18,12)"))) == "1.234566"
    assert one(T.detail_label(F.lit("modelCount"))) == "Model Count"


DOC = "intro text.\n\n# One\n\nA sentence here. Another one!\n\n- a\n- b\n\n## Two\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n```py\ncode = 1\n```\n\n~~~\nopen fence"


def test_chunker_keeps_its_invariants():
    rng = random.Random(1)
    for size in (60, 200, 1000):
        o = chunking.Options(size, size // 5, min(120, size), 4 * size)
        for text in (DOC, DOC * 5, "word " * 900, "x" * 3000, "", "\r\n \x85 ", "".join(rng.choices("ab .#-|`~\n", k=2000))):
            lf = text.replace("\r\n", "\n")
            made = chunking.chunk_text("d", text, o)
            assert [c["chunk_index"] for c in made] == list(range(len(made))) and len({c["chunk_id"] for c in made}) == len(made)
            assert made == chunking.chunk_text("d", text, o)
            for c in made:
                assert 0 <= c["char_start"] < c["char_end"] and (c["section_heading"] is None) == (c["heading_path"] == [])
                if "rendered_content_differs" not in dict(c["metadata"]):
                    assert lf[c["char_start"] : c["char_end"]] == c["content"]
    kinds = [(c["chunk_type"], c["heading_path"]) for c in chunking.chunk_text("d", DOC, chunking.Options(least=0))]
    assert ("table", ["One", "Two"]) in kinds and ("code", ["One", "Two"]) in kinds and ("list", ["One"]) in kinds
    with pytest.raises(ValueError):
        chunking.Options(10, 10)


def test_citations_are_normalised():
    text = "See [1], [2](http://x), [o](citation:3), `[4](u)`, ![5](i), [6][lab] and [7][none]\n\n[lab]: http://y\n[8]: http://z\n  more\n[0]: http://w\n"
    assert citations.normalise(text) == "See [1], [2], [o], `[4](u)`, ![5](i), [6] and [7][none]\n\n[lab]: http://y\n[0]: http://w\n"
    assert citations.normalise("[ 3 ](citation:3) and [x](citation:%33)") == "[3] and [x]"
    assert citations.normalise(None) is None


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("Both [1][2].", ["1", "2"]),
        ("Both [1][2].\n\n[2]: https://x.example", ["1"]),
        ("One [1].\n\n[1]: https://x.example", ["1"]),
        ("[1]: https://x.example", []),
        ("As in [1]: so it is, [9] too.", ["1"]),
        ("[2](https://x.example), [1], again [2].", ["2", "1"]),
        ("Not [docs [1] and [2]](https://x.example), but [3].", ["3"]),
        ("[1][s], not [s [2]][d] nor [label][3]; [4].\n\n[s]: http://x\n[d]: http://x\n[3]: http://x", ["1", "4"]),
        ("`[1]` and ![2](i.png)\n\n```\n[3]\n```\n\n[4]", ["4"]),
        ("[", []),
        ("", []),
    ],
)
def test_cited_ids(text, ids):
    assert citations.cited(text, {"1", "2", "3", "4"}) == ids


def test_visible_text(spark):
    assert citations.visible("# T\n\n**bold** _x_ [l](u) ![i](u) `a*b*`\n> q\n\n| a | b |\n|---|---|\n") == "T bold x l a*b* q a b"


def test_chunker_headings_rulers_and_lists():
    kinds = lambda t: [(c["chunk_type"], c["heading_path"]) for c in chunking.chunk_text("d", t, chunking.Options(least=0))]
    assert kinds("# C#\n\nx y") == [("prose", ["C"])]
    assert kinds("## A ##\n\nx y") == [("prose", ["A"])]
    assert kinds("a | b\n- | -\n") == [("prose", [])] or kinds("a | b\n- | -\n")[0][0] != "table"
    assert kinds("a | b\n--- | ---\n1 | 2") == [("table", [])]
    assert kinds("1234567890. x") == [("list", [])]


def test_genuine_replacement_characters_and_percent_signs_stay(spark):
    rows = spark.createDataFrame([("a\ufffdb\r\n".encode(),), ("a\ufffd".encode() + b"\xffb",)], "content binary")
    assert [r[0] for r in rows.select(corpus.decoded(F.col("content"))).collect()] == ["a\ufffdb\n", "a\ufffdb"]
    assert [r[0] for r in spark.createDataFrame([("50%",), ("a%2Fb+%zz",)], "u string").select(T.url_decoded(F.col("u"))).collect()] == ["50%", "a/b+%zz"]


def test_daily_activity_stream(spark, tmp_path):
    from larkspur.streaming.activity import daily_activity

    rows = [(1, dt.datetime(2024, 1, 5, 20)), (1, dt.datetime(2024, 1, 6, 2)), (1, dt.datetime(2024, 1, 6, 12))]
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = daily_activity(spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((str(r.activity_date), r.login_count) for r in spark.table("daily").collect()) == [("2024-01-05", 2), ("2024-01-06", 1)]


def test_dedup_compares_with_retained_only(spark):
    rows = [(1, 1, "a", "d", "h1", "x", 0, 100), (1, 2, "b", "d", None, " X ", 5, 100), (1, 3, "c", "e", "h1", "y", 0, 10), (1, 4, "e", "f", None, "x", 0, 10), (1, 5, "b", "d", "h9", "z", 200, 300)]
    df = spark.createDataFrame(rows, "query_id long, rank int, chunk_id string, document_id string, content_hash string, content string, char_start int, char_end int")
    got = search.retrieve(df, search.Settings()).first()
    assert [c.chunk_id for c in got.retained] == ["a", "b"] and [c["rank"] for c in got.retained] == [1, 5]
    assert [(s.chunk_id, s.reason) for s in got.suppressed] == [("b", "overlapping_offsets"), ("c", "content_hash"), ("e", "normalized_content")]
    with pytest.raises(ValueError):
        search.Settings(top_k=60)


def test_guardrails(spark):
    df = spark.range(1).select(F.array(guardrails.no_check(F.lit("ok")), guardrails.check_input(F.lit("my password"))).alias("c"))
    got = df.select(guardrails.composite(F.col("c")).alias("g")).first().g
    assert got.verdict.rail == "regex:secrets" and len(got.passed) == 1
    assert guardrails.providers(True, True, True, False) == {"input": ["regex", "judge"], "output": ["noop"]}
    prices = spark.createDataFrame([("m", 0.5, 1.0)], "model string, prompt_price double, completion_price double")
    rows = spark.createDataFrame([("m", 2, 1, False), ("n", 2, 1, False), ("n", 1, 1, True)], "model string, prompt_tokens int, completion_tokens int, failed boolean")
    assert sorted((str(r.estimated_cost_usd), r.status) for r in guardrails.estimated(rows, prices).collect()) == [("2.000000000000", "completed"), ("None", "cost_unavailable"), ("None", "failed")]


def test_merges(spark):
    old = spark.createDataFrame([(1, "2024-01-01", 1, 5, 2)], "user_id long, activity_date string, first_seen_at long, last_seen_at long, login_count long")
    new = spark.createDataFrame([(1, "2024-01-01", 0, 3, 1), (2, "2024-01-01", 7, 8, 4)], old.schema)
    assert sorted(map(tuple, dml.merge_daily(old, new).collect())) == [(1, "2024-01-01", 1, 3, 3), (2, "2024-01-01", 7, 8, 4)]
    made = dml.insert_missing(spark.createDataFrame([(1, "a")], "id long, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "id long, v string"), ["id"])
    assert sorted(map(tuple, made.collect())) == [(1, "a", False), (2, "c", True)]
    assert dml.may_reconcile(True, False, 1, 0, 0) and not dml.may_reconcile(True, False, 0, 0, 0)
    with pytest.raises(ValueError):
        dml.deactivate(old, spark.createDataFrame([], "source_path string"), F.current_timestamp(), "repo")


def test_corpus_files(spark, tmp_path):
    for name, body in (("week1/en/a.md", b"# A\r\nx\xff"), ("node_modules/b.md", b"no"), ("c.PY", b"print()"), ("d.bin", b"no"), ("Monday.ipynb", b'{"cells":[{"cell_type":"code","source":["a","b"]},{"source":"c"}]}')):
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    got = {r.source_path: r for r in corpus.documents(spark, str(tmp_path / "root")).collect()}
    assert set(got) == {"week1/en/a.md", "c.PY", "Monday.ipynb"}
    assert got["week1/en/a.md"].text == "# A\nx" and got["week1/en/a.md"].week == "week1"
    assert got["Monday.ipynb"].text == "[code cell]\nab\n\n[unknown cell]\nc" and got["Monday.ipynb"].day == "Monday.ipynb"


def test_embedding_keeps_order_and_checks_lengths(spark):
    chunks = chunking.chunk(spark.createDataFrame([(1, DOC)], "doc_id long, text string"))
    made = embedding.embedded(chunks.select("chunk_id", "content"), chunking.hash_embedder(16), 16)
    assert all(len(r.embedding) == 16 for r in made.collect())
    with pytest.raises(Exception, match="another number or length"):
        embedding.embedded(chunks.select("content"), chunking.hash_embedder(8), 16).collect()


def test_ingest_keeps_unread_files_and_replaces_chunks(spark):
    now = F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))
    fields = "id long, source_type string, source_path string, title string, course_name string, content_hash string, is_active boolean, deleted_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
    old = spark.createDataFrame([(i, "repo", f"x/en/{p}", "t", "c", "h", True, None, None, None) for i, p in enumerate("abcd")], fields)
    scan = lambda b: spark.createDataFrame([(10, "x/en/a", "n", "# A\n\nwords"), (11, "x/en/b", "n", b), (12, "x/en/e", "n", "more"), (13, "x/fr/c", "n", "pas")], "id long, source_path string, title string, text string")
    settings = ingestion.Settings("repo", "c", reconcile=True, dimensions=8)
    active = lambda made: sorted(r.source_path for r in made.documents.where("is_active").collect())
    blank = ingestion.ingest(scan(" \n"), old, None, now, settings, chunking.hash_embedder(8))
    assert active(blank) == ["x/en/a", "x/en/e"] and blank.counts["skipped_empty"] == 1
    assert sorted((r.source_path, len(r.embedding)) for r in blank.chunks.collect()) == [("x/en/a", 8), ("x/en/e", 8)]
    failed = ingestion.ingest(scan(None), old, None, now, settings)
    assert active(failed) == ["x/en/a", "x/en/b", "x/en/c", "x/en/d", "x/en/e"] and failed.counts["failed"] == 1
    again = ingestion.ingest(scan("b now"), old, failed.chunks, now, settings)
    assert sorted((r.source_path, r.content) for r in again.chunks.collect()) == [("x/en/a", "# A\n\nwords"), ("x/en/b", "b now"), ("x/en/e", "more")]
    with pytest.raises(ValueError, match="could not be read"):
        ingestion.ingest(scan(None), old, None, now, ingestion.Settings(fail_fast=True))
    with pytest.raises(ValueError, match="more than once"):
        ingestion.ingest(scan("b").union(scan("b")), old, None, now, settings)
    empty = ingestion.ingest(scan("b").limit(0), old, None, now, settings)
    assert active(empty) == ["x/en/a", "x/en/b", "x/en/c", "x/en/d"] and empty.chunks is None
