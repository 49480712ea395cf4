import base64
import hashlib
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm import warc
from larkspur.llm.files import read_file

DDL = "page_id long, url string, html string, digest string, body string"


def brute(rows):
    last = {}
    for i, _, h, *_ in rows:
        last[h or ""] = max(last.get(h or "", -1), i)
    out = []
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        first = last[h or ""] == i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else last[h or ""]))
    return sorted(out)


def make(n=300):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "http://www.b.example/x?q=1#f", "HTTPS://a.b.example:443/", "http://c.example", "odd url\r\n"]) if i % 3 else f"http://h{i % 9}.example/p{i}", rng.choice([None, "", "same", f"own {i} é\r\n\r\nx", "y" * 5000]), "clash", "clash") for i in range(n)]
    return rows


@pytest.mark.parametrize("most", [1, 1000])
def test_against_brute_force_and_read_back(spark, most):
    rows = make()
    index = warc.write_new(spark.createDataFrame(rows, DDL), file_bytes=3000, most_broadcast=most)
    back = warc.read_archives(index).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == brute(rows)
    html = {i: (h or "").encode() for i, _, h, *_ in rows}
    assert all(bytes(r.payload) == html[r.page_id] for r in back if r.record_type == "response")
    at = index.first()
    import gzip

    headers, _ = warc.parse(gzip.decompress(read_file(at.file, at["at"], at.length)))
    assert int(headers["x-page-id"]) == at.page_id


def test_index_is_in_global_order(spark):
    runs = warc.write_archives(spark.createDataFrame(make(), DDL), warc.fresh_path(spark, "warc"), file_bytes=2000)
    got = [(r.urlkey, r.ts, r.page_id) for r in warc.merge_index(runs, parts=5).collect()]
    assert got == sorted(got) and len(got) == 300


def test_repeated_rows_and_short_payloads(spark):
    rows = [(5, "u", "x", "", ""), (5, "u", "x", "", ""), (4, "u", "x", "", ""), (1, "u", None, "", ""), (2, "u", "", "", "")]
    got = sorted((r.page_id, r.record_type) for r in warc.read_archives(warc.write_new(spark.createDataFrame(rows, DDL).coalesce(1), least_bytes=1)).collect())
    assert got == [(1, "response"), (2, "response"), (4, "revisit"), (5, "response"), (5, "response")]


def test_empty_table(spark):
    assert warc.read_archives(warc.write_new(spark.createDataFrame([], DDL))).collect() == []


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_key(spark):
    df = spark.createDataFrame([("http://www.A.example:80/P?q#x",), ("https://m.b.example",), (None,)], "u string")
    assert [r[0] for r in df.select(warc.url_key(df.u)).collect()] == ["example,a)/p?q", "example,b,m)/", ")/"]


def test_a_scrambled_index_fails_the_read(spark):
    index = warc.write_new(spark.createDataFrame(make(), DDL).coalesce(1), file_bytes=3000)
    assert warc.read_archives(index).count() == 300
    upside_down = index.coalesce(1).sortWithinPartitions(F.desc("urlkey"))
    with pytest.raises(Exception, match="out of order"):
        warc.read_archives(upside_down).collect()
    moved = index.withColumn("at", F.lead("at").over(W.partitionBy("file").orderBy("at"))).where("at is not null").orderBy("urlkey", "ts", "page_id")
    with pytest.raises(Exception):
        warc.read_archives(moved).collect()


def test_a_very_long_page(spark):
    rows = [(1, "u", "é" * 3_000_000, "", ""), (2, "u", "é" * 3_000_000, "", ""), (3, "u", "x", "", "")]
    got = warc.read_archives(warc.write_new(spark.createDataFrame(rows, DDL))).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 6_000_000, "revisit", 2), (2, 6_000_000, "response", None), (3, 1, "response", None)]
