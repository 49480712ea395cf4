import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from larkspur.llm import interactions, queries

DOCS = "doc_id long, text string, lang string, part string, mask int, same string"
LABELS = "doc_id long, quality int, toxic int, n int"


def fails(text, doc_id, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    e = doc_id is not None and least[text] is not None and doc_id > least[text]
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None,
        "E": e,
    }


def brute(docs, labels):
    """Each order is applied to each document, from left to right."""
    least = {}
    for i, t, _ in docs:
        t = t or ""
        least[t] = min((x for x in (least.get(t), i) if x is not None), default=None)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    rows, share = {}, Counter()
    for part in {p or "" for *_, p in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [(i, fails(t or "", i, least)) for i, t, p in docs if (p or "") == part]
            everything = left
            for step, f in enumerate(order, 1):
                out = [(i, x) for i, x in left if x[f]]
                before = sum(x[f] for _, x in everything) - len(out)
                left = [(i, x) for i, x in left if not x[f]]
                alone = sum(x[f] and sum(x.values()) == 1 for _, x in everything)
                rows[part, "".join(order), step] = [len(left), len(out), before, alone, sum(i in good for i, _ in out), sum(i in toxic for i, _ in out)]
                share[part, f] += len(out)
    return {(*k, *v, share[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def result(spark, docs, labels):
    d = spark.createDataFrame([(i, t, p, "x", 7, "y") for i, t, p in docs], DOCS)
    return [tuple(r) for r in interactions.filter_audit(d, spark.createDataFrame([(*r, 1) for r in labels], LABELS)).collect()]


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(160):
        n, v = int(rng.choice([20, 99, 100, 150])), int(rng.choice([40, 90, 400]))
        text = " ".join(rng.choice(pool[:v], n)) if v < 400 else " \x0b".join(pool[:n])
        text = text.upper() if rng.random() < 0.3 else text
        text = text + rng.choice(["", "", "#", "|é", "\n"])
        docs.append((1000 - i, text, [None, "", "en", "fr"][int(rng.integers(4))]))
    docs += [(2000 + i, docs[i % 9][1], "en") for i in range(60)]
    docs += [(3, None, None), (4, "", "de"), (None, "", "de"), (None, None, "de"), (None, docs[0][1], "en"), (5, "A é", "fr"), (6, "aaaaaaaaa A", "fr"), (7, "Abcdefghij", "fr")]
    docs += [(900, docs[3][1], "fr"), (900, docs[3][1], "fr"), (8, "long word " * 40000, "fr"), (9, "long word " * 40000, "fr")]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(850, 1001)] + [(2001, 1, 1), (2001, 0, 0), (3, None, 1), (None, 1, 1), (12345, 1, 1)]
    got = result(spark, docs, labels)
    assert len(got) == 600 * len({p or "" for *_, p in docs})
    assert set(got) == brute(docs, labels)


def test_empty_tables(spark):
    assert result(spark, [], [(1, 1, 1)]) == []
    assert set(result(spark, [(1, "a b", "en")], [])) == brute([(1, "a b", "en")], [])


def test_one_hot_text(spark):
    """A text that most rows share fails E for all but the smallest id."""
    docs = spark.range(0, 30000, 1, 8).selectExpr("id as doc_id", "if(id % 10 < 9, 'same text', concat('text ', id)) as text", "'en' as lang")
    counts = interactions.mask_counts(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r["mask"]: r["n"] for r in counts} == {1: 3001, 17: 26999}


def test_matrices_have_one_outcome_for_each_mask_and_step():
    m = interactions.incidence("ABCDE")
    assert all(x.shape == (32, 600) for x in m.values())
    # At each step a document is kept, is removed, or is not there any more.
    gone = 1 - m["kept"] - m["removed"]
    assert ((gone == 0) | (gone == 1)).all() and (m["redundant"] <= gone).all()
    # Who fails anything is removed in exactly one step of each order.
    assert (m["removed"].reshape(32, 120, 5).sum(axis=2) == (np.arange(32) > 0)[:, None]).all()


@pytest.mark.parametrize("name", ["op11_filter_interaction_audit"])
def test_query_equals_its_sql(spark, name):
    con, at = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    df = queries.QUERIES[name](spark, at)
    rows = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(rows.fetchall())
