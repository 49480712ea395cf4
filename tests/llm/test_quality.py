import random
import re

import numpy as np
import pytest

from larkspur.llm import quality

DDL = "doc_id long, text string, n_words string, kept string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def corpus():
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "dé"]) + str(rng.random())[2:5] + rng.choice([" ", "\n"]) for _ in range(40)) + "."
    bad = lambda: " | ".join(rng.choice(["home", "shop"]) + str(i) for i in range(30))
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(300)]
    return rows + [(300, None), (301, ""), (302, " a b \n\n a b "), (303, "x y z\n" * 2000), (303, "x y z\n" * 2000), (None, good()), (304, "a b c d e f a b c d e g")]


def test_measures_against_brute_force(spark):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in corpus()[:5] + corpus()[300:]], DDL)
    got = quality.measures(df).collect()
    short = {d: t for d, t in corpus() if d != 303}
    for r in got:
        if r.doc_id != 303:
            assert tuple(r)[1:6] == brute(short[r.doc_id])
    assert [r.n_repeat_words for r in got if r.doc_id == 303] == [6000, 6000]


def test_learns_held_out_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], DDL)
    labels = spark.createDataFrame([(d, int(d % 5 != 0), 0) for d in range(0, 200)] + [(9999, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert all(got[d].kept == (d % 5 != 0) for d in range(200, 300))
    assert got[300].base_failed and got[301].base_failed and not got[303].kept and got[None].kept
    rules = quality.learn(*quality.labelled_sample(docs, labels))
    plain = docs.select("doc_id", "text")
    assert {r.doc_id for r in quality.decide(plain, rules).collect()} == {d for d, r in got.items() if r.kept}
    odd = docs.withColumnsRenamed(dict(zip([c for c in docs.columns if c not in ("doc_id", "text")], ("n_words", "n_toxic"), strict=False)))
    again = quality.decide(odd, rules)
    assert again.columns == odd.columns and {r.doc_id for r in again.collect()} == {d for d, r in got.items() if r.kept}


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in quality.judge(docs, none).collect()] == [True]
    assert quality.judge(docs.limit(0), none).collect() == []


def test_conjunctions_are_grown_and_pruned():
    rng = np.random.default_rng(1)
    x = {f: rng.random(3000) for f in quality.FEATURES}
    bad = (x["upper_share"] > 0.6) & (x["digit_share"] <= 0.5)
    rules = quality.learn(x, bad)
    hit = np.logical_or.reduce([r.holds(x) for r in rules])
    assert (hit == bad).mean() > 0.98 and 2 <= len(rules[0].tests) <= 3


def test_toxic_documents_go_by_words_learned_from_labels(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    rude = ["vileword", "scumword", "louseword"]
    make = lambda: rng.choices(vocab, k=60)
    rows = []
    for i in range(400):
        w = make()
        if i % 8 == 0:
            w[rng.randrange(60)] = rng.choice([str.upper, "\u201c{},\u201d".format, str.title])(rng.choice(rude))
        rows.append((i, " ".join(w)))
    copied = make()
    rows += [(1000 + i, " ".join([*copied[:-1], f"end{chr(97 + i)}"])) for i in range(20)]  # near copies, all labelled toxic
    rows += [(2000, " ".join([*make(), *copied[5:9]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(200)] + [(1000 + i, 1, 1) for i in range(20)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    toxic = quality.learn_toxic(docs, labels)
    assert toxic[0] == {r.encode() for r in rude} and toxic[1]
    kept = {r.doc_id for r in quality.decide(docs, [], toxic=toxic).collect()}
    assert all((i in kept) == (i % 8 != 0) for i in range(200, 400)) and 2000 in kept
    assert quality.learn_toxic(docs, labels.limit(0)) == (frozenset(), []) == quality.learn_toxic(docs.limit(0), labels)
