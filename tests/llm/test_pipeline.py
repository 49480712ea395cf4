import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    """Plain documents, and one case of each kind planted among them."""
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    make = lambda n: " ".join(rng.choices(vocab, k=n))
    rows = [(i, make(rng.randint(150, 400))) for i in range(60)]
    passage, item = make(60), make(25)
    rows += [(100, rows[0][1]), (101, rows[1][1].replace(rows[1][1].split()[80], "changed", 1))]
    rows += [(102, f"{make(100)} {passage} {make(100)}"), (103, f"{make(120)} {passage} {make(90)}")]
    rows += [(104, f"{make(100)} {item} {make(50)}")]
    rows += [(105 + i, " | ".join(rng.choices(vocab, k=rng.randint(70, 220)))) for i in range(40)]
    rows += [(200, None), (201, ""), (202, "too short"), (59, rows[59][1])]
    at = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(105 + i, 0, 0) for i in range(0, 40, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, dict(rows), passage


def test_planted_cases_go_and_clean_documents_stay(spark, fixture_dir):
    at, texts, passage = fixture_dir
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        path = f"{at}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name != "bpe_encode_decode":
            assert docs.columns == columns
        if name == "substring_dedup":
            now = {r.doc_id: r for r in docs.collect()}
    clean = list(range(60))
    assert sorted(set(kept["quality_rules"])) == [*clean, 100, 101, 102, 103, 104]
    assert kept["near_dedup"] == [*clean, 102, 103, 104]
    assert passage in now[102].text and passage not in now[103].text and now[103].n_chars == len(now[103].text)
    assert all(now[i].text == texts[i] for i in [*clean, 102, 104])
    assert kept["decontamination"] == kept["bpe_encode_decode"] == [*clean, 102, 103]
    assert docs.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(10)
    vocab = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(12):
        base = rng.choices(vocab, k=400)
        for e in (0, 2, 5, 200):
            w = list(base)
            for j in rng.sample(range(400), e):
                w[j] = rng.choice(vocab)
            rows.append((g * 10 + len(rows) % 4, " ".join(w), e))
    like = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    for i, t, _ in rows:
        near = [j for j, u, _ in rows if j < i and like(t, u) >= 0.85]
        far = all(like(t, u) < 0.5 for j, u, _ in rows if j != i)
        if near or far:
            assert (i in kept) == (not near)


def test_near_duplicates_at_the_bound_itself(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(100_000)]
    texts = {}
    for g in range(120):
        base = rng.sample(vocab, 94)  # 90 shingles; t other words at the end leave (90 - t) / (90 + t)
        t = (10, 11, 14, 17)[g % 4]
        texts[2 * g] = " ".join(base)
        texts[2 * g + 1] = " ".join([*base[:-t], *rng.sample(vocab, t)])
    chain = rng.sample(vocab, 94)  # linked over the middle only, and repeats that don't count
    texts |= {1000: " ".join(chain), 1001: " ".join([*chain[:-10], *rng.sample(vocab, 10)]), 1002: " ".join([*chain[8:-2], *rng.sample(vocab, 10)])}
    texts |= {1100: " ".join(rng.sample(vocab, 40)), 1102: "x " + "a b c d e f g h i j " * 40}
    texts |= {1101: f"{texts[1100]} {texts[1100]}", 1103: "y " + "a b c d e f g h i j " * 3}
    texts |= {2000 + i: " ".join([*chain[:84], *rng.sample(vocab, 10)]) for i in range(700)}  # more than one block
    sets = {i: shingles(t) for i, t in texts.items()}
    want = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and want[i] != want[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((want[i], want[j]))
                want = {k: a if v == b else v for k, v in want.items()}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(want.values())


def test_empty_table(spark, fixture_dir, tmp_path):
    at, *_ = fixture_dir
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_scratch_goes_when_a_stage_is_written(spark, fixture_dir):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    made = corpus_pipeline.run(spark, fixture_dir[0])
    (left,) = set(os.listdir(shared)) - before
    assert left.startswith(corpus_pipeline.STAGES[-1][0]) and made.count() > 0


def test_odd_rows_in_every_stage(spark, fixture_dir):
    """Null and repeated ids, null, empty and repeated texts, and columns named as the stages name theirs."""
    names = ("th", "k", "stays", "others", "shard", "kept_text", "root", "__id")
    text = "one word after another without any end or reason but long enough to hold what a window asks for and more"
    rows = [(None, text, 9), (None, text, 9), (7, text + " x", 9), (7, text + " x", 9), (7, None, None), (8, "", 0), (9, None, 0), (10, "short", 5)]
    docs = spark.createDataFrame([(i, t, "en", "s", n, *range(len(names))) for i, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, fixture_dir[0])
        assert made.columns == docs.columns, name
        assert all(tuple(r)[5:] == tuple(range(len(names))) for r in made.collect()), name
    name, stage = corpus_pipeline.STAGES[-1]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.decoded is not None) for r in stage(spark, docs, fixture_dir[0]).collect()) == sorted((i is None, i or 0, True) for i, _, _ in rows)
