import random

from larkspur.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string, item_id string, h string", "item_id long, text string, extra string"
ITEM = "A train leaves Paris at 10 km per hour and meets Anna after 10 minutes near the old mill of Paris today."


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "c", "c") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "c") for i, t in items], ITEMS)
    return {(r.doc_id, r.item_id): r for r in D.hits(d, b, **more).collect()}


def test_templates(spark):
    df = spark.createDataFrame([("He paid $3.50 for 5 km in Rome. Then 7kg, (Bob) said: Yes | km",)], "t string")
    ws = D.words(df.t)
    got = df.select(D.templates(ws, D.bodies(ws))).first()[0]
    assert got == ["he", "paid", "<num>", "for", "<num>", "<unit>", "in", "<name>", "then", "<qty>", "<name>", "said", "yes", "|", "km"]


def test_new_values_are_caught_and_clashing_slots_are_not(spark):
    other = ITEM.replace("10", "25").replace("Paris", "Rome").replace("Anna", "Bert")
    small, clash = "we saw Paris and then Paris and Rome", "we saw Milan and then Oslo and Rome"
    docs = [(1, f"before that {ITEM} and after"), (2, f"Before.\n{other}"), (3, "nothing of the kind " * 50), (4, None), (5, ""), (None, ITEM), (1, f"before that {ITEM} and after"), (6, clash)]
    got = run(spark, docs, [(7, ITEM), (8, None), (9, ""), (7, ITEM), (10, small)])
    assert set(got) == {(1, 7), (2, 7), (None, 7)}
    assert got[1, 7].same_values and got[1, 7].coverage > 0.9 and not got[2, 7].same_values


def test_short_item_and_long_text(spark):
    got = run(spark, [(1, "filler words here " * 40_000 + "what is the capital"), (2, "what is the")], [(1, "What is the capital?")])
    assert set(got) == {(1, 1)}


def test_against_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(3, 30)))) for i in range(12)]
    docs = []
    for i in range(60):
        ws = rng.choices(vocab, k=rng.randint(0, 60))
        if i % 2:
            source = rng.choice(items)[1].split()
            a = rng.randint(0, len(source) - 1)
            ws[5:5] = source[a : a + rng.randint(1, 20)]
        docs.append((i, " ".join(ws)))
    want = set()
    for d, t in docs:
        for i, s in items:
            n = min(8, len(s.split()))
            grams = lambda x, n=n: {tuple(x.split()[k : k + n]) for k in range(len(x.split()) - n + 1)}
            if grams(t) & grams(s):
                want.add((d, i))
    assert set(run(spark, docs, items)) == want and want


def test_empty_tables_and_filter(spark):
    assert run(spark, [], [(1, ITEM)]) == {} == run(spark, [(1, ITEM)], [])
    d = spark.createDataFrame([(1, ITEM), (2, "fine"), (None, "fine"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in D.drop_contaminated(d, b).collect()) == ["2", "3", "None"]
    assert D.drop_contaminated(d, b.limit(0)).count() == 4


def test_clean_documents_with_a_common_phrase_stay(spark):
    dated = "The fair on Monday 3 March 2021 at 9 on " + " ".join(f"word{c}" for c in "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopq")
    items = [(1, "Why not"), (2, dated), (3, "what is the capital of France"), (4, ITEM)]
    docs = [
        (1, "they said why not and went"),
        (2, "we met on Friday 5 April 1999 at 7 on a hill and they wore green"),
        (3, "we know what is the capital of Spain"),
        (4, f"before {ITEM} after"),
        (5, "It was so. " + ITEM.replace("10", "25").replace("Paris", "Rome").replace("Anna", "Bert")),
        (6, "so what is the capital of France they ask"),
        (7, " ".join(dated.split()[12:30])),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in D.drop_contaminated(d, b).collect()} == {1, 2, 3}
    assert {1, 3, 4, 5, 6, 7} <= {r.doc_id for r in D.hits(d, b).collect()}


def test_copies_with_many_placeholders_are_found(spark):
    values, shout = "so Anna 3 Bob 4 km 7 Rome 8", "WHICH OF THE FOLLOWING RIVERS FLOWS NORTH TODAY IN SPAIN"
    short, unit = "What is the capital of France?", "Minutes pass slowly in old waiting rooms"
    items = [(1, values), (2, shout), (3, short), (4, "12 7 19 3 44 5 6 71 2"), (5, unit)]
    docs = [(i, f"an open line\n{t} and on") for i, t in items] + [(6, "so Anna 3 Bob 4 km 7 Rome 9 and 12 7 19 3 44 5 6 72 2"), (7, values.replace("Anna", "Carl"))]
    got = run(spark, docs, items)
    assert {k for k in got if k[0] < 6} == {(i, i) for i in range(1, 6)}
    assert all(got[i, i].same_values and got[i, i].coverage == 1 for i in range(1, 6))
    assert (7, 1) not in got and got[6, 1].coverage == 0.5 and (6, 4) not in got


def test_rows_that_share_an_id_are_judged_by_text(spark):
    d = spark.createDataFrame([(None, f"x {ITEM}"), (None, "fine"), (4, ITEM), (4, "fine too")], "doc_id long, text string")
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted(r.text for r in D.drop_contaminated(d, b).collect()) == ["fine", "fine too"]


def test_slots_against_brute_force(spark):
    """Windows of templates, slots consistent along an alignment, over small texts of names, numbers and words."""
    rng = random.Random(8)
    pool = ["3", "4", "Rome", "Oslo", "km", "red", "old", "new", "far"]
    make = lambda k: ["so", *rng.choices(pool, k=k)]
    items = [(i, make(rng.randint(4, 9))) for i in range(12)]
    docs = []
    for i in range(60):
        source = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 2)):
            source[rng.randrange(len(source))] = rng.choice(pool)
        docs.append((i, ["so", *rng.choices(pool, k=rng.randint(0, 4)), *source, *rng.choices(pool, k=2)]))
    units = ("km",)

    def template(ws):
        out = []
        for i, w in enumerate(ws):
            number = lambda x: x.isdigit()
            out.append("<num>" if number(w) else "<unit>" if w in units and i and number(ws[i - 1]) else "<name>" if i and w[0].isupper() else w.lower())
        return out

    n, want = 5, set()
    for d, dw in docs:
        dt = template(dw)
        for j, iw in items:
            it, m = template(iw), min(n, len(iw))
            lines = {}
            for a in range(len(iw) - m + 1):
                heads = {it[a]} | ({"<name>"} if a == 0 and iw[0][0].isupper() else set()) | ({"<unit>"} if a == 0 and iw[0] in units else set())
                for x in range(len(dw) - m + 1):
                    for h in heads:
                        w = [h, *it[a + 1 : a + m]]
                        slots = [k for k in range(m) if w[k][0] == "<"]
                        if w == dt[x : x + m] and (2 * len(slots) <= m or iw[a : a + m] == dw[x : x + m]):
                            lines.setdefault(x - a, []).append({(iw[a + k], dw[x + k]) for k in slots})
            for found in lines.values():
                pairs = set().union(*found)
                if len({p for p, _ in pairs}) == len(pairs) or any(all(p == q for p, q in f) for f in found):
                    want.add((d, j))
    got = run(spark, [(d, " ".join(w)) for d, w in docs], [(j, " ".join(w)) for j, w in items], window=n)
    assert set(got) == want and 10 < len(want)
