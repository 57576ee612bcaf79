import random
import re

from tessella.llm.decontamination import contained_items, drop_contaminated


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n, percent):
    out = set()
    for doc, text in docs:
        w = words(text)
        for item, question in items:
            q = words(question)
            m = min(n, len(q))
            if m:
                want = {tuple(q[i : i + m]) for i in range(len(q) - m + 1)}
                have = want & {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
                if 100 * len(have) >= percent * len(want):
                    out.add((doc, item, len(have), len(want)))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}é" for i in range(3000)]
    some = lambda n: rng.choices(vocab, k=n)
    items = [(k, " ".join(some(n))) for k, n in enumerate([5, 6, 9, 16, 20, 21, 37, 40, 60, 90, 150, 300])]
    items += [(100, None), (101, ""), (102, "just two"), (103, "?!"), (104, items[7][1])]
    docs = []
    for i in range(120):
        w = some(rng.randint(0, 900))
        for _ in range(rng.randint(0, 2)):
            q = rng.choice(items)[1] or ""
            q = q.upper().split() if i % 2 else q.split()
            if q and i % 3 == 0:
                q[rng.randrange(len(q))] = "edited"
            at = rng.randint(0, len(w))
            w[at:at] = q
        docs.append((i, (", " if i % 5 else "\n").join(w)))
    docs += [(500, None), (501, ""), (502, "a just TWO b"), (502, "nothing"), (None, items[5][1]), (503, "filler " * 20_000 + items[6][1])]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = contained_items(d.drop("item_id"), b)
    want = brute(docs, items, 5, 80)
    assert {tuple(r) for r in got.collect()} == want
    assert len(want) > 40
    bad = {text for _, text in docs if brute([(0, text)], items, 5, 80)}
    assert sorted(str(r.text) for r in drop_contaminated(d, b).collect()) == sorted(str(t) for _, t in docs if t not in bad)
    assert drop_contaminated(d, b).columns == d.columns
    assert drop_contaminated(d, b.limit(0)).count() == len(docs)
    assert contained_items(d.limit(0), b).count() == 0


def test_short_items_are_never_missed(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(5000)]
    items = [(k, " ".join(rng.choices(vocab, k=5 + k % 16))) for k in range(160)]
    docs = []
    for k, (_, question) in enumerate(items):
        w = rng.choices(vocab, k=rng.randint(40, 300))
        q = question.split()
        if k % 5 == 4:
            q[0] = "edited"
        at = rng.randint(0, len(w))
        w[at:at] = q
        docs.append((k, " ".join(w)))
    got = contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items, 5, 80)
    assert {tuple(r) for r in got.collect()} == want
    assert len(want) > 128


def test_ids_of_any_type_and_empty_items(spark):
    text = "some words of an item that stands in one document whole and is found there by its text"
    docs = spark.createDataFrame([("d1", f"before {text} after"), (None, text), ("d2", "other words")], "doc_id string, text string")
    items = spark.createDataFrame([("i1", text), (None, text), ("i2", None), ("i3", "other words of another item here")], "item_id string, text string")
    got = contained_items(docs, items)
    assert dict(got.dtypes)["item_id"] == "string"
    assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=str) == sorted([("d1", "i1"), ("d1", None), (None, "i1"), (None, None)], key=str)
    assert contained_items(docs, items.limit(0)).count() == 0
    assert drop_contaminated(docs, items.limit(0)).count() == 3
    assert contained_items(docs.limit(0), items).count() == 0
