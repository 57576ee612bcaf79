import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import quality
from tessella.llm.quality import count, filter_quality, score_quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é\n\t \x85\x1c#<日𝄞B!\r"), max_size=60))
def test_counts_match_plain_python(text):
    assert count(text.encode())[:5] == plain(text)


def test_thresholds_follow_language_and_source(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(rng.randint(60, 120))]
        source = "code" if i % 2 else None
        if source:  # symbols are usual here
            words = [w + "<>" for w in words]
        if i % 50 == 0:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "en" if i % 4 < 2 else None, source, 1, True))
    rows += [(1000, None, "en", None, 1, True), (1001, "", None, None, 1, None), (1002, "a b c " * 50, "en", "code", 1, None), (None, " ".join(word() for _ in range(90)), "xx", "rare", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept boolean")
    got = score_quality(docs).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    plain_junk = [i for i in range(0, 600, 50)]
    assert not any(kept[i] for i in plain_junk)
    assert sum(kept[i] for i in range(600) if i % 50) > 580
    assert [kept[i] for i in (1000, 1001, 1002)] == [False] * 3
    assert kept[None]
    base = {r.doc_id: r.base_failed for r in got}
    assert base[1002] and base[1000] and not base[1]
    passed = filter_quality(docs)
    assert passed.columns == docs.columns
    assert sorted(r.text for r in passed.collect()) == sorted(r[1] for r in rows if kept[r[0]])
    assert filter_quality(docs.limit(0)).count() == score_quality(docs.limit(0)).count() == 0


def test_verdicts_match_plain_quartiles(spark):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", f"rare{i % 40}", None])
        words = ["".join(rng.choices("abcdefghABC!?#", [9] * 8 + [rng.random()] * 6, k=rng.randint(2, 9))) for _ in range(rng.randint(30, 150))]
        text = " ".join(w + "\n" * (rng.random() < 0.1) for w in words)
        rows.append((i, text + "\n" + text[: rng.randint(0, 300)] * (rng.random() < 0.2), lang, source))
    got = {r.doc_id: (r.base_failed, r.kept) for r in score_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}

    steps = {}
    for i, text, _, _ in rows:
        n, chars, symbols, dup, repeats, lines, capitals, marks = count(text.encode())
        of = {"symbols": (symbols, chars), "capitals": (capitals, chars), "marks": (marks, chars), "dup_lines": (dup, lines), "repeats": (repeats, n), "word_length": (chars, 30 * n)}
        steps[i] = {k: min(1000, 1000 * a // b) if b else 0 for k, (a, b) in of.items()} | {"bad": n < 50 or 100 * repeats > 50 * n}
    groups, languages = defaultdict(list), defaultdict(list)
    for i, _, lang, source in rows:
        groups[lang, source].append(steps[i])
        languages[lang].append(steps[i])
    quartile = lambda of, k, q: next(v for j, v in enumerate(sorted(x[k] for x in of)) if j + 1 >= q * len(of))
    outside = 0
    for i, _, lang, source in rows:
        own, wide, inside = groups[lang, source], languages[lang], True
        for k, floor in quality.FLOOR.items():
            low, high = ((len(own) * quartile(own, k, q) + quality.PRIOR * quartile(wide, k, q)) / (len(own) + quality.PRIOR) for q in (0.25, 0.75))
            reach = quality.FENCE * max(high - low, floor)
            inside &= (k != "word_length" or steps[i][k] >= low - reach) and steps[i][k] <= high + reach
        outside += not inside
        assert got[i] == (steps[i]["bad"], inside and not steps[i]["bad"])
    assert 5 < outside < 100
