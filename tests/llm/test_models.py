import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import langid, lm_scoring, tokens, toxicity
from tessella.llm.common import bounded_sample, crc_fold


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network(9, 20)
    gram, of = rng.integers(0, 21, 70), np.sort(rng.integers(0, 30, 70))
    row, evidence = rng.integers(0, 10, 30), rng.normal(size=(30, toxicity.EVIDENCE))
    n = np.bincount(of, minlength=30)
    at = rng.integers(0, 30, (6, toxicity.WINDOW))
    real = np.arange(toxicity.WINDOW) < rng.integers(1, 17, (6, 1))
    y, weight = np.array([0, 1, 1, 0, 1, 0]), np.ones(6)

    def loss():
        logit = net.forward(net.project(net.inputs((row, gram, of, evidence))), at, real).astype(float)
        return float(np.mean(np.log1p(np.exp(-np.where(y > 0, logit, -logit)))))

    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    grads, dx = net.gradients(net.inputs((row, gram, of, evidence)), at, real, y, weight)
    e, k = toxicity.EVIDENCE, toxicity.LEARNED
    for name, rows, d in (("word", row, dx[:, e : e + k]), ("gram", gram, (dx[:, e + k :] / np.maximum(n, 1)[:, None])[of])):
        grads[name] = np.zeros_like(net.p[name])
        np.add.at(grads[name], rows, d)
    for name, g in grads.items():
        for index in list(np.ndindex(g.shape))[:: max(1, g.size // 4)]:
            old = net.p[name][index]
            net.p[name][index] = old + 1e-2
            up = loss()
            net.p[name][index] = old - 1e-2
            down = loss()
            net.p[name][index] = old
            assert (up - down) / 2e-2 == pytest.approx(g[index], abs=2e-3), name


def test_toxicity_finds_held_out_documents(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(600):
        w = rng.choices(vocab, k=rng.randint(1, 200))
        bad = i % 5 == 0
        if bad:
            w.insert(rng.randrange(len(w) + 1), rng.choice(["Vile", "nasty!", "zqv" + rng.choice(vocab)]))
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(bad)))
    rows += [(900, None, "x"), (901, "", "x"), (902, "!!", "x"), (903, "word " * 30_000, "x"), (None, "nice nasty", "x"), (5, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labelled = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labelled, crc_fold("doc_id", 5) != 0)
    out = toxicity.score_toxicity(docs, model, keep=["doc_id"]).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    truth = dict(labels)
    held = [r for r in out if r.doc_id is not None and r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = toxicity.filter_toxic(docs, labelled, F.lit(True))
    assert kept.columns == docs.columns
    assert 480 <= kept.count() <= 495
    assert toxicity.fit([("a", 0)]) is None
    assert {r.score for r in toxicity.score_toxicity(docs, None, keep=["doc_id"]).collect()} == {0.0}
    assert toxicity.filter_toxic(docs.limit(0), labelled, F.lit(True)).count() == 0


def test_network_matches_a_plain_loop():
    rng = np.random.default_rng(4)
    net = toxicity.Network(5, 5)
    x, p = rng.normal(size=(7, toxicity.INPUTS)).astype(np.float32), net.p
    at, n, h = np.array([[3, 1, 4, 1, 5, 6] + [6] * (toxicity.WINDOW - 6)]), 6, toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    states = {}
    for d, order in (("f", range(n)), ("b", reversed(range(n)))):
        state = np.zeros(h)
        for t in order:
            g = x[at[0, t]] @ p[f"w{d}"] + p[f"b{d}"]
            z, r = sigmoid(g[:h] + state @ p[f"u{d}"][:, :h]), sigmoid(g[h : 2 * h] + state @ p[f"u{d}"][:, h:])
            state = (1 - z) * state + z * np.tanh(g[2 * h :] + (r * state) @ p[f"c{d}"])
            states[d, t] = state
    both = [np.concatenate([states["f", t], states["b", t]]) for t in range(n)]
    weight = np.exp([float((np.tanh(s @ p["a"]) @ p["v"])[0]) for s in both])
    pooled = sum(w * s for w, s in zip(weight / weight.sum(), both, strict=True))
    got = net.forward(net.project(x), at, np.arange(toxicity.WINDOW)[None] < n)
    assert got[0] == pytest.approx(float((pooled @ p["o"])[0] + p["bias"][0]), abs=1e-4)


def test_training_folds_same_texts_of_one_label_only(monkeypatch):
    seen = {}
    real = toxicity.Lexicon
    monkeypatch.setattr(toxicity, "Lexicon", lambda docs, label, vocab, evidence: seen.update(n=len(docs), label=label.tolist()) or real(docs, label, vocab, evidence))
    text, foot = "some words that both of them share from the start to the end", " all of this under one common footer line"
    rows = [(text, 0), (text, 1), (text.upper(), 0), (text + " vile", 1), ("another clean text" + foot, 0), ("one more text" + foot, 0)]
    assert toxicity.fit(rows, rounds=1, steps=2) is not None
    assert seen == {"n": 5, "label": [0, 1, 1, 0, 0]}


@pytest.mark.parametrize("evidence", [True, False])
def test_learned_inputs_tell_words_and_their_parts(evidence):
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    make = lambda bad: " ".join([*rng.choices(vocab, k=12), *(["x" * rng.randint(0, 2) + "zqvrw" + rng.choice("abc")] if bad else []), *rng.choices(vocab, k=12)])
    model = toxicity.fit([(make(i % 4 == 0), int(i % 4 == 0)) for i in range(800)], evidence=evidence)
    assert evidence or not (model[0].by_word.any() or model[0].by_gram.any())
    held = [make(i % 4 == 0).encode() for i in range(200)]
    right = [(x >= 0.5) == (i % 4 == 0) for i, x in enumerate(toxicity._scorer(model, "s")()(held)["s"])]
    assert np.mean(right) > 0.95


def test_windows_cover_all_words():
    for n in (0, 1, 8, 9, 16, 17, 20, 21, 24, 25, 100):
        at, real = toxicity._windows(n)
        assert set(at[real].tolist()) == set(range(n))
        assert len(at) == max(1, math.ceil((n - toxicity.WINDOW) / toxicity.STRIDE) + 1)


def test_forward_sums_all_segmentations():
    pieces = sorted([b" ", b"a", b"b", b"ab", b" a", b"ba", b"bab"])
    p = np.array([[0.1 + 0.01 * i, 0.2 - 0.01 * i] for i in range(len(pieces))] + [[0, 0]])
    at = {x: i for i, x in enumerate(pieces)}
    words = [b"a", b"abab", b"bbb", b"babab"]
    got = langid.log_probabilities(words, langid.Lattice(pieces), p)
    for w, row in zip(words, got, strict=True):
        text, total = b" " + w, np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
            parts = [text[a:b] for a, b in itertools.pairwise(ends)]
            if all(x in at for x in parts):
                total += np.prod([p[at[x]] for x in parts], axis=0)
        assert row == pytest.approx(np.log(total * langid._SCALE ** len(text)), rel=1e-4)


def test_language_of_held_out_documents(spark):
    rng = random.Random(3)
    parts = {"de": ["ung", "keit", "sch", "ein", "über"], "en": ["ing", "the", "tion", "wh", "ed"], "fr": ["eau", "ment", "été", "que", "oi"]}
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(2, 40))), lang, "x"))
    odd = [(900, None, "en", "x"), (901, "12 !?", None, "x"), (902, "été que", None, "x"), (903, "über" * 20_000, None, "x"), (None, "the thing", "en", "x"), (3, "again", "en", "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string")
    pieces = langid.vocabulary()
    model = langid.learn(docs, crc_fold("doc_id", 4) != 2, pieces)
    out = langid.predict_language(docs, model, pieces, keep=["doc_id"]).collect()
    got = {r.doc_id: r.lang_pred for r in out}
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[r[0]] == r[2] for r in held) >= 0.97 * len(held)
    assert (got[900], got[901], got[902], got[903]) == ("und", "und", "fr", "de")
    assert langid.learn(docs.limit(0), F.lit(True), pieces) is None
    assert {r.lang_pred for r in langid.predict_language(docs, None, pieces, keep=["doc_id"]).collect()} == {"und"}


def plain_entropies(rows, targets, size):
    """(target, background) of each row by counting all other rows of either side again."""
    code = lambda t: list(itertools.pairwise([None, *(t or "").lower().split()]))
    sides = [i in targets for i, _ in rows]
    total = [sum(len(code(t)) for (_, t), s in zip(rows, sides, strict=True) if s is k) for k in (True, False)]
    out = []
    for d, (_, text) in enumerate(rows):
        mine = []
        for k, n, m in ((True, *total), (False, *reversed(total))):
            w = min(1, m / n) if n and m else 1
            pairs, before, single = Counter(), Counter(), Counter()
            for e, (_, t) in enumerate(rows):
                if sides[e] is k and e != d:
                    pairs.update(code(t))
            for (a, b), c in pairs.items():
                before[a] += c
                single[b] += c
            p = code(text)
            prior = lambda b: lm_scoring.K * (w * single[b] + 0.5) / (w * n + 0.5 * size)  # noqa: B023, E731
            mine.append(-sum(math.log((w * pairs[a, b] + prior(b)) / (w * before[a] + lm_scoring.K)) for a, b in p) / len(p) if p else None)
        out.append(mine)
    return out


def test_cross_entropy_matches_plain_counts(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocab[:20] if i % 3 == 0 else vocab, k=rng.randint(0, 40))), "x") for i in range(90)] + [(200, None, "x"), (None, "w1 w2", "x"), (4, "W1 odd", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    of = {*range(0, 90, 3)}
    targets = spark.createDataFrame([(i,) for i in of] + [(3,), (None,)], "doc_id long")
    size = len({w for _, t, _ in rows for w in (t or "").lower().split()}) + lm_scoring.CLASSES
    key = lambda r: (str(r[0]), r[1] or 0)
    for marked, ids in ((targets, of), (targets.limit(0), set()), (docs.select("doc_id"), {i for i, _, _ in rows if i is not None})):
        out = lm_scoring.score_cross_entropy(docs, marked, keep=["doc_id"]).collect()
        want = sorted(((i, *x) for (i, _, _), x in zip(rows, plain_entropies([r[:2] for r in rows], ids, size), strict=True)), key=key)
        for got, (i, t, b) in zip(sorted(((r.doc_id, r.target_entropy, r.background_entropy) for r in out), key=key), want, strict=True):
            assert got == (i, t, b) if t is None else got == pytest.approx((i, t, b), abs=1e-9)
    assert lm_scoring.score_cross_entropy(docs.limit(0), targets).count() == 0


def test_cross_entropy_counts_every_word(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"{'qz'[i % 2]}{i}ing" for i in range(2500)]
    rows = [(i, " ".join(rng.choices(vocab, [1 / (k + 3) for k in range(2500)], k=rng.randint(0, 120)))) for i in range(150)] + [(500, "rareing q2ing"), (501, "oddling q2ing rareing"), (502, "q0ing " * 3000), (503, "twin words of one text"), (504, "twin words of one text"), (505, "lone terms in this line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = {*range(0, 150, 3), 500}
    targets = spark.createDataFrame([(i,) for i in of], "doc_id long")
    score = lambda: {r.doc_id: r for r in lm_scoring.score_cross_entropy(docs, targets, keep=["doc_id"]).collect()}
    got = score()
    size = len({w for _, t in rows for w in t.split()}) + lm_scoring.CLASSES
    assert size > lm_scoring.WORDS + lm_scoring.CLASSES
    assert len(got) == len(rows)
    for (i, t), (target, background) in zip(rows, plain_entropies(rows, of, size), strict=True):
        if t:
            assert (got[i].n_tokens, got[i].target_entropy, got[i].background_entropy) == pytest.approx((len(t.split()), target, background), abs=1e-7)
    assert got[503].background_entropy < got[505].background_entropy - 2
    monkeypatch.setattr(lm_scoring.vocabulary, "__defaults__", ("text", 7))
    assert {i: r.score for i, r in score().items() if r.score} == pytest.approx({i: r.score for i, r in got.items() if r.score}, abs=1e-9)


def test_tokens_of_text_that_is_no_utf8(spark):
    docs = spark.sql("SELECT 1 AS doc_id, 's' AS source, CAST(x'61FF62E2820A63' AS string) AS text, 'l' AS lang")
    got = {r.section: r.n_bytes for r in tokens.count_tokens(docs, tokens.read_ranks()).collect()}
    assert got == {"source": 2, "lang": 2, "text.head": 3, "text.body": 1}


def test_bounded_sample_is_the_least_hashes_of_each_value(spark):
    rows = [(i, "abc"[i % 2 if i < 3000 else 2]) for i in range(3010)] + [(None, "a"), (7, None)]
    frame = spark.createDataFrame(rows, "i long, v string")
    got = bounded_sample(frame, "i", "v", 40).collect()
    hashed = frame.where("i IS NOT NULL AND v IS NOT NULL").select("i", "v", F.xxhash64(F.lit(11), "i").alias("h")).collect()
    want = {(r.i, r.v) for v in "abc" for r in sorted((r for r in hashed if r.v == v), key=lambda r: r.h)[:40]}
    assert {(r.i, r.v) for r in got} == want and len(got) == 90
    assert bounded_sample(frame.limit(0), "i", "v", 40).count() == 0


def test_every_language_can_be_predicted(spark):
    rows = [(i, f"{chr(97 + i % 20) * 3}{chr(97 + i % 19)} " * 9, f"l{i % 20}") for i in range(400)]
    docs, pieces = spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.vocabulary()
    langs, _ = langid.learn(docs, F.lit(True), pieces, most=40)
    assert langs == sorted(f"l{i}" for i in range(20))
    assert langid.predict_language(docs.limit(0), langid.learn(docs, F.lit(True), pieces, most=40), pieces).count() == 0


def test_tokens_are_whole_and_attributed_by_most_bytes(spark):
    rows = [(1, "web", "en", "Head line\nbody of  the text\n"), (2, None, None, None), (3, "", "x", "no break"), (4, "é", "日本", "日本語\n\n\n  x"), (None, "a", "b", "c\nd"), (5, "s", "l", "word " * 30_000), (1, "w", "e", "\n")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, lang string, text string, n_tokens int")
    got = tokens.count_tokens(docs, tokens.read_ranks()).collect()
    assert len(got) == 4 * len(rows)
    coder = tokens.Encoder(tokens.read_ranks())
    for k, (_, s, lang, t) in enumerate(rows):
        mine = got[4 * k : 4 * k + 4]
        whole = "\n".join(x or "" for x in (s, lang, t))
        ids = coder.coder.encode_ordinary(whole)
        head, cut, body = (t or "").partition("\n")
        parts = [(s or "") + "\n", (lang or "") + "\n", head + cut, body]
        assert [r.section for r in mine] == ["source", "lang", "text.head", "text.body"]
        assert [r.n_bytes for r in mine] == [len(x.encode()) for x in parts]
        owner = [i for i, x in enumerate(parts) for _ in x.encode()]
        want, at = Counter(), 0
        for token in ids:
            size = len(coder.coder.decode_single_token_bytes(token))
            held = Counter(owner[at : at + size])
            want[min(held, key=lambda x: (-held[x], x))] += 1
            at += size
        assert [r.n_tokens for r in mine] == [want[i] for i in range(4)]
    assert tokens.count_tokens(docs.limit(0), tokens.read_ranks()).count() == 0
