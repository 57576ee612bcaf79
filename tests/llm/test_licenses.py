import random
import re

from tessella.llm.licenses import BASE, NOTICES, SHARE, scan_licenses

SCHEMA = "doc_id long, text string, labels string"


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({x for _, x in base}))


def test_base_matches_brute_force_and_templates_add_labels(spark):
    rows = [
        (1, "Intro. Released Under the MIT-License! again under the mit license"), (2, "cc by nc cc by nc cc by-nc"), (3, None), (4, ""), (5, "!!! ???"),
        (6, "This program: you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or later"),
        (7, "apache license, version 2.0 and mit license"), (8, "the license of the software is free of charge"), (9, "Über the mit license\x85under\xa0the mit license"),
        (10, "filler " * 40_000 + "under the mit license"), (10, "cc by nc"), (None, "under the mit license"), (11, "permission is granted free"),
    ]
    rows += [(100 + k, f"some words first {text} and more after", ) for k, (_, text, _) in enumerate(NOTICES)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    got = scan_licenses(docs, keep=["doc_id"]).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    by = {r.doc_id: r for r in got}
    for k, (label, _, _) in enumerate(NOTICES):
        assert label in by[100 + k].labels.split(","), label
    assert "gpl-3" in by[6].labels
    assert by[8].labels == by[11].labels == by[3].labels == ""
    assert all(0 <= r.score <= 1 for r in got)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)
    assert scan_licenses(docs.limit(0), keep=["doc_id"]).count() == 0


def test_a_file_of_all_notices_has_all_labels(spark):
    every = "\n\n".join(text for _, text, _ in NOTICES)
    docs = spark.createDataFrame([(1, every, ""), (2, "words " * 5000 + every, ""), (3, "no notice at all", ""), (4, "the terms of the public license", "")], SCHEMA)
    by = {r.doc_id: r.labels for r in scan_licenses(docs, keep=["doc_id"]).collect()}
    assert by[1] == by[2] == ",".join(sorted({label for label, _, _ in NOTICES}))
    assert by[3] == by[4] == ""


def test_labels_of_edited_notices_match_all_starts(spark):
    rng, rows, want = random.Random(3), [], {}
    vocab = sorted({w for _, text, _ in NOTICES for w in text.split()}) + ["other", "words"]
    holds = lambda words, phrase: any(words[i : i + len(phrase)] == phrase for i in range(len(words)))
    for i in range(400):
        words = rng.choices(vocab, k=rng.randint(0, 8))
        for _, text, _ in rng.sample(NOTICES, rng.randint(1, 2)):
            part = text.split()
            for _ in range(rng.choice([0, 1, 3, len(part) // 3, len(part) // 2])):
                j = rng.randrange(len(part))
                part[j : j + rng.choice([1, 1, 1, 0, 2])] = [rng.choice(vocab)]
            words += part + rng.choices(vocab, k=rng.randint(0, 8))
        rows.append((i, " ".join(words), ""))
        labels = {label for phrase, label in BASE.items() if holds(words, phrase.split())}
        for label, text, must in NOTICES:
            notice = text.split()
            best = max(sum(0 <= s + k < len(words) and words[s + k] == w for k, w in enumerate(notice)) for s in range(-len(notice), len(words)))
            if best >= SHARE * len(notice) and all(holds(words, m.split()) for m in must):
                labels.add(label)
        want[i] = ",".join(sorted(labels))
    got = {r.doc_id: r.labels for r in scan_licenses(spark.createDataFrame(rows, SCHEMA), keep=["doc_id"]).collect()}
    assert got == want and len(set(want.values())) > 20
