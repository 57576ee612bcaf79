import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessella.llm import alignment, queries
from tessella.llm.alignment import FOLDER, Pair, align_tokenizers, pack, read_tokenizers, unpack

SCHEMA = "doc_id long, text string, id string, block string"
ZERO = (0, 0, 0, 0, 0, 0, "")


def brute(texts):
    """Every rule restated token by token over plain lists."""
    a = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
    # The public rule of byte-level vocabularies, by the decoder that comes with the tokenizer.
    from tokenizers.pre_tokenizers import ByteLevel

    alphabet = sorted(ByteLevel.alphabet())
    as_byte = {}
    for char in alphabet:
        as_byte[char] = ord(char) if ord(char) < 256 else None
    missing = [x for x in range(256) if x not in as_byte.values()]
    for char, x in zip(sorted(c for c in alphabet if as_byte[c] is None), missing, strict=True):
        as_byte[char] = x

    def spans(pieces):
        at, out = 0, []
        for p in pieces:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    docs, count = [], Counter()
    for t in texts:
        if not t:
            docs.append(None)
            continue
        ia, ib, whole = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t), (" " + t).encode()
        pa = [bytes(as_byte[c] for c in a.id_to_token(i)) for i in ia]
        pb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(pa) != whole or b"".join(pb) != whole:
            docs.append(None)
            continue
        sa, sb = spans(pa), spans(pb)
        both = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        for e in both:
            groups.append(",".join(str(i) for i, s in zip(ia, sa, strict=True) if start <= s[0] < e) + "|" + ",".join(str(i) for i, s in zip(ib, sb, strict=True) if start <= s[0] < e))
            start = e
        links = [(x, y) for x, s in zip(ia, sa, strict=True) for y, r in zip(ib, sb, strict=True) if s[0] < r[1] and r[0] < s[1]]
        count.update(links)
        docs.append((len(ia), len(ib), len(groups), links, ";".join(groups)))
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return [ZERO if d is None else (*d[:3], len(d[3]), sum(count[x] == most[x[1]] for x in d[3]), sum(count[x] for x in d[3]), hashlib.sha256(d[4].encode()).hexdigest()) for d in docs]


TEXTS = [
    None, "", " ", "\n", "Hello world", "hello  world  ", "<|endoftext|> and <s> or </s> <unk>", "naïve café 東京 🙂🙂", "▁odd", "a\u0000b", "\ttabs\t\tand\n\nlines\r\n",
    "The the THE the", "x" * 300, "1234567890 3.14", "don't we'll they've", " leading", "trailing ", "﻿mark", "é combining", "ﬁ ligature", "<0x41> byte",
]


def rows_of(out):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()}


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    texts = TEXTS + ["Hello world"] * 5 + ["long words and pieces " * 300]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = rows_of(align_tokenizers(docs, read_tokenizers()))
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_groups_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "Hello world", None, None), (1, "Hello world", None, None), (None, "Hello", None, None)], SCHEMA)
    got = sorted(align_tokenizers(docs, read_tokenizers(), with_groups=True).collect(), key=lambda r: (r.doc_id or 0))
    assert [r.doc_id for r in got] == [None, 1, 1]
    assert got[1] == got[2] and hashlib.sha256(got[1].groups.encode()).hexdigest() == got[1].groups_sha256
    assert all("|" in g for r in got for g in r.groups.split(";"))


def test_empty_table(spark):
    assert align_tokenizers(spark.createDataFrame([], SCHEMA), read_tokenizers()).collect() == []


def test_pack():
    x = np.array([0, 1, 254, 255, 256, 70_000, 3])
    assert list(unpack(pack(x), len(x))) == list(x)
    assert len(unpack(pack(x[:0]), 0)) == 0


def test_links_of_spans_that_cross():
    pair = Pair(*read_tokenizers())
    a, b = pair.encode(["Hello world internationalisation"[:25].encode()])[0]
    group_a, group_b, of_a, of_b = pair.links(a, b)
    ends = [np.cumsum(s[x]) for s, x in ((pair.size_a, a), (pair.size_b, b))]
    assert len(np.intersect1d(*ends)) == group_a[-1] + 1 == group_b[-1] + 1
    assert set(of_a) == set(range(len(a))) and set(of_b) == set(range(len(b)))


def test_encodes_as_the_file_says():
    file = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    file.encode_special_tokens = True
    pair, rng = Pair(*read_tokenizers()), random.Random(6)
    texts = [f"{x}{chr(c)}{y}" for c in range(1, 0x3100) for x, y in ((" a", "b"), ("1", " "))] + ["".join(rng.choices("abcdeABC éñüß  .,'-0123\n\t", k=rng.randint(1, 60))) for _ in range(3000)]
    assert [pair.a.encode_ordinary(t) for t in texts] == [x.ids for x in file.encode_batch(texts, add_special_tokens=False)]


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500").select("doc_id", "text").limit(60)
    rows = docs.collect()
    got = rows_of(align_tokenizers(spark.createDataFrame(rows, docs.schema), read_tokenizers()))
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows])
    whole = queries.op11_tokenizer_alignment(spark, sf)
    assert whole.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
