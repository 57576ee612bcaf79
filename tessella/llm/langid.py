"""Language identification by unigrams over pieces, summed over all segmentations.

A public tokenizer's vocabulary, fixed, gives the pieces. For each language, expectation maximisation finds piece
probabilities on a bounded sample of labelled rows; the probability of a word is the sum over all ways to cut it into
pieces, by the forward algorithm over its bytes (a byte alone is always a piece). A text's score is the posterior of
its language from the product over its words, letters in lower case.

Bytes are scaled alike for all languages, so nothing underflows; a run of letters over LONGEST bytes is cut into
words of that length. Training takes at most SAMPLE documents of each language and about ALL of all languages together,
both parameters: with very many languages each gives fewer, but every language gives some and can be predicted. Their words
are counted where they are read; one task learns from the counts, and the driver gets the model alone.

Defined results: null text, or text without a letter: und with score 0. Where nothing can be learned every text is
und. Equal posteriors: the language first by code point. Repeated ids are scored row by row; in training one text of an
id and language counts, the least. Very long texts are scored whole. An empty table gives an empty table. Kept
columns named like a new one give way to it.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WordRows, bounded_sample, chunks, map_texts

SAMPLE, ALL, LONGEST, LONGEST_PIECE, ROUNDS = 400, 40_000, 48, 16, 3
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
_BASE, _SPREAD, _AGAIN, _SCALE = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 12.0
_SPLIT = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def vocabulary(path: str = PIECES) -> list[bytes]:
    """The pieces of a sentencepiece model as bytes, a word's start as a space, and each single byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).replace("▁", " ").lower().encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    pieces |= {bytes([c]) for c in range(256)}
    return sorted(p for p in pieces if len(p) <= LONGEST_PIECE and b" " not in p[1:])


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters in lower case; long ones are cut."""
    words = text.decode("utf-8", "ignore").lower().encode().translate(_SPLIT).split()
    if max(map(len, words), default=0) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "ignore")))


class Lattice:
    """All pieces at all places of words, looked up by a rolling hash in one table."""

    SLOTS = 21

    def __init__(self, pieces: list[bytes]) -> None:
        self.size = len(pieces)
        key = np.zeros(self.size, np.uint64)
        for i, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * int(_BASE) + c + 1) & (2**64 - 1)
            key[i] = h
        assert len(np.unique(key)) == self.size
        self.key = np.append(key, np.uint64(0))
        self.table, self.rest = (np.full(2**self.SLOTS, self.size, np.int32) for _ in range(2))
        slot = self._slot(key, _SPREAD)
        self.table[slot] = np.arange(self.size)
        lost = np.flatnonzero(self.table[slot] != np.arange(self.size))
        self.rest[self._slot(key[lost], _AGAIN)] = lost
        assert len(np.unique(self.rest[self.rest < self.size])) == len(lost)

    def _slot(self, h: np.ndarray, by: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * by) >> np.uint64(64 - self.SLOTS)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash; self.size where there is none."""
        at = self.table[self._slot(h, _SPREAD)]
        miss = np.flatnonzero(self.key[at] != h)
        if len(miss):
            again = self.rest[self._slot(h[miss], _AGAIN)]
            at[miss] = np.where(self.key[again] == h[miss], again, self.size)
        return at

    def edges(self, words: np.ndarray):
        """(start, end, piece of each word) for words of one length, as rows of bytes."""
        n, length = words.shape
        for i in range(length):
            h = np.zeros(n, np.uint64)
            for j in range(i + 1, min(length, i + LONGEST_PIECE) + 1):
                h = h * _BASE + words[:, j - 1] + np.uint64(1)
                yield i, j, self.find(h)


def _by_length(words: list[bytes]):
    """(indexes, rows of bytes with the word's start marked) for each length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        rows = np.frombuffer(b"".join(b" " + words[i] for i in at), np.uint8).reshape(len(at), length + 1)
        yield at, rows.astype(np.uint64)


def log_probabilities(words: list[bytes], lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """(words, languages): log of the sum over segmentations, bytes scaled alike. p: (pieces + 1, languages)."""
    out = np.zeros((len(words), p.shape[1]), np.float32)
    for at, rows in _by_length(words):
        for k in range(0, len(at), 20_000):
            part = rows[k : k + 20_000]
            alpha = [np.zeros((len(part), p.shape[1])) for _ in range(part.shape[1] + 1)]
            alpha[0] += 1
            for i, j, piece in lattice.edges(part):
                alpha[j] += alpha[i] * (p[piece] * _SCALE ** (j - i))
            out[at[k : k + 20_000]] = np.log(alpha[-1])
    return out


def _expected(words: list[bytes], times: np.ndarray, lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, over words seen `times` (words, languages)."""
    out = np.zeros_like(p)
    for at, rows in _by_length(words):
        for k in range(0, len(at), 20_000):
            part, n = rows[k : k + 20_000], times[at[k : k + 20_000]]
            length = part.shape[1]
            edges = [(i, j, piece) for i, j, piece in lattice.edges(part)]
            alpha, beta = ([np.zeros((len(part), p.shape[1])) for _ in range(length + 1)] for _ in range(2))
            alpha[0] += 1
            beta[length] += 1
            for i, j, piece in edges:
                alpha[j] += alpha[i] * (p[piece] * _SCALE ** (j - i))
            for i, j, piece in reversed(edges):
                beta[i] += beta[j] * (p[piece] * _SCALE ** (j - i))
            weight = n / alpha[-1]
            for i, j, piece in edges:
                use = alpha[i] * beta[j] * (p[piece] * _SCALE ** (j - i)) * weight
                for lang in range(p.shape[1]):
                    out[:, lang] += np.bincount(piece, use[:, lang], len(p))
    return out


def fit(rows: list[tuple[str | None, str]], pieces: list[bytes]) -> tuple[list[str], np.ndarray] | None:
    """(languages, piece probabilities) from (text, language) rows; None without a word to learn from."""
    seen: dict[str, Counter] = {}
    for text, lang in rows:
        seen.setdefault(lang, Counter()).update(words_of((text or "").encode("utf-8", "ignore")))
    return fit_counts(seen, pieces)


def fit_counts(seen: dict[str, Counter], pieces: list[bytes]) -> tuple[list[str], np.ndarray] | None:
    """fit() from how often each language's texts hold each word."""
    langs = sorted(seen)
    langs = [lang for lang in langs if seen[lang]]
    if not langs:
        return None
    words = sorted(set().union(*(seen[lang] for lang in langs)))
    times = np.array([[seen[lang][w] for lang in langs] for w in words], float)
    lattice = Lattice(pieces)
    p = np.full((lattice.size + 1, len(langs)), 1 / lattice.size)
    p[-1] = 0
    for _ in range(ROUNDS):
        used = _expected(words, times, lattice, p)
        shared = (used.sum(1, keepdims=True) + 0.01) / (used.sum() + 0.01 * lattice.size)
        p = (used + 20 * shared) / (used.sum(0) + 20)
        p[-1] = 0
    return langs, p


def _scorer(model: tuple[list[str], np.ndarray] | None, pieces: list[bytes]) -> Callable:
    def start() -> Callable[[list[bytes]], dict]:
        if model is None:
            return lambda batch: {"lang_pred": ["und"] * len(batch), "score": [0.0] * len(batch)}
        langs, p = model
        lattice = Lattice(pieces)
        table = WordRows(lambda words: log_probabilities(words, lattice, p))

        def work(batch: list[bytes]) -> dict:
            found = [words_of(t) for t in batch]
            pred, score = [], []
            for text, words, where in zip(batch, found, table.indexes(found), strict=True):
                if not has_letter(text):
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = table.rows[where].sum(0, dtype=float) if len(words) else np.zeros(len(langs))
                best = int(np.argmax(total))
                pred.append(langs[best])
                score.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
            return {"lang_pred": pred, "score": score}

        return work

    return start


def learn(docs: DataFrame, usable: Column, pieces: list[bytes], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, most: int = ALL):
    """Fits on at most sample usable documents of each language, fewer of each if all would be over most."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    languages = rows.select(lang_col).distinct().count()
    if not languages:
        return None
    drawn = bounded_sample(rows, id_col, lang_col, max(1, min(sample, most // languages))).select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"))
    held = rows.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text")).join(F.broadcast(drawn.distinct()), ["__id", "__lang"])
    texts = held.groupBy("__id", "__lang").agg(F.min("__text").alias("__text"))  # one text of an id, however often it repeats

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            seen = Counter((lang, w) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in words_of((text or "").encode("utf-8", "ignore")))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.binary()), pa.array(seen.values(), pa.int64())], ["lang", "word", "n"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen.setdefault(lang, Counter())[word] += n
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_counts(seen, pieces))], pa.binary())], ["model"])

    counts = texts.select(F.col("__lang").cast("string"), F.col("__text").cast("string")).mapInArrow(count, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    made = counts.repartition(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(made[0][0]) if made else None


def predict_language(docs: DataFrame, model, pieces: list[bytes], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, lang_pred and score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((model, pieces))
    return map_texts(docs, text_col, lambda: _scorer(*shared.value)(), "lang_pred string, score double", keep)
