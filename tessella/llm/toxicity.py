"""Toxicity by a small bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word are a learned vector of the word, the mean of the learned vectors of its character sequences, and
(unless evidence=False) how much likelier labelled toxic training documents hold the word and its sequences, where a
likelihood ratio test finds that significant. Words and sequences of fewer than SEEN training documents share one
vector. The network runs over overlapping windows of WINDOW words that start every STRIDE words; a document's score is
that of its most toxic window.

Training takes at most SAMPLE documents of each label, drawn by a hash of their ids, as a parameter; it is one task
over that bounded sample, so the driver holds only the finished model. Texts of one label with the same words count once. As labels mark whole documents,
training picks the windows to learn from in rounds: the highest-scoring one of a toxic document, the highest ones and
others of a clean document.

Defined results: null text and text without words score as an empty window does; without labels of both kinds every
score is 0, and next to 0 where no score tells them apart; windows of words that training never saw are clean. Repeated ids are scored row by row; in training one text of an id counts, the least. A null id is never
learned from. Very long texts are scored in all their windows. An empty table gives an empty table. Ties at 1/2 are
toxic to a reader of scores, but the filter keeps them. A kept column named like the score gives way to it; the filter keeps all columns as they were.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WordRows, bounded_sample, map_texts

WINDOW, STRIDE, HIDDEN, ATTENTION, SAMPLE = 16, 4, 8, 8, 1500
#: Stands for a word that no training document has; no text gives it.
UNKNOWN = b"\0"
SIGNIFICANT, SEEN, LEARNED, EVIDENCE = 16.0, 4, 6, 5
_WORDS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
INPUTS = EVIDENCE + 2 * LEARNED


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "ignore").lower().encode().translate(_WORDS).split()


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 4- and 5-byte sequences of words with their ends marked, as numbers, and the word each is of."""
    joined = np.frombuffer(b"".join(b"^" + w + b"$" for w in words) + bytes(4), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    of = np.repeat(np.arange(len(words)), size)
    n = len(of)
    four = sum(joined[k : k + n] << np.uint64(8 * k) for k in range(4))
    left = end[of] - np.arange(n)
    return np.concatenate([four[left >= 4], (four | joined[4 : 4 + n] << np.uint64(32))[left >= 5]]), np.concatenate([of[left >= 4], of[left >= 5]])


def _evidence(held: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-odds of a feature's presence in toxic against clean documents, where they are significant; else 0.

    held counts the documents of either label that hold each feature, n the documents of either label.
    """
    (b, a), total = held, held.sum(0)
    share = total / n.sum()
    cells = ((a, n[1] * share), (b, n[0] * share), (n[1] - a, n[1] * (1 - share)), (n[0] - b, n[0] * (1 - share)))
    ratio = 2 * sum(np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(e, 1e-300)), 0) for x, e in cells)
    odds = np.log((a + 0.5) / (n[1] + 1)) - np.log((b + 0.5) / (n[0] + 1))
    return np.where((total >= 4) & (ratio > SIGNIFICANT), np.clip(odds, -4, 4), 0.0)


class Lexicon:
    """The words and character sequences that SEEN training documents or more hold, and their evidence."""

    def __init__(self, docs: list[np.ndarray], label: np.ndarray, vocab: list[bytes], evidence: bool = True) -> None:
        """docs are given as places in vocab."""
        gram, of = _grams(vocab) if vocab else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(of, kind="stable")
        names, gram = np.unique(gram[order], return_inverse=True)
        start = np.searchsorted(of[order], np.arange(len(vocab) + 1))
        by_word, by_gram = np.zeros((2, len(vocab)), np.int32), np.zeros((2, len(names)), np.int32)
        for words, y in zip(map(np.unique, docs), label, strict=True):
            by_word[y, words] += 1
            if len(words):
                by_gram[y, np.unique(np.concatenate([gram[start[w] : start[w + 1]] for w in words]))] += 1
        n = np.bincount(label, minlength=2)
        word, seq = (np.flatnonzero(x.sum(0) >= SEEN) for x in (by_word, by_gram))
        self.words, self.grams = {vocab[i]: k for k, i in enumerate(word)}, np.append(names[seq], np.uint64(0))
        self.by_word, self.by_gram = (np.append(_evidence(x[:, i], n) * evidence, 0).astype(np.float32) for x, i in ((by_word, word), (by_gram, seq)))

    def parts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each word's row of the learned table, its sequences' rows and the words they are of, and its evidence: its own, the
        most, least and mean of its sequences', and 1."""
        row = np.fromiter((self.words.get(w, len(self.words)) for w in words), np.int64, len(words))
        gram, of = _grams(words) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        last = len(self.grams) - 1
        at = np.minimum(np.searchsorted(self.grams[:last], gram), max(0, last - 1))
        at = np.where(self.grams[at] == gram, at, last)
        held = self.by_gram[at]
        hit = held != 0
        mine, got = of[hit], held[hit]
        high, low = np.full(len(words), -9, np.float32), np.full(len(words), 9, np.float32)
        np.maximum.at(high, mine, got)
        np.minimum.at(low, mine, got)
        times = np.bincount(mine, minlength=len(words))
        some = times > 0
        out = np.zeros((len(words), EVIDENCE), np.float32)
        out[:, 0] = self.by_word[row]
        out[some, 1], out[some, 2] = high[some], low[some]
        out[some, 3] = np.bincount(mine, got, len(words))[some] / times[some]
        out[:, 4] = 1.0
        return row, at, of, out / 2


def _mean(of: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The mean row of each of n words; zeros for those without."""
    total = np.stack([np.bincount(of, c, n) for c in rows.T], axis=1)
    return (total / np.maximum(np.bincount(of, minlength=n), 1)[:, None]).astype(np.float32)


def _windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes of each window and which of them are real; one empty window for no words."""
    starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
    at = starts[:, None] + np.arange(WINDOW)
    return np.minimum(at, max(0, n - 1)), at < n


class Network:
    def __init__(self, words: int = 0, grams: int = 0, seed: int = 5) -> None:
        draw, h = np.random.default_rng(seed), HIDDEN
        init = lambda *shape: draw.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {k: v for d in "fb" for k, v in ((f"w{d}", init(INPUTS, 3 * h)), (f"u{d}", init(h, 2 * h)), (f"c{d}", init(h, h)), (f"b{d}", np.zeros(3 * h, np.float32)))}
        self.p |= {"word": np.zeros((words + 1, LEARNED), np.float32), "gram": np.zeros((grams + 1, LEARNED), np.float32)}
        for table in ("word", "gram"):  # rows that nothing is known of stay at zero
            self.p[table][:-1] = draw.normal(0, 0.1, self.p[table][:-1].shape)
        self.p |= {"a": init(2 * h, ATTENTION), "v": init(ATTENTION, 1), "o": init(2 * h, 1), "bias": np.full(1, -1.0, np.float32)}

    def inputs(self, parts: tuple) -> np.ndarray:
        """(words, INPUTS) of what Lexicon.parts gives."""
        row, gram, of, evidence = parts
        return np.concatenate([evidence, self.p["word"][row], _mean(of, self.p["gram"][gram], len(row))], axis=1)

    def gates(self, parts: tuple, at_once: int = 20_000) -> dict[str, np.ndarray]:
        """project(inputs) of words in order, some at a time."""
        row, gram, of, evidence = parts
        out = []
        for i in range(0, len(row), at_once):
            a, b = np.searchsorted(of, (i, i + at_once))
            out.append(self.project(self.inputs((row[i : i + at_once], gram[a:b], of[a:b] - i, evidence[i : i + at_once]))))
        return {d: np.concatenate([x[d] for x in out]) for d in "fb"}

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds to the gates of either direction."""
        return {d: x @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in "fb"}

    def forward(self, gates: dict[str, np.ndarray], at: np.ndarray, real: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """The logit of each window; gates has a row for each word, at the rows of a window's words."""
        n, h, p = len(at), HIDDEN, self.p
        states = np.empty((WINDOW, n, 2 * h), np.float32)
        for k, d in enumerate("fb"):
            state = np.zeros((n, h), np.float32)
            for t in range(WINDOW) if d == "f" else reversed(range(WINDOW)):
                g = gates[d][at[:, t]]
                zr = g[:, : 2 * h] + state @ p[f"u{d}"]
                zr = 0.5 * np.tanh(0.5 * zr) + 0.5
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(g[:, 2 * h :] + (r * state) @ p[f"c{d}"])
                z = z * real[:, t, None]
                if tape is not None:
                    tape[d, t] = state, z, r, c
                state = state + z * (c - state)
                states[t, :, k * h : (k + 1) * h] = state
        u = np.tanh(states @ p["a"])
        e = np.where(real.T, (u @ p["v"])[:, :, 0], np.float32(-30))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnk->nk", a, states)
        if tape is not None:
            tape |= {"states": states, "u": u, "a": a, "pooled": pooled}
        return (pooled @ p["o"])[:, 0] + p["bias"][0]

    def gradients(self, x: np.ndarray, at: np.ndarray, real: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the loss by the network's numbers and by x."""
        tape: dict = {}
        p, h = self.p, HIDDEN
        logit = self.forward(self.project(x), at, real, tape)
        dlogit = ((1 / (1 + np.exp(-logit)) - y) * weight / weight.sum()).astype(np.float32)[:, None]
        states, u, a, pooled = (tape[k] for k in ("states", "u", "a", "pooled"))
        g = {"o": pooled.T @ dlogit, "bias": dlogit.sum(0)}
        dpooled = dlogit * p["o"].T
        da = np.einsum("nk,tnk->tn", dpooled, states)
        de = a * (da - (a * da).sum(0))
        du = de[:, :, None] * p["v"].T * (1 - u * u)
        g |= {"v": np.einsum("tnk,tn->k", u, de)[:, None], "a": np.einsum("tnk,tnj->kj", states, du)}
        dstates, dx = a[:, :, None] * dpooled + du @ p["a"].T, 0
        for k, d in enumerate("fb"):
            g |= {f"{m}{d}": np.zeros_like(p[f"{m}{d}"]) for m in "uc"}
            carry = np.zeros((len(at), h), np.float32)
            gate = np.empty((WINDOW, len(at), 3 * h), np.float32)
            for t in reversed(range(WINDOW)) if d == "f" else range(WINDOW):
                state, z, r, c = tape[d, t]
                dh = dstates[t, :, k * h : (k + 1) * h] + carry
                dc = dh * z * (1 - c * c)
                dz = dh * (c - state) * z * (1 - z) * real[:, t, None]
                drs = dc @ p[f"c{d}"].T
                dzr = np.concatenate([dz, drs * state * r * (1 - r)], axis=1)
                carry = dh * (1 - z) + drs * r + dzr @ p[f"u{d}"].T
                g[f"c{d}"] += (r * state).T @ dc
                g[f"u{d}"] += state.T @ dzr
                gate[t] = np.concatenate([dzr, dc], axis=1)
            by_word = np.zeros((len(x), 3 * h), np.float32)
            np.add.at(by_word, at.T, gate)
            g |= {f"w{d}": x.T @ by_word, f"b{d}": by_word.sum(0)}
            dx = dx + by_word @ p[f"w{d}"].T
        return g, dx

    def train(self, parts: tuple, at: np.ndarray, real: np.ndarray, y: np.ndarray, steps: int, draw: np.random.Generator, size: int = 256) -> None:
        """Adam on batches of windows; parts are those of all words, sequences in order of their words."""
        row, gram, of, evidence = parts
        start = np.searchsorted(of, np.arange(len(row) + 1))
        weight = np.where(y > 0, max(1, (y == 0).sum()) / max(1, (y > 0).sum()), 1.0) ** 0.5
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            i = draw.integers(0, len(y), min(size, len(y)))
            words, back = np.unique(at[i], return_inverse=True)
            n = start[words + 1] - start[words]
            mine = np.repeat(np.arange(len(words)), n)
            held = gram[np.repeat(start[words] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            g, dx = self.gradients(self.inputs((row[words], held, mine, evidence[words])), back.reshape(len(i), WINDOW), real[i], y[i], weight[i])
            for table, at_rows, d in (("word", row[words], dx[:, EVIDENCE : EVIDENCE + LEARNED]), ("gram", held, (dx[:, EVIDENCE + LEARNED :] / np.maximum(n, 1)[:, None])[mine])):
                g[table] = np.stack([np.bincount(at_rows, c, len(self.p[table])) for c in d.T], axis=1) + 1e-4 * self.p[table]
                g[table][-1] = 0
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                self.p[k] = (self.p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def fit(rows: Iterable[tuple[str | None, int]], rounds: int = 3, steps: int = 150, evidence: bool = True) -> tuple[Lexicon, dict] | None:
    """The lexicon and the network's numbers from (text, label) rows; None without labels of both kinds."""
    places: dict[bytes, int] = {}
    docs, labels, copies = [], [], set()
    for t, y in rows:
        words = words_of((t or "").encode("utf-8", "ignore"))
        same = blake2b(b" ".join(words) + bytes([int(y)]), digest_size=16).digest()
        if same not in copies:
            copies.add(same)
            for w in words:
                places.setdefault(w, len(places))
            docs.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
            labels.append(int(y))
    label, vocab = np.array(labels, np.int64), list(places)
    if len(set(labels)) < 2:
        return None
    lexicon = Lexicon(docs, label, vocab, evidence)
    parts, every = [], [*vocab, b"", UNKNOWN]
    for i in range(0, len(every), 20_000):
        row, gram, of, known = lexicon.parts(every[i : i + 20_000])
        order = np.argsort(of, kind="stable")
        parts.append((row.astype(np.int32), gram[order].astype(np.int32), (of[order] + i).astype(np.int32), known))
    parts = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    known = parts[3]
    ats, reals, doc = [], [], []
    for k, words in enumerate(docs):
        at, real = _windows(len(words))
        ats.append((words[at] if len(words) else np.full_like(at, len(vocab))).astype(np.int32))
        reals.append(real)
        doc.append(np.full(len(at), k))
    at, real, doc = np.concatenate(ats), np.concatenate(reals), np.concatenate(doc)
    draw, net = np.random.default_rng(3), Network(len(lexicon.words), len(lexicon.grams) - 1)
    score = known[:, :2].sum(1)[at].max(1, where=real, initial=-9)
    if not evidence:
        score = draw.random(len(at))
    for _ in range(rounds):
        order = np.lexsort((-score, doc))
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
        toxic = label[doc] > 0
        pick = np.flatnonzero(np.where(toxic, rank < 1 if evidence else rank < 4, (rank < 2) | (draw.random(len(doc)) < 0.02)))
        net.train(parts, at[pick], real[pick], label[doc[pick]], steps, draw)
        gates = net.gates(parts)
        score = np.concatenate([net.forward(gates, at[i : i + 8192], real[i : i + 8192]) for i in range(0, len(at), 8192)])
    top = np.full(len(docs), -np.inf)
    np.maximum.at(top, doc, score)
    order = np.argsort(-top, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(top) + 1) + label.sum())
    best = int(np.argmax(f1))
    under = top[order[min(best + 1, len(top) - 1)]]
    edge = 0.6 * top[order[best]] + 0.4 * under
    if under >= top[order[best]]:
        edge = top.max() + 30  # no score tells the labels apart
    strange = np.arange(WINDOW) < np.arange(1, WINDOW + 1)[:, None]
    known_nothing = net.forward(gates, np.full((WINDOW, WINDOW), len(vocab) + 1, np.int32), strange).max()
    edge = max(edge, float(known_nothing) + 1e-3)  # words that nothing is known of are no sign of toxicity
    net.p["bias"] = (net.p["bias"] - np.float32(edge)).astype(np.float32)
    return lexicon, net.p


def _scorer(model: tuple[Lexicon, dict] | None, name: str) -> Callable:
    def start() -> Callable[[list[bytes]], dict]:
        if model is None:
            return lambda batch: {name: [0.0] * len(batch)}
        lexicon, net = model[0], Network()
        net.p = model[1]

        def make(words: list[bytes]) -> np.ndarray:
            gates = net.project(net.inputs(lexicon.parts(words)))
            return np.concatenate([gates["f"], gates["b"]], axis=1)

        table, wide = WordRows(make, 60_000), 3 * HIDDEN

        def work(batch: list[bytes]) -> dict:
            *where, blank = table.indexes([*(words_of(t) for t in batch), [b""]])
            gates = {"f": table.rows[:, :wide], "b": table.rows[:, wide:]}
            spans = [_windows(len(w)) for w in where]
            at = np.concatenate([w[s] if len(w) else np.full_like(s, blank[0]) for w, (s, _) in zip(where, spans, strict=True)])
            real = np.concatenate([r for _, r in spans])
            logits = np.concatenate([net.forward(gates, at[i : i + 4096], real[i : i + 4096]) for i in range(0, len(at), 4096)])
            first = np.cumsum([0, *(len(s) for s, _ in spans[:-1])])
            top = np.maximum.reduceat(logits, first).astype(np.float64)
            return {name: 1 / (1 + np.exp(-np.clip(top, -30, 30)))}

        return work

    return start


def learn(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple | None:
    """Fits on at most sample documents of each label among the usable rows of labels."""
    drawn = bounded_sample(labels.where(usable).where(F.col(label_col).isin(0, 1)), id_col, label_col, sample)
    held = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(drawn.toDF("__id", "__label")), "__id")
    rows = held.groupBy("__id", "__label").agg(F.min("__text").alias("__text"))  # one text of an id, however often it repeats

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        model = fit((t, y) for b in parts for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    one = rows.repartition(1).sortWithinPartitions("__id", "__label").select("__text", F.col("__label").cast("int"))
    made = one.mapInArrow(train, "model binary").collect()
    return pickle.loads(made[0][0]) if made else None


def score_toxicity(docs: DataFrame, model: tuple | None, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The kept columns and a score in 0 to 1 for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, text_col, lambda: _scorer(shared.value, name)(), f"{name} double", keep)


def filter_toxic(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is one half at most."""
    model = learn(docs, labels, usable, id_col, text_col)
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return score_toxicity(held, model, "text", keep=["row"], name="score").where("score <= 0.5").select("row.*")
