"""Operator 6: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words go in as their log-odds between toxic and clean training texts, a learned vector (frequent training
words) and the mean of learned vectors of their character trigrams. Two recurrent passes read every window of
``WINDOW`` words (each overlaps the next; they cover the whole text), attention pools their states, and the largest
window logit, calibrated on whole training texts, gives the text's score.

Trained on at most ``TRAIN_EACH`` toxic and twice as many clean labelled texts (a documented bound; the smallest hashes of ids). A
toxic text teaches by its highest window so far, a clean one by its highest and another.

Null and wordless texts get the score of a text without evidence (below 0.5); repeated rows get the same score; with
labels of one class or none every score is the share of toxic ones; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import fold, hold, id_and_bytes, text_runs

TRAIN_EACH = 700      # toxic texts of the training sample; twice as many clean ones
WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM, BUCKETS = 8, 6, 5, 1024
ROUNDS, EPOCHS, BATCH = 5, 3, 128
LEAST_TEXTS = 5       # training texts that have a word with a vector of its own
SHRINK = 16           # texts of a word at which its log-odds count half
CACHE_WORDS = 100_000  # words whose inputs a worker keeps
RUN_BYTES = 1 << 20   # bytes of texts scored together
BLOCK = 2048          # windows of one pass

#: Letters and digits of ASCII, A-Z lower-cased, and all bytes beyond; the others part words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))
INPUT = 1 + WORD_DIM + CHAR_DIM


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams of all words (with marks at both ends) and where each word's begin."""
    joined = np.frombuffer(b"".join([b"^" + w + b"$" for w in words]), np.uint8).astype(np.uint32)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(sizes)
    code = (joined[:-2] * 961 + joined[1:-1] * 31 + joined[2:]) * np.uint32(2654435761)
    inside = np.ones(len(code), bool)
    cut = np.concatenate([ends[:-1] - 1, ends[:-1] - 2])
    inside[cut[cut < len(code)]] = False
    return (code[inside] >> np.uint32(22)).astype(np.int64) % BUCKETS, np.cumsum(sizes - 2) - (sizes - 2)


def window_starts(n: int) -> np.ndarray:
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.unique(np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW))


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): an activation between -1 and 1 without exponentials; its slope is (1 - |value|) squared."""
    return x / (1 + np.abs(x))


def _slope(value: np.ndarray) -> np.ndarray:
    return np.square(1 - np.abs(value))


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * _squash(x)


def _gate_slope(gate: np.ndarray) -> np.ndarray:
    return 0.5 * _slope(2 * gate - 1)


class Network:
    """Parameters by name; the vocabulary of words with vectors and their log-odds."""

    def __init__(self, vocabulary: dict[bytes, int], odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary, self.odds = vocabulary, odds.astype(np.float32)

        def random(*shape: int, scale: float) -> np.ndarray:
            return (rng.normal(size=shape) * scale).astype(np.float32)

        self.p = {"words": random(len(vocabulary) + 1, WORD_DIM, scale=0.05),
                  "chars": random(BUCKETS, CHAR_DIM, scale=0.05),
                  "attend": random(2 * HIDDEN, HIDDEN, scale=0.3), "query": random(HIDDEN, scale=0.3),
                  "out": random(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": random(INPUT, 3 * HIDDEN, scale=0.4), f"own_{d}": random(HIDDEN, 3 * HIDDEN, scale=0.3),
                       f"shift_{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.scale, self.offset = 1.0, 0.0
        self.constant: float | None = None

    # inputs of words

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Input vectors of words."""
        number = np.array([self.vocabulary.get(w, len(self.vocabulary)) for w in words], np.int64)
        grams, start = trigrams(words)
        size = np.diff(np.append(start, len(grams)))
        chars = np.add.reduceat(self.p["chars"][grams], start) / size[:, None]
        return np.concatenate([self.odds[number][:, None], self.p["words"][number], chars], axis=1).astype(np.float32)

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        """Each direction's input parts of the gates."""
        return [x @ self.p[f"in_{d}"] + self.p[f"shift_{d}"] for d in "fb"]

    # scoring

    def _pass(self, rows: np.ndarray, at: np.ndarray, mask: np.ndarray | None, d: str) -> np.ndarray:
        """States after each word (steps x HIDDEN x windows)."""
        steps, own = at.shape[1], np.ascontiguousarray(self.p[f"own_{d}"].T)
        h = np.zeros((HIDDEN, len(at)), np.float32)
        states = np.empty((steps, HIDDEN, len(at)), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g, u = np.ascontiguousarray(rows.take(at[:, t], axis=0).T), own @ h
            g[:2 * HIDDEN] += u[:2 * HIDDEN]
            gate = _gate(g[:2 * HIDDEN])
            new = g[2 * HIDDEN:]
            new += gate[HIDDEN:] * u[2 * HIDDEN:]
            new = _squash(new)
            nxt = new + gate[:HIDDEN] * (h - new)
            h = nxt if mask is None else np.where(mask[:, t], nxt, h)
            states[t] = h
        return states

    def logits(self, rows: list[np.ndarray], at: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Logits of windows given as rows of the gate tables (windows x words)."""
        states = np.concatenate([self._pass(r, at, mask, d) for r, d in zip(rows, "fb")], axis=1)
        e = np.matmul(self.p["query"], _squash(np.matmul(np.ascontiguousarray(self.p["attend"].T), states)))
        if mask is not None:
            e = np.where(mask.T, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        return (e * np.matmul(self.p["out"], states)).sum(axis=0) / e.sum(axis=0) + self.p["bias"][0]

    def window_logits(self, rows: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of all windows of texts with words; the text and the start of each."""
        found, of, begin = [], [], []
        long = [k for k, t in enumerate(texts) if len(t) >= WINDOW]
        if long:
            flat = np.concatenate([texts[k] for k in long])
            base = np.cumsum([0, *(len(texts[k]) for k in long)])
            starts = [window_starts(len(texts[k])) for k in long]
            place = np.concatenate([s + b for s, b in zip(starts, base)])
            of.append(np.repeat(long, [len(s) for s in starts]))
            begin.append(np.concatenate(starts))
            for k in range(0, len(place), BLOCK):
                found.append(self.logits(rows, flat[place[k:k + BLOCK, None] + np.arange(WINDOW)]))
        short = [k for k, t in enumerate(texts) if 0 < len(t) < WINDOW]
        for k in range(0, len(short), BLOCK):
            some = short[k:k + BLOCK]
            at, mask = np.zeros((len(some), WINDOW), np.int64), np.zeros((len(some), WINDOW), bool)
            for r, text in enumerate(some):
                at[r, :len(texts[text])], mask[r, :len(texts[text])] = texts[text], True
            found.append(self.logits(rows, at, mask))
            of.append(np.array(some))
            begin.append(np.zeros(len(some), np.int64))
        if not found:
            return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(of), np.concatenate(begin)

    def text_logits(self, rows: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
        """The largest window logit of each text; minus infinity without words."""
        out = np.full(len(texts), -np.inf)
        found, of, _ = self.window_logits(rows, texts)
        np.maximum.at(out, of, found)
        return out

    def scores(self, logits: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logits), self.constant)
        least = -4.0 if self.scale <= 0 else min(-4.0, (-4.0 - self.offset) / self.scale)
        x = self.scale * np.maximum(logits, least) + self.offset
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    # training

    def gradients(self, words: list[bytes], at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the weighted log-loss of windows (numbers of ``words``, windows x words)."""
        p, table = self.p, self.inputs(words)
        x = table[at]
        n, steps = at.shape
        kept, states = {}, {}
        for d in "fb":
            h, track = np.zeros((n, HIDDEN), np.float32), []
            states[d] = np.empty((steps, n, HIDDEN), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                g, u = x[:, t] @ p[f"in_{d}"] + p[f"shift_{d}"], h @ p[f"own_{d}"]
                z, r = np.split(_gate(g[:, :2 * HIDDEN] + u[:, :2 * HIDDEN]), 2, axis=1)
                un = u[:, 2 * HIDDEN:]
                new = _squash(g[:, 2 * HIDDEN:] + r * un)
                track.append((t, h, z, r, un, new))
                h = np.where(mask[:, t, None], new + z * (h - new), h)
                states[d][t] = h
            kept[d] = track
        s = np.concatenate([states["f"], states["b"]], axis=2)
        a = _squash(s @ p["attend"])
        e = np.where(mask.T, a @ p["query"], -1e9)
        e = np.exp(e - e.max(axis=0))
        share = e / e.sum(axis=0)
        value = s @ p["out"]
        logit = (share * value).sum(axis=0) + p["bias"][0]
        dl = (1 / (1 + np.exp(-logit)) - y) * weight / weight.sum()
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["bias"][0] = dl.sum()
        dvalue = share * dl
        de = share * (value - (share * value).sum(axis=0)) * dl
        grad["out"] = np.einsum("tn,tnh->h", dvalue, s)
        grad["query"] = np.einsum("tn,tnh->h", de, a)
        da = de[:, :, None] * p["query"] * _slope(a)
        grad["attend"] = np.einsum("tni,tnj->ij", s, da)
        ds = dvalue[:, :, None] * p["out"] + da @ p["attend"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            dh = np.zeros((n, HIDDEN), np.float32)
            for t, h, z, r, un, new in reversed(kept[d]):
                dh = dh + ds[t, :, k * HIDDEN:(k + 1) * HIDDEN]
                live = mask[:, t, None]
                dn = np.where(live, dh * (1 - z) * _slope(new), 0)
                dz = np.where(live, dh * (h - new) * _gate_slope(z), 0)
                dr = dn * un * _gate_slope(r)
                dg = np.concatenate([dz, dr, dn], axis=1)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                grad[f"in_{d}"] += x[:, t].T @ dg
                grad[f"shift_{d}"] += dg.sum(axis=0)
                grad[f"own_{d}"] += h.T @ du
                dx[:, t] += dg @ p[f"in_{d}"].T
                dh = np.where(live, dh * z, dh) + du @ p[f"own_{d}"].T
        dtable = np.zeros_like(table)
        np.add.at(dtable, at.reshape(-1), dx.reshape(-1, INPUT))
        number = np.array([self.vocabulary.get(w, len(self.vocabulary)) for w in words])
        np.add.at(grad["words"], number, dtable[:, 1:1 + WORD_DIM])
        grams, start = trigrams(words)
        size = np.diff(np.append(start, len(grams)))
        np.add.at(grad["chars"], grams, np.repeat(dtable[:, 1 + WORD_DIM:] / size[:, None], size, axis=0))
        return grad


def _log_odds(texts: list[list[bytes]], y: np.ndarray) -> tuple[dict[bytes, int], np.ndarray]:
    """Words of enough texts, and the log ratio of their shares of toxic and of clean texts (0 for all others)."""
    counts: dict[bytes, list[int]] = {}
    for words, label in zip(texts, y):
        for w in set(words):
            counts.setdefault(w, [0, 0])[int(label)] += 1
    often = sorted(w for w, c in counts.items() if sum(c) >= LEAST_TEXTS)
    toxic, clean = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    # a word of few texts says little: its ratio shrinks
    odds = [(np.log((counts[w][1] + 1) / (toxic + 2)) - np.log((counts[w][0] + 1) / (clean + 2)))
            * sum(counts[w]) / (sum(counts[w]) + SHRINK) for w in often]
    return {w: k for k, w in enumerate(often)}, np.append(np.array(odds), 0.0)


def train_network(texts: list[bytes], y: np.ndarray, prior: float, seed: int = 7) -> Network:
    """A network from labelled texts; ``prior`` is the share of toxic texts that the calibration assumes."""
    words = [words_of(t) for t in texts]
    vocabulary, odds = _log_odds(words, y)
    net = Network(vocabulary, odds, seed)
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    every = list(dict.fromkeys(w for ws in words for w in ws))
    number = {w: k for k, w in enumerate(every)}
    rows = [np.array([number[w] for w in ws], np.int64) for ws in words]
    del words, number, texts  # the driver keeps numbers alone while it trains
    strength = np.maximum(net.odds[[vocabulary.get(w, len(vocabulary)) for w in every]], 0)
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for turn in range(ROUNDS):
        if turn == 0:
            pieces = [(k, s, strength[r[s:s + WINDOW]].max()) for k, r in enumerate(rows) if len(r)
                      for s in window_starts(len(r))]
            of, begin, value = (np.array(v) for v in zip(*pieces))
        else:
            value, of, begin = net.window_logits(net.gates(net.inputs(every)), rows)
        chosen = []
        order = np.lexsort((-value, of))
        head = order[np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))]
        for w in head:
            chosen.append((of[w], begin[w]))
        for w in rng.permutation(len(of))[: len(head)]:
            if not y[of[w]]:
                chosen.append((of[w], begin[w]))
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // BATCH)):
                some = [chosen[k] for k in at]
                width = max(min(WINDOW, len(rows[t])) for t, _ in some)
                ids, mask = np.zeros((len(some), width), np.int64), np.zeros((len(some), width), bool)
                for r, (t, s) in enumerate(some):
                    piece = rows[t][s:s + width]
                    ids[r, :len(piece)], mask[r, :len(piece)] = piece, True
                different, place = np.unique(ids, return_inverse=True)
                labels = y[[t for t, _ in some]].astype(np.float32)
                weight = np.where(labels > 0, 1.0, 0.7).astype(np.float32)
                grad = net.gradients([every[k] for k in different], place.reshape(ids.shape), mask, labels, weight)
                step += 1
                fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                for k, g in grad.items():
                    g = np.clip(g + 1e-4 * net.p[k], -1, 1)
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    net.p[k] = (net.p[k] - 0.02 * fix * mean[k] / (np.sqrt(square[k]) + 1e-7)).astype(np.float32)
    # calibration of the largest logit on whole texts, with classes weighted as among all labels
    x = np.maximum(net.text_logits(net.gates(net.inputs(every)), rows), -12)
    weight = np.where(y > 0, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum()))
    a, b = 1.0, 0.0
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight * (q - y)
        s = weight * q * (1 - q) + 1e-9
        ga, gb = (g * x).sum() + 1e-4 * a, g.sum()
        haa, hab, hbb = (s * x * x).sum() + 1e-4, (s * x).sum(), s.sum() + 1e-6
        det = haa * hbb - hab * hab
        a, b = a - np.clip((hbb * ga - hab * gb) / det, -2, 2), b - np.clip((haa * gb - hab * ga) / det, -2, 2)
    net.scale, net.offset = float(a), float(b)
    return net


def fit(docs: DataFrame, labels: DataFrame, doc_col: str = "doc_id", text_col: str = "text", mod: int = 5) -> Network:
    """Trains on a bounded sample of the labelled rows whose id's crc32 modulo ``mod`` isn't 0."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max("toxic").alias("toxic")).where(fold("id", mod) != 0)
    sums = marked.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    texts: list[bytes] = []
    y: list[int] = []
    for label, bound in ((1, TRAIN_EACH), (0, 2 * TRAIN_EACH)):
        some = marked.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(bound)
        rows = id_and_bytes(docs, doc_col, text_col).join(F.broadcast(some), F.col("doc_id") == F.col("id"))
        for row in rows.select("doc_id", "text").limit(bound).collect():
            texts.append(bytes(row["text"]))
            y.append(label)
    order = sorted(range(len(texts)), key=lambda k: (zlib.crc32(texts[k]), texts[k]))  # any order of rows, one model
    prior = (sums["t"] or 0) / max(1, sums["n"])
    return train_network([texts[k] for k in order], np.array([y[k] for k in order], np.int64), prior)


class Scorer:
    """A network with the gate inputs of the words it met lately."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.rows = [np.zeros((0, 3 * HIDDEN), np.float32)] * 2

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        words = [words_of(t) for t in texts]
        if len(self.number) > CACHE_WORDS:
            self.clear()
        new = list(set().union(*words).difference(self.number))
        if new:
            before, after = len(self.number), len(self.number) + len(new)
            self.number.update(zip(new, range(before, after)))
            fresh = self.net.gates(self.net.inputs(new))
            for k in range(2):
                if after > len(self.rows[k]):
                    grown = np.zeros((max(after, 2 * len(self.rows[k])), 3 * HIDDEN), np.float32)
                    grown[:before] = self.rows[k][:before]
                    self.rows[k] = grown
                self.rows[k][before:after] = fresh[k]
        numbered = [np.fromiter(map(self.number.__getitem__, ws), np.int64, len(ws)) for ws in words]
        return self.net.scores(self.net.text_logits(self.rows, numbered))


_SCORERS: dict[int, Scorer] = {}


def _scorer(broadcast) -> Scorer:
    hold("gru_toxicity", _SCORERS.clear)
    key = id(broadcast.value)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(broadcast.value)
    return _SCORERS[key]


def _score_all(texts: list[bytes], scorer: Scorer) -> np.ndarray:
    runs = [scorer(texts[a:b]) for a, b in text_runs(texts, RUN_BYTES)]
    return np.concatenate(runs) if runs else np.zeros(0)


def toxicity_column(net: Network, text_col: str = "text"):
    """A column with the score of each whole text, for filters on whole rows."""
    shared = _shared(net)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(_score_all(texts.tolist(), _scorer(shared)))

    return score(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def _shared(net: Network):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(net)  # a vocabulary of the bounded sample


def toxicity(docs: DataFrame, net: Network, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    shared = _shared(net)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(shared)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"),
                                "score": _score_all(frame["text"].tolist(), scorer)})

    return id_and_bytes(docs, doc_col, text_col).mapInPandas(rows, "doc_id long, score double")
