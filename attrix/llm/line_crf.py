"""Operator 2: line labelling by a linear-chain conditional random field with Viterbi decoding.

Every line of a text is content or boilerplate. Features of a line (size, symbols, capitals, repeats, ends) give its
emission scores, neighbours are tied by transition scores, and the best sequence is found by Viterbi. A text is kept
if it doesn't fail the base rules and at least ``KEEP_SHARE`` of its words stand on content lines.

The field is trained on the lines of at most ``TRAIN_DOCS`` labelled texts (a documented bound; the smallest hashes of
ids, so any run takes the same ones). Lines of low-quality texts, repeated lines and lines of symbols count as
boilerplate, other lines as content. With no labelled text a field of fixed weights by the same rules is used.

A null or wordless text has no lines with words: it fails the base rules. Repeated rows give repeated results; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import id_and_bytes

TRAIN_DOCS = 1500     # labelled texts that the field is trained on
TRAIN_LINES = 400     # lines of a stretch; longer training texts are several, one after the other
STEPS = 150           # training steps
LEAST_WORDS = 50      # base: words of a text
REPEATED_PERCENT = 50  # base: most words in repeated three-word windows, in percent
KEEP_SHARE = 0.5      # least share of words on content lines

SYMBOLS = b"#*$%&|<>"
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_INNER = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!?"
FEATURES = 17


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Binary features (lines x FEATURES) and the number of words of each line that has one."""
    seen: set[bytes] = set()
    rows, words = [], []
    for line in text.split(b"\n"):
        ws = line.split()
        n = len(ws)
        if not n:
            continue
        size = len(line)
        symbols = size - len(line.translate(None, SYMBOLS))
        upper = size - len(line.translate(None, _UPPER))
        digits = size - len(line.translate(None, _DIGITS))
        marks = size - len(line.translate(None, _MARKS))
        again = line in seen
        seen.add(line)
        end = ws[-1][-1:]
        rows.append((
            1, n <= 2, 3 <= n <= 5, 6 <= n <= 20, n > 60, symbols > 0, symbols * 50 > size, symbols * 10 > size,
            upper * 10 > 4 * size, digits * 5 > size, marks * 30 > size, again, end in b".!?" and end != b"",
            not end.isalnum() and end not in (b".", b"!", b"?"), size > 14 * n, 3 * len(set(ws)) < 2 * n,
            line[:1].islower(),
        ))
        words.append(n)
    return np.array(rows, np.float32).reshape(-1, FEATURES), np.array(words, np.int64)


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    size = len(numbers)
    if size < 1 << 21:
        _, place, count = np.unique((ids[:-2] * size + ids[1:-1]) * size + ids[2:], return_inverse=True,
                                    return_counts=True)
    else:
        _, pair = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)
        _, place, count = np.unique(pair * size + ids[2:], return_inverse=True, return_counts=True)
    often = count[place] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= often
    return int(covered.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = len(text) - len(text.translate(None, _INNER))
    spaces = len(text) - len(text.translate(None, _SPACE))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return len(words), len(text) - chars - spaces, symbols, len(lines) - len(set(lines)), repeat_words(words)


class Field:
    """Weights (2 x FEATURES), start scores (2) and transition scores (2 x 2); label 1 is content."""

    def __init__(self, weights: np.ndarray, start: np.ndarray, moves: np.ndarray):
        self.weights, self.start, self.moves = weights, start, moves

    def decode(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi labels of many texts' lines; the longest first, so that each step runs over those still going."""
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        sizes = np.array([len(texts[k]) for k in order])
        live = sizes > 0
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
        if not live.any():
            return out
        sizes = sizes[live]
        first = np.cumsum(sizes) - sizes
        scores = np.concatenate([texts[k] for k in order]) @ self.weights.T.astype(np.float32)
        best = scores[first] + self.start
        back = np.zeros((len(scores), 2), np.int8)
        final = np.zeros((len(sizes), 2))
        for step in range(int(sizes[0])):
            n = int((sizes > step).sum())
            if step:
                ways = best[:n, :, None] + self.moves
                back[first[:n] + step] = ways.argmax(axis=1)
                best = ways.max(axis=1) + scores[first[:n] + step]
            final[:n] = best[:n]
        label = final.argmax(axis=1)
        labels = np.zeros(len(scores), np.int8)
        for step in range(int(sizes[0]) - 1, -1, -1):
            n = int((sizes > step).sum())
            own = np.arange(n)
            labels[first[:n] + step] = label[:n]
            label[:n] = back[first[:n] + step][own, label[:n]]
        for k, f, s in zip(order, first, sizes):
            out[k] = labels[f:f + s]
        return out

    @classmethod
    def fixed(cls) -> Field:
        w = np.zeros((2, FEATURES))
        w[1, 0] = 1.0
        w[0, [1, 6, 7, 8, 9, 10, 11]] = 1.5
        return cls(w, np.zeros(2), np.array([[0.5, -0.5], [-0.5, 0.5]]))

    @classmethod
    def train(cls, texts: list[np.ndarray], labels: list[np.ndarray]) -> Field:
        """Maximum conditional likelihood with a small quadratic penalty, by Adam over all texts at once."""
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        x = [texts[k] for k in order]
        sizes = np.array([len(t) for t in x])
        first = np.cumsum(sizes) - sizes
        every, y = np.concatenate(x).astype(float), np.concatenate([labels[k] for k in order]).astype(int)
        live = [int((sizes > s).sum()) for s in range(int(sizes[0]))]
        one = np.eye(2)[y]
        parameters = [np.zeros((2, every.shape[1])), np.zeros(2), np.zeros((2, 2))]
        means, squares = [p * 0 for p in parameters], [p * 0 for p in parameters]
        for step in range(1, STEPS + 1):
            weights, start, moves = parameters
            scores = every @ weights.T
            a, b = np.zeros_like(scores), np.zeros_like(scores)
            a[first] = scores[first] + start
            for s, n in enumerate(live[1:], 1):
                a[first[:n] + s] = np.logaddexp.reduce(a[first[:n] + s - 1][:, :, None] + moves, axis=1) + scores[
                    first[:n] + s]
            expected = np.zeros((2, 2))
            total = np.logaddexp.reduce(a[first + sizes - 1], axis=1)
            for s in range(len(live) - 1, 0, -1):
                n = live[s]
                at = first[:n] + s
                ahead = scores[at] + b[at]
                ways = a[at - 1][:, :, None] + moves + ahead[:, None, :] - total[:n, None, None]
                expected += np.exp(ways).sum(axis=0)
                b[at - 1] = np.logaddexp.reduce(moves + ahead[:, None, :], axis=2)
            share = np.exp(a + b - np.repeat(total, sizes)[:, None])
            seen = np.zeros((2, 2))
            inner = np.ones(len(y), bool)
            inner[first] = False
            np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
            gradients = [(one - share).T @ every, (one - share)[first].sum(axis=0), seen - expected]
            for k, g in enumerate(gradients):
                g = g / len(y) - 1e-4 * parameters[k]
                means[k] = 0.9 * means[k] + 0.1 * g
                squares[k] = 0.99 * squares[k] + 0.01 * g * g
                fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                parameters[k] = parameters[k] + 0.1 * fix * means[k] / (np.sqrt(squares[k]) + 1e-9)
        return cls(*parameters)


def train_field(docs: DataFrame, labels: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field from at most TRAIN_DOCS texts with a quality label, half of each class at most."""
    marked = labels.where("quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("good"))
    texts: list[np.ndarray] = []
    lines: list[np.ndarray] = []
    for good in (0, 1):
        some = marked.where(F.col("good") == good).orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS // 2)
        rows = id_and_bytes(docs, doc_col, text_col).join(F.broadcast(some), F.col("doc_id") == F.col("id")).select("text")
        for row in rows.limit(TRAIN_DOCS).collect():
            x, _ = line_features(bytes(row["text"]))
            for at in range(0, len(x), TRAIN_LINES):
                part = x[at:at + TRAIN_LINES]
                texts.append(part)
                lines.append(((part[:, 11] == 0) & (part[:, 7] == 0)).astype(int) * good)
    if not texts or len(np.unique(np.concatenate(lines))) < 2:
        return Field.fixed()
    return Field.train(texts, lines)


def line_quality(docs: DataFrame, field: Field, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, content_share, and a label per line (1 content, 0 boilerplate)."""
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = np.array([base_counts(t) for t in frame["text"]], np.int64).reshape(-1, 5)
            parts = [line_features(t) for t in frame["text"]]
            labels = field.decode([x for x, _ in parts])
            share = np.array([float(w[on == 1].sum() / w.sum()) if len(w) else 0.0 for (_, w), on in zip(parts, labels)])
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > REPEATED_PERCENT * counts[:, 0])
            out = pd.DataFrame(counts, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            out["base_failed"], out["kept"] = failed, ~failed & (share >= KEEP_SHARE)
            out["content_share"], out["line_labels"] = share, [x.astype(np.int32) for x in labels]
            yield out

    return id_and_bytes(docs, doc_col, text_col).mapInPandas(
        rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, kept boolean, content_share double, line_labels array<int>")
