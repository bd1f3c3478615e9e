"""Operator 4: language by unigram pieces, summed over all segmentations of the text.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is
the sum over all ways to cut it into pieces, by a forward recursion over its letters; a text's is the product over its
words. Piece probabilities are learned by expectation maximisation with the matching backward recursion, on the words of at
most ``TRAIN_EACH`` training texts of each language (a documented bound; the smallest hashes of ids), one Spark task a
language. Every language of the training texts is learned. Texts are scored by ``BLOCK`` languages at a time, each block
in a pass of its own beyond the first, so neither driver nor workers hold more of the model.

A text is lower-cased and cut into runs of letters; a run of over ``LONGEST`` letters counts as several words, one after
the other. Letters that no piece has cost the same in all languages. A null text and one without letters give ``und``
with score 0; equal languages take the first by name; without a training text everything is ``und``; repeated rows
give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrix.llm.common import drop_path, fold, hold, id_and_text, stored, text_runs

TRAIN_EACH = 250        # training texts of a language
BLOCK = 200             # languages that the driver and workers hold at a time
BROADCAST_LANGS = 500_000  # language names with their counts that are broadcast at most
ROUNDS = 3              # of expectation maximisation
LONGEST = 48            # letters of a word
RARE = 1e-7             # probability of a letter that no piece has
PRIOR = 0.05            # expected count that each piece starts a round with
CACHE_WORDS = 150_000   # words whose probabilities a worker keeps
RUN_CHARS = 1 << 20
ROWS = 5_000            # words in one recursion
BITS = 20               # of the filter of piece hashes

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _RUNS.findall(text.lower())


class Lattice:
    """The pieces of a vocabulary (``\\u2581`` marks a word's start) and the places of pieces in words."""

    def __init__(self, pieces: list[str]):
        # pieces with other characters than letters are in no word; the longest of letters sets the recursion's width
        kept = sorted({p for p in pieces if p and p.lower() == p and (p == "▁" or _RUNS.fullmatch(p.removeprefix("▁")))})
        self.width = max(map(len, kept), default=1)
        codes = self._hash_all(kept)
        codes, first = np.unique(codes, return_index=True)
        self.codes = codes
        self.pieces = [kept[k] for k in first]
        self.filter = np.zeros(1 << BITS, bool)
        self.filter[codes >> np.uint64(64 - BITS)] = True
        self.size = len(self.pieces) + 1  # the last one: a letter that no piece has

    @staticmethod
    def _hash_all(texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.uint64)
        with np.errstate(over="ignore"):
            for k, t in enumerate(texts):
                h = np.uint64(0)
                for c in t:
                    h = (h + np.uint64(ord(c) + 1)) * _MULTIPLIER
                out[k] = h ^ (h >> np.uint64(31))
        return out

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words by like length: their places, and the numbers of pieces (words x letters x piece length; -1: none).

        The piece of length j + 1 that ends with letter i is at [:, i, j].
        """
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(k)
        for length, which in sorted(by.items()):
            for at in range(0, len(which), max(1, ROWS * 8 // length)):
                some = np.array(which[at:at + max(1, ROWS * 8 // length)])
                raw = "".join(["▁" + words[k] for k in some])
                code = np.frombuffer(raw.encode("utf-32-le"), np.uint32).reshape(len(some), length).astype(np.uint64)
                code += np.uint64(1)
                width = min(self.width, length)
                found = np.full((len(some), length, width), -1, np.int32)
                h = np.zeros((len(some), length), np.uint64)
                for j in range(width):
                    h = (h[:, :length - j] + code[:, j:]) * _MULTIPLIER  # of pieces that start at each letter
                    v = h ^ (h >> np.uint64(31))
                    r, c = np.nonzero(self.filter[v >> np.uint64(64 - BITS)])
                    place = np.minimum(np.searchsorted(self.codes, v[r, c]), len(self.codes) - 1)
                    hit = self.codes[place] == v[r, c]
                    found[r[hit], c[hit] + j, j] = place[hit]
                    h = h[:, :-1]
                alone = found[:, :, 0]
                alone[alone < 0] = self.size - 1
                yield some, found

    def forward(self, found: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Sums over all segmentations before each letter (letters + 1 x words x languages); ``table`` has a row a
        piece and a last row of zeros for none."""
        n, length, width = found.shape
        a = np.zeros((length + 1, n, table.shape[1]))
        a[0] = 1
        for i in range(length):
            for j in range(min(width, i + 1)):
                a[i + 1] += a[i - j] * table[found[:, i, j]]
        return a


class Model:
    def __init__(self, lattice: Lattice, langs: list[str], table: np.ndarray):
        self.lattice, self.langs, self.table = lattice, langs, table
        self.number: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)))

    def word_logs(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        for some, found in self.lattice.groups(words):
            out[some] = np.log(self.lattice.forward(found, self.table)[-1] + 1e-300)
        return out

    def best(self, texts: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """The best language of each text (None without letters), its log probability, and all languages' sum over its own."""
        cut = [[p for w in words_of(t or "") for p in _pieces(w)] for t in texts]
        if len(self.number) > CACHE_WORDS:
            self.number, self.rows = {}, self.rows[:0]
        new = list(set().union(*cut).difference(self.number)) if self.langs else []
        if new:
            before, after = len(self.number), len(self.number) + len(new)
            self.number.update(zip(new, range(before, after)))
            if after > len(self.rows):
                grown = np.zeros((max(after, 2 * len(self.rows)), len(self.langs)))
                grown[:before] = self.rows[:before]
                self.rows = grown
            self.rows[before:after] = self.word_logs(new)
        names, logs, sums = [], np.zeros(len(texts)), np.ones(len(texts))
        for k, words in enumerate(cut):
            if not self.langs or not any(c.isalpha() for w in words for c in w):
                names.append(None)
                continue
            total = self.rows[np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            names.append(self.langs[best])
            logs[k], sums[k] = total[best], np.exp(np.minimum(total - total[best], 0)).sum()
        return names, logs, sums


def _pieces(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[k:k + LONGEST] for k in range(0, len(word), LONGEST)]


def learn(lattice: Lattice, counts: Counter) -> np.ndarray:
    """Expected counts of a language's pieces from its words' counts; the last one is that of no piece."""
    words = list(counts)
    n = np.array([counts[w] for w in words], float)
    p = np.full(lattice.size, 1.0 / lattice.size)
    p[-1] = RARE
    for _ in range(ROUNDS):
        expected = np.full(lattice.size, PRIOR)
        one = np.append(p, 0.0)[:, None]
        for some, found in lattice.groups(words):
            a = lattice.forward(found, one)[:, :, 0]
            length, width = found.shape[1:]
            b = np.zeros_like(a)
            b[length] = 1
            scale = n[some] / np.maximum(a[length], 1e-300)
            for i in range(length, 0, -1):
                for j in range(min(width, i)):
                    piece = found[:, i - 1, j]
                    q = one[piece, 0]
                    hit = piece >= 0
                    share = a[i - 1 - j] * q * b[i] * scale
                    expected += np.bincount(piece[hit], share[hit], lattice.size)
                    b[i - 1 - j] += q * b[i]
        p = expected / expected[:-1].sum()
        p[-1] = RARE
    return expected


def _column(expected: np.ndarray) -> np.ndarray:
    p = np.append(expected / expected[:-1].sum(), 0.0)
    p[-2] = RARE
    return p


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a public sentencepiece model."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [m.id_to_piece(k) for k in range(m.get_piece_size())
            if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k) or m.is_unused(k))]


class Trained(NamedTuple):
    lattice: Lattice
    table: DataFrame  # lang, and the numbers and expected counts of the pieces that its texts have

    def blocks(self) -> Iterator[tuple[list[str], np.ndarray, bool]]:
        """Languages by name, their table of piece probabilities and whether they are the last, BLOCK at a time; one
        block without any if there are none."""
        left = self.table.orderBy("lang").limit(BLOCK).collect()
        while True:
            columns = np.zeros((self.lattice.size + 1, len(left)))
            for k, r in enumerate(left):
                expected = np.full(self.lattice.size, PRIOR)
                expected[np.frombuffer(r["pieces"], "<i4")] = np.frombuffer(r["expected"], "<f8")
                columns[:, k] = _column(expected)
            names = [r["lang"] for r in left]
            left = self.table.where(F.col("lang") > names[-1]).orderBy("lang").limit(BLOCK).collect() if len(
                names) == BLOCK else []
            yield names, columns, not left
            if not left:
                return


def train(docs: DataFrame, path: str, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Trained:
    """Learns from at most TRAIN_EACH texts of each language of ``docs``: one pass takes about twice as many by hash,
    the smallest hashes of these stay."""
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64(doc_col, text_col).alias("h"), F.col(text_col).alias("text"),
                       F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    share, share_path = stored(spark, rows.groupBy(F.col("lang").alias("l")).agg(
        F.least(F.lit(1.0), 2.0 * TRAIN_EACH / F.count("*")).alias("share")), "language-shares")
    few = share.count() <= BROADCAST_LANGS
    some = rows.join(F.broadcast(share) if few else share, F.col("lang") == F.col("l")).where(
        F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    lattice = Lattice(vocabulary(path))
    shared = spark.sparkContext.broadcast(lattice)  # the fixed vocabulary

    def learned(frame: pd.DataFrame) -> pd.DataFrame:
        counts = Counter(p for t in frame["text"] for w in words_of(t) for p in _pieces(w))
        out = []
        if counts:
            expected = learn(shared.value, counts)
            has = np.flatnonzero(expected != PRIOR)
            out.append((frame["lang"].iloc[0], has.astype("<i4").tobytes(), expected[has].astype("<f8").tobytes()))
        return pd.DataFrame(out, columns=["lang", "pieces", "expected"])

    texts = some.withColumn("k", first).where(F.col("k") <= TRAIN_EACH).select("lang", "text")
    table, _ = stored(spark, texts.groupBy("lang").applyInPandas(learned, "lang string, pieces binary, expected binary"),
                      "language-pieces")
    drop_path(spark, share_path)
    return Trained(lattice, table)


_MODELS: dict[int, tuple] = {}


def _scored(rows: DataFrame, lattice: Lattice, langs: list[str], table: np.ndarray, more: bool) -> DataFrame:
    """doc_id, best, log and sum of every text over these and the former languages; its text if there are ``more``."""
    shared = rows.sparkSession.sparkContext.broadcast((lattice, langs, table))  # vocabulary x BLOCK languages at most

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("lang_lattice", _MODELS.clear)
        key = id(shared.value)
        if key not in _MODELS:  # the value stays referenced, so that no other one can get its id
            _MODELS.clear()
            _MODELS[key] = (shared.value, Model(*shared.value))
        m = _MODELS[key][1]
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            names: list[str | None] = []
            logs, sums = np.zeros(len(texts)), np.ones(len(texts))
            for a, b in text_runs(texts, RUN_CHARS):
                n, logs[a:b], sums[a:b] = m.best(texts[a:b])
                names += n
            if "best" in frame:
                old, old_sums = frame["log"].to_numpy(), frame["sum"].to_numpy()
                top = np.maximum(old, logs)
                sums = old_sums * np.exp(old - top) + sums * np.exp(logs - top)
                names = [n if new else o for n, o, new in zip(names, frame["best"], logs > old)]  # equal: the first by name
                logs = top
            out = pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "best": names, "log": logs, "sum": sums})
            if more:
                out["text"] = frame["text"]
            yield out

    return rows.mapInPandas(score, "doc_id long, best string, log double, sum double" + ", text string" * more)


def predict_languages(docs: DataFrame, model: Trained, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every text."""
    spark = docs.sparkSession
    rows, path = id_and_text(docs, doc_col, text_col), None
    for langs, table, last in model.blocks():
        rows = _scored(rows, model.lattice, langs, table, not last)
        if not last:
            (rows, path), before = stored(spark, rows, "language-scores"), path
            if before:
                drop_path(spark, before)
    none = F.col("best").isNull()
    return rows.select("doc_id", F.when(none, "und").otherwise(F.col("best")).alias("lang_pred"),
                       F.when(none, 0.0).otherwise(1 / F.col("sum")).alias("score"))


def held_out_languages(docs: DataFrame, path: str, mod: int = 5) -> DataFrame:
    """Learns from documents whose id's crc32 modulo ``mod`` isn't 0 and predicts all."""
    model = train(docs.where(fold("doc_id", mod) != 0), path)
    return predict_languages(docs, model).select("doc_id", (fold("doc_id", mod) == 0).alias("held_out"), "lang_pred", "score")
