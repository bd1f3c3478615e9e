"""Operator 9: interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted arrays of hashes.

1. Training words are counted per task, dealt as sorted blobs by hash range, and merged into one file a range:
   ascending 64-bit word hashes and counts. A word's place in the concatenated files is its number.
2. Word pairs (a text starts with a context of its own and closes with the end token) are counted per task as packed
   numbers, dealt by the context's hash and merged into files of ascending keys and counts, with a file of context
   sums (tokens, and followers seen once, twice, more often). The numbers of different contexts of each word go on
   to files that run beside the word files.
3. Workers map these files of the shared folder (they aren't loaded) and look up what differs in a run of texts.

With c counts, N numbers of different neighbours and D the discounts from counts of counts:
p(w|h) = (c(hw) - D(c(hw))) / c(h) + g(h) p(w), p(w) = (N(.w) - D'(N(.w))) / N(..) + g' / (V + 1);
after a context that training never saw, p(w).

The shared folder must be mounted on all workers (``file:`` or a plain path), as mapping a file needs one. Files are
written under a temporary name and moved, so a task that runs again writes the same. A null or empty text has the end
token alone; repeated rows count as often as they stand; with no training row every probability is 1 / (V + 1) = 1;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import (drop_path, fold, id_and_bytes, input_partitions, local_form, mix64, scratch, stored,
                               text_runs)

RUN_BYTES = 6_000_000      # bytes of texts whose words are looked up together
FLUSH_PAIRS = 3_000_000    # different pairs that a counting task holds
START = np.uint64(0xFFFFFFFF)    # number of the context before the first token
UNKNOWN = np.uint64(0xFFFFFFFE)  # number of a token that training never saw
END_HASH = xxhash.xxh3_64_intdigest(b" ")  # no word has a space

_COUNT = np.dtype([("key", "<u8"), ("count", "<u8")])
_CONTEXT = np.dtype([("context", "<u8"), ("count", "<u8"), ("n1", "<u8"), ("n2", "<u8"), ("n3", "<u8")])


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, in order, the end after each text; and the number of tokens per text."""
    words = [t.lower().split() for t in texts]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    out = np.empty(int(sizes.sum()), np.uint64)
    ends = np.cumsum(sizes) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, int(inner.sum()))
    out[ends] = np.uint64(END_HASH)
    return out, sizes


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Arrays of (key, count) merged: ascending keys with the sums of their counts."""
    every = np.concatenate(parts) if parts else np.zeros(0, _COUNT)
    every = every[np.argsort(every["key"], kind="stable")]
    if not len(every):
        return every
    start = np.flatnonzero(np.concatenate([[True], every["key"][1:] != every["key"][:-1]]))
    out = every[start].copy()
    out["count"] = np.add.reduceat(every["count"], start)
    return out


def _counted(keys: np.ndarray) -> np.ndarray:
    key, n = np.unique(keys, return_counts=True)
    out = np.empty(len(key), _COUNT)
    out["key"], out["count"] = key, n
    return out


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def _unpack(b: bytes, kind: np.dtype = _COUNT) -> np.ndarray:
    n = len(b) // kind.itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def _dealt(a: np.ndarray, shard: np.ndarray, kind: str) -> pd.DataFrame:
    """One row a shard with its part of ``a``, in the order of ``a``."""
    order = np.argsort(shard, kind="stable")
    shard, a = shard[order], a[order]
    start = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(a) else np.zeros(0, int)
    parts = np.split(a, start[1:])
    return pd.DataFrame({"kind": kind, "shard": shard[start].astype("int64"),
                         "blob": [_pack(p) for p in parts][:len(start)]})


def _save(path: str, a: np.ndarray) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        np.save(f, a)
    os.replace(temporary, path)


def _word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _context_shard(context: np.ndarray, shards: int) -> np.ndarray:
    return mix64(context * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)] + [int((c >= 3).sum())]


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more from the counts of counts n1 to n4."""
    n1, n2, n3, n4 = n[:4]
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.0, 2 - 3 * y * n3 / n2 if n2 else 0.0, 3 - 4 * y * n4 / n3 if n3 else 0.0]
    return [min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1)]


class Model:
    """The mapped files of a model folder."""

    def __init__(self, folder: str, meta: dict):
        self.meta, self.shards, self.folder = meta, meta["shards"], folder
        self.words = self._mapped("words")
        self.offsets = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.uint64)
        self.pairs: list | None = None

    def _mapped(self, kind: str) -> list[np.ndarray]:
        """The shards of one kind; one that training wrote and that can't be read is an error, never an empty one."""
        written = set(self.meta["written"][kind])
        return [np.load(os.path.join(self.folder, f"{kind}-{k}.npy"), mmap_mode="r") if k in written else np.zeros(0, _CONTEXT)
                for k in range(self.shards)]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of ascending different word hashes (UNKNOWN and 0 where there is none)."""
        out, counts = np.full(len(hashes), UNKNOWN), np.zeros(len(hashes), np.uint64)
        cuts = np.searchsorted(_word_shard(hashes, self.shards), np.arange(self.shards + 1))
        for k in range(self.shards):
            own, words = hashes[cuts[k]:cuts[k + 1]], self.words[k]
            if len(own) and len(words):
                at, hit = _places(words["key"], own)
                out[cuts[k]:cuts[k + 1]] = np.where(hit, at.astype(np.uint64) + self.offsets[k], UNKNOWN)
                counts[cuts[k]:cuts[k + 1]] = np.where(hit, words["count"][at], 0)
        return out, counts

    def open_pairs(self) -> None:
        if self.pairs is None:
            self.pairs, self.contexts, self.before = (self._mapped(k) for k in ("pairs", "contexts", "before"))

    def lower(self, numbers: np.ndarray) -> np.ndarray:
        """p(w) of word numbers."""
        m, before = self.meta, np.zeros(len(numbers))
        shard = np.searchsorted(self.offsets, numbers, side="right") - 1
        for k in range(self.shards):
            own = np.flatnonzero((shard == k) & (numbers != UNKNOWN))
            if len(own) and len(self.before[k]):
                at, hit = _places(self.before[k]["key"], numbers[own])
                before[own] = np.where(hit, self.before[k]["count"][at], 0)
        d = np.array([0.0, *m["word_discounts"]])
        rest = m["word_rest"] / (m["distinct"] + 1)
        if not m["pair_types"]:
            return np.full(len(numbers), 1 / (m["distinct"] + 1))
        return (before - d[np.minimum(before, 3).astype(int)]) / m["pair_types"] + rest

    def probabilities(self, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """p(w|h) of packed pairs; ``lower`` has p(w) beside them."""
        out = lower.copy()
        d = np.array([0.0, *self.meta["pair_discounts"]])
        context = keys >> np.uint64(32)
        shard = _context_shard(context, self.shards)
        for k in range(self.shards):
            own = np.flatnonzero(shard == k)
            if not len(own) or not len(self.contexts[k]):
                continue
            at, known = _places(self.contexts[k]["context"], context[own])
            h = self.contexts[k][at]
            total = np.maximum(h["count"].astype(float), 1)
            back = (d[1] * h["n1"] + d[2] * h["n2"] + d[3] * h["n3"]) / total
            place, hit = _places(self.pairs[k]["key"], keys[own])
            c = np.where(hit, self.pairs[k]["count"][place], 0).astype(float)
            p = (c - d[np.minimum(c, 3).astype(int)]) / total + back * lower[own]
            out[own] = np.where(known, p, lower[own])
        return out


def _places(ascending: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(ascending, wanted), len(ascending) - 1)
    return at, np.asarray(ascending[at]) == wanted


_MODELS: dict[str, Model] = {}


def _model(folder: str, meta: dict) -> Model:
    key = f"{folder} {meta.get('ready')}"
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(folder, meta)
    return _MODELS[key]


def _pair_keys(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return before << np.uint64(32) | numbers


def _runs(frame: pd.DataFrame):
    texts = frame["text"].tolist()
    for start, stop in text_runs(texts, RUN_BYTES):
        yield start, stop, *token_hashes(texts[start:stop])


_BLOBS = "kind string, shard long, blob binary"


def train(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> tuple[str, dict]:
    """Counts the model over all rows of ``docs``; its folder and the sums that scoring needs."""
    spark = docs.sparkSession
    rows = id_and_bytes(docs, doc_col, text_col).select("text")
    shards = input_partitions(rows)
    path = scratch(spark, "kneser-ney")
    folder = local_form(path)
    if "://" in folder:
        raise ValueError(f"{path}: the shared folder must be mounted on the workers, so that they can map files")
    os.makedirs(folder, exist_ok=True)

    def count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for frame in frames:
            for _, _, hashes, _ in _runs(frame):
                held.append(_counted(hashes))
                if sum(map(len, held)) > FLUSH_PAIRS:
                    held = [_summed(held)]
                    if len(held[0]) > FLUSH_PAIRS // 2:
                        yield _dealt(held[0], _word_shard(held[0]["key"], shards), "word")
                        held = []
        total = _summed(held)
        yield _dealt(total, _word_shard(total["key"], shards), "word")

    def merge_words(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        words = _summed([_unpack(b) for b in frame["blob"]])
        _save(os.path.join(folder, f"words-{shard}.npy"), words)
        return pd.DataFrame({"shard": [shard], "distinct": [len(words)], "tokens": [int(words["count"].sum())]})

    sums = rows.mapInPandas(count_words, _BLOBS).groupBy("shard").applyInPandas(
        merge_words, "shard long, distinct long, tokens long").agg(
        F.sum("distinct").alias("d"), F.sum("tokens").alias("t"), F.collect_list("shard").alias("written")).first()
    meta = {"shards": shards, "distinct": sums["d"] or 0, "tokens": sums["t"] or 0, "ready": 0, "written": {"words": sums["written"]}}
    if meta["distinct"] >= int(UNKNOWN):
        raise ValueError("over four billion different words")

    def count_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, held = _model(folder, meta), []
        for frame in frames:
            for _, _, hashes, sizes in _runs(frame):
                different, place = np.unique(hashes, return_inverse=True)
                numbers = model.numbers(different)[0][place]
                held.append(_counted(_pair_keys(numbers, sizes)))
                if sum(map(len, held)) > FLUSH_PAIRS:
                    held = [_summed(held)]
                    if len(held[0]) > FLUSH_PAIRS // 2:
                        yield _dealt(held[0], _context_shard(held[0]["key"] >> np.uint64(32), shards), "pair")
                        held = []
        total = _summed(held)
        yield _dealt(total, _context_shard(total["key"] >> np.uint64(32), shards), "pair")

    def merge_pairs(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        pairs = _summed([_unpack(b) for b in frame["blob"]])
        _save(os.path.join(folder, f"pairs-{shard}.npy"), pairs)
        context = pairs["key"] >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        out = np.empty(len(start), _CONTEXT)
        out["context"], out["count"] = context[start], np.add.reduceat(pairs["count"], start)
        for name, hit in (("n1", pairs["count"] == 1), ("n2", pairs["count"] == 2), ("n3", pairs["count"] >= 3)):
            out[name] = np.add.reduceat(hit.astype(np.uint64), start)
        _save(os.path.join(folder, f"contexts-{shard}.npy"), out)
        words = _counted(pairs["key"] & np.uint64(0xFFFFFFFF))
        offsets = _model(folder, meta).offsets
        rows_out = _dealt(words, (np.searchsorted(offsets, words["key"], side="right") - 1).astype(np.uint64), "before")
        stats = json.dumps(_counts_of_counts(pairs["count"]) + [len(pairs)]).encode()
        return pd.concat([rows_out, pd.DataFrame({"kind": ["stats"], "shard": [shard], "blob": [stats]})])

    merged, merged_path = stored(spark, rows.mapInPandas(count_pairs, _BLOBS).groupBy("shard").applyInPandas(
        merge_pairs, _BLOBS), "contexts-of-words", by=["kind"])

    def merge_before(frame: pd.DataFrame) -> pd.DataFrame:
        words = _summed([_unpack(b) for b in frame["blob"]])
        shard = int(frame["shard"].iloc[0])
        _save(os.path.join(folder, f"before-{shard}.npy"), words)
        return pd.DataFrame([[*_counts_of_counts(words["count"]), shard]], columns=["n1", "n2", "n3", "n4", "more", "shard"])

    names = ["n1", "n2", "n3", "n4", "more"]
    lower = merged.where("kind = 'before'").groupBy("shard").applyInPandas(
        merge_before, ", ".join(f"{n} long" for n in [*names, "shard"])).agg(
        *(F.sum(n).alias(n) for n in names), F.collect_list("shard").alias("written")).first()
    stats = F.from_json(F.col("blob").cast("string"), "array<long>")
    upper = merged.where("kind = 'stats'").select(stats.alias("s"), "shard").agg(
        *(F.sum(F.col("s")[k]).alias(n) for k, n in enumerate([*names, "types"])), F.collect_list("shard").alias("written")).first()
    drop_path(spark, merged_path)
    of_words, of_pairs = [int(lower[n] or 0) for n in names], [int(upper[n] or 0) for n in names]
    d = discounts(of_words)
    types = int(upper["types"] or 0)
    rest = (d[0] * of_words[0] + d[1] * of_words[1] + d[2] * of_words[4]) / types if types else 1.0
    return path, meta | {"ready": 1, "pair_types": types, "pair_discounts": discounts(of_pairs), "word_discounts": d,
                         "word_rest": rest, "written": meta["written"] | {
                             "pairs": upper["written"], "contexts": upper["written"], "before": lower["written"]}}


def score(docs: DataFrame, path: str, meta: dict, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of every row."""
    folder = local_form(path)

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(folder, meta)
        model.open_pairs()
        for frame in frames:
            out = []
            for start, stop, hashes, sizes in _runs(frame):
                different, place = np.unique(hashes, return_inverse=True)
                numbers, counts = model.numbers(different)
                base = np.log10((counts + 1.0) / (meta["tokens"] + 1.0 * (meta["distinct"] + 1)))
                lower, known = model.lower(numbers), counts > 0
                keys, at = np.unique(_pair_keys(numbers[place], sizes), return_inverse=True)
                word = np.empty(len(keys), np.int64)
                word[at] = place
                # tokens that training never saw share a number and one probability
                p = np.log10(model.probabilities(keys, lower[word]))
                first = np.cumsum(sizes) - sizes
                total = np.add.reduceat(p[at], first)
                out.append(pd.DataFrame({
                    "doc_id": frame["doc_id"].iloc[start:stop].astype("Int64").to_numpy(), "n_tokens": sizes,
                    "n_known": np.add.reduceat(known[place].astype(np.int64), first),
                    "base_score": np.add.reduceat(base[place], first), "score": total,
                    "perplexity": 10.0 ** np.minimum(-total / sizes, 300)}))
            yield from out

    return id_and_bytes(docs, doc_col, text_col).mapInPandas(
        rate, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def held_out_scores(docs: DataFrame, mod: int = 7, held: int = 2) -> DataFrame:
    """Trains on the documents whose id's crc32 modulo ``mod`` isn't ``held`` and scores all of them."""
    path, meta = train(docs.where(fold("doc_id", mod) != held))
    return score(docs, path, meta).select(
        "doc_id", (fold("doc_id", mod) == held).alias("held_out"), "n_tokens", "n_known",
        F.lit(meta["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
