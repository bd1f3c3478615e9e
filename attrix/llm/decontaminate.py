"""Operator 10: benchmark passages in documents, by q-gram counts in diagonal bands and banded alignment.

An occurrence of an item of m bytes with at most e edits keeps m - q + 1 - q * e of its q-grams, on diagonals (place in the
text less place in the item) that lie within e of each other. Shared q-grams are counted in overlapping bands of
2 * (e + 1) diagonals, so one band has them all; bands that reach the bound are regions, and an alignment within the region's
diagonals decides. Nothing within the edit budget is missed.

Texts and items are compared with A-Z in lower case and white space collapsed to one space; places refer to that form, in
bytes. e is a tenth of the item's bytes (less for short items, so that the bound stays above 0; none below q bytes).
Null and empty texts and items match nothing; equal items are all reported; repeated rows give repeated results; empty
tables give no rows; other columns are ignored. Items are indexed in groups of about ``GROUP_BYTES``, one pass each, so
what is broadcast stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import hold, id_and_bytes, text_runs

Q = 8                    # bytes of a gram
SHARE = 10               # an item of m bytes may have m // SHARE edits
GROUP_BYTES = 16_000_000  # of items in one index
RUN_BYTES = 1 << 19      # of texts scanned together
FILTER_BITS = 22

_M = [np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) for k in range(9)]


def _nothing() -> None:
    """This operator keeps nothing of its own in a worker."""


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all Q-byte grams of an array of bytes (uint64), by doubling."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    a = data.astype(np.uint64)
    two = a[:-1] * _M[1] + a[1:]
    four = two[:-2] * _M[2] + two[2:]
    eight = four[:-4] * _M[4] + four[4:]
    return eight * _M[3]


class Index:
    """Grams of items with their places, by ascending hash."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, t in items if t]
        self.texts = [np.frombuffer(t, np.uint8) for _, t in items if t]
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.sizes = sizes
        self.edits = np.maximum(np.minimum(sizes // SHARE, (sizes - Q) // Q), 0)
        self.bound = np.maximum(sizes - Q + 1 - Q * self.edits, 1)
        self.short = [k for k in range(len(sizes)) if sizes[k] < Q]
        self.widest = int(self.edits.max(initial=0)) + 1
        grams = [gram_hashes(t) for t in self.texts]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.hashes, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat)).astype(np.int64)
        self.item, self.place = item[order], place[order].astype(np.int64)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of every region of the texts that holds an item within its edits."""
        forms = [normal(t) for t in texts]
        out = []
        for k in self.short:
            for t, form in enumerate(forms):
                at = form.find(self.texts[k].tobytes())
                if at >= 0:
                    out.append((t, k, at, at + int(self.sizes[k]), 0))
        pad = b"\n" * (Q + 2 * self.widest)  # no normal form has it
        data = np.frombuffer(pad.join([b"", *forms, b""]), np.uint8)
        begin = np.cumsum([len(pad), *(len(f) + len(pad) for f in forms)])
        h = gram_hashes(data)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - FILTER_BITS)])
        if not len(at) or not len(self.hashes):
            return out
        slot = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[slot] == h[at]
        at, slot = at[hit], slot[hit]
        count = self.first[slot + 1] - self.first[slot]
        total = int(count.sum())
        if not total:
            return out
        which = np.repeat(self.first[slot] - np.cumsum(count) + count, count) + np.arange(total)
        item, shift = self.item[which], np.repeat(at, count) - self.place[which] + len(data)
        width = self.edits[item] + 1
        band = shift // width
        span = 2 * len(data) + 2
        key = item * span + band
        key.sort()
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts, key = np.diff(np.append(start, len(key))), key[start]
        counts[:-1] += np.where(key[1:] == key[:-1] + 1, counts[1:], 0)  # a band and the next one overlap by half
        seen: dict[tuple[int, int], int] = {}
        for band_key in key[counts >= self.bound[key // span]].tolist():
            k, b = divmod(band_key, span)
            e, size = int(self.edits[k]), int(self.sizes[k])
            low = b * (e + 1) - len(data) - e
            text = int(np.searchsorted(begin, low + e + size // 2, side="right")) - 1
            if not 0 <= text < len(forms) or (text, k) in seen and seen[text, k] >= low:  # low may be negative
                continue
            edits, end = align(self.texts[k], data, low, 2 * (e + 1) + 2 * e, e)
            if edits <= e:
                end -= int(begin[text])
                out.append((text, k, max(0, end - size), min(end, len(forms[text])), edits))
                seen[text, k] = low + 2 * (e + 1) + 2 * e
        return out


def align(item: np.ndarray, data: np.ndarray, low: int, diagonals: int, most: int | None = None) -> tuple[int, int]:
    """Least edits between the item and any stretch of the data on the diagonals from ``low`` on; that stretch's end.

    The least cost never falls from byte to byte: once it is above ``most`` edits, what is found so far is given back.
    """
    size = len(item)
    region = np.zeros(size + diagonals, np.uint8)
    a, b = max(0, low), min(len(data), low + size + diagonals)
    region[a - low:b - low] = data[a:b]
    step = np.arange(diagonals)
    cost = np.zeros(diagonals, np.int64)
    for i in range(size):
        new = cost + (region[i:i + diagonals] != item[i])
        np.minimum(new[:-1], cost[1:] + 1, out=new[:-1])  # a byte of the item is missing
        cost = np.minimum.accumulate(new - step) + step    # bytes are put in
        if most is not None and i & 7 == 7 and cost.min() > most:
            break
    best = int(cost.argmin())
    return int(cost[best]), low + size + best


def _indexes(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes over groups of items of about GROUP_BYTES."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where(
        "text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = -(-size // GROUP_BYTES)
    for g in range(groups):
        some = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == g).collect()
        yield Index(sorted(((r["id"], normal(bytes(r["text"]))) for r in some), key=lambda x: (x[0] is None, x)))


def leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start, end and edits of each benchmark passage found in a document."""
    schema = "doc_id long, item_id long, start long, end long, edits long"
    out = None
    texts = id_and_bytes(docs, doc_col, text_col)
    for index in _indexes(items, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # about GROUP_BYTES of items

        def rows(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            hold("decontaminate", _nothing)
            index = shared.value
            for frame in frames:
                got = frame["text"].tolist()
                ids = frame["doc_id"].astype("Int64").tolist()
                found = [(ids[a + t], index.ids[k], s, e, d) for a, b in text_runs(got, RUN_BYTES)
                         for t, k, s, e, d in index.find(got[a:b])]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "start", "end", "edits"]).astype(
                    {"doc_id": "Int64", "item_id": "Int64"})

        part = texts.mapInPandas(rows, schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def leaked_columns(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text") -> list:
    """A boolean column for each group of items: whether the text holds one of them."""
    def column(shared):
        @F.pandas_udf("boolean")
        def leaked(texts: pd.Series) -> pd.Series:
            hold("decontaminate", _nothing)
            got = texts.tolist()
            flags = np.zeros(len(got), bool)
            for a, b in text_runs(got, RUN_BYTES):
                for t, *_ in shared.value.find(got[a:b]):
                    flags[a + t] = True
            return pd.Series(flags)

        return leaked(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))

    return [column(docs.sparkSession.sparkContext.broadcast(index))
            for index in _indexes(items, item_col, item_text_col)]
