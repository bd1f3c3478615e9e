"""Operator 12: line dedup by range-partitioned hashes, with a keep bitmap a document.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case. A key of ``min_chars`` code points
or more that stands in ``min_docs`` documents or more loses all its lines but those of the largest document id that has it.

Lines become (128-bit hash of the key, document, position) and are range-partitioned in this order with the documents
descending, so that a key that very many documents share is cut by document and no task holds it whole. Each task streams
its range in order: the first document of a key keeps its lines, the others lose theirs once ``min_docs`` documents were
seen. Only a range's first and last key can have rows elsewhere; for these a task gives its largest ``min_docs`` ids, which are
put together (two keys a task) and decide the rows that were left open. A task holds one batch and the rows of at most
``min_docs`` - 1 documents of one key.

The result is a bitmap for each document that loses lines: bit i is set if line i stays, up to the byte of the last
dropped line, zlib over little-endian bits. ``without_repeated_lines`` applies the bitmaps; only texts that lose lines reach a Python worker.

Null and empty texts are one empty line. Rows without an id are no documents: they count for no key and lose all lines of
a repeated key. Rows of one id are one document, each with its own bitmap; equal rows get equal results. Several lines of
one key in its largest document all stay. Very long texts and lines are taken whole. An empty table gives no rows; other
columns are carried by ``without_repeated_lines`` and ignored elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import fresh, stored

MIN_CHARS = 20
MIN_DOCS = 3
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What a task says of its range: a line to drop, a line left open, an id of a range's first or last key.
DROP, OPEN, EDGE = 0, 1, 2
MARKS = "kind int, h1 long, h2 long, doc_id long, row long, pos int"
_MARKS = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()),
                    ("pos", pa.int32())])


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def line_keys(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2 (hash of the key), doc_id, row (hash of the text) and pos of every line whose key is long enough."""
    text = _text(text_col)
    lines = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"),
                        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    trimmed = lines.select("doc_id", "row", "pos", F.btrim("line", F.lit(BLANK)).alias("line"))
    key = F.translate("line", UPPER, LOWER)
    return trimmed.where(F.length("line") >= min_chars).select(
        F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"), "doc_id", "row", "pos")


class _Rows:
    """Columns of consecutive lines; ``known`` is false where the document has no id."""

    FIELDS = ("h1", "h2", "doc", "known", "row", "pos")

    def __init__(self, *columns: np.ndarray):
        self.h1, self.h2, self.doc, self.known, self.row, self.pos = columns

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        doc = batch.column("doc_id")
        return cls(batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), doc.fill_null(0).to_numpy(zero_copy_only=False),
                   doc.is_valid().to_numpy(zero_copy_only=False), batch.column("row").to_numpy(), batch.column("pos").to_numpy())

    def columns(self) -> list[np.ndarray]:
        return [getattr(self, f) for f in self.FIELDS]

    def __len__(self) -> int:
        return len(self.h1)

    def take(self, which) -> _Rows:
        return _Rows(*[c[which] for c in self.columns()])

    def then(self, other: _Rows) -> _Rows:
        return _Rows(*[np.concatenate(c) for c in zip(self.columns(), other.columns())])

    def key(self, at: int) -> tuple[int, int]:
        return int(self.h1[at]), int(self.h2[at])

    def ids(self, most: int) -> list[int]:
        """The first ``most`` different ids; the rows are of one key."""
        known = self.doc[self.known]
        return known[np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]]))[:most]].tolist() if len(known) else []


def _marks(kind: int, rows: _Rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(rows), kind, np.int32)), pa.array(rows.h1), pa.array(rows.h2), pa.array(rows.doc, mask=~rows.known),
         pa.array(rows.row), pa.array(rows.pos)], schema=_MARKS)


def _edge(key: tuple[int, int], ids: list[int]) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_pydict({"kind": [EDGE] * n, "h1": [key[0]] * n, "h2": [key[1]] * n, "doc_id": ids, "row": [0] * n,
                                       "pos": [0] * n}, schema=_MARKS)


def stream_range(batches: Iterator[pa.RecordBatch], min_docs: int = MIN_DOCS) -> Iterator[pa.RecordBatch]:
    """Marks of one range of lines, which come ordered by key and descending document (rows without id last)."""
    key = None  # the key whose rows may go on in the next batch
    ids: list[int] = []  # its largest ids
    first = False  # it is the range's first key: all its rows stay open
    held: _Rows | None = None  # its rows, while it isn't the first and has fewer than ``min_docs`` documents
    for batch in batches:
        rows = _Rows.of(batch)
        if not len(rows):
            continue
        if key is None:
            key, first = rows.key(0), True
        if held is not None:
            rows, held, key = held.then(rows), None, None
        new = np.concatenate([[True], (rows.h1[1:] != rows.h1[:-1]) | (rows.h2[1:] != rows.h2[:-1])])
        starts = np.flatnonzero(new)
        at = 0
        if key is not None and rows.key(0) == key:
            at = int(starts[1]) if len(starts) > 1 else len(rows)
            run = rows.take(slice(0, at))
            if first:
                yield _marks(OPEN, run)
                seen = run.ids(min_docs + 1)
                ids = (ids + [i for i in seen if i not in ids])[:min_docs]
            else:
                yield _marks(DROP, run.take(~run.known | (run.doc != ids[0])))
            if at == len(rows):
                continue
        if first:
            yield _edge(key, ids)
            first = False
        starts = starts[starts >= at]
        last = int(starts[-1])
        if len(starts) > 1:  # the runs before the last are whole
            run = rows.take(slice(at, last))
            begin = starts[:-1] - at
            other = np.concatenate([[True], run.doc[1:] != run.doc[:-1]]) | new[at:last]
            n = np.add.reduceat((other & run.known).astype(np.int64), begin)
            sizes = np.diff(np.append(begin, len(run)))
            keeps = run.known & (run.doc == np.repeat(run.doc[begin], sizes))
            yield _marks(DROP, run.take(np.repeat(n >= min_docs, sizes) & ~keeps))
        run = rows.take(slice(last, len(rows)))
        key, ids = run.key(0), run.ids(min_docs)
        if len(ids) >= min_docs:
            yield _marks(DROP, run.take(~run.known | (run.doc != ids[0])))
        else:
            held = run
    if held is not None:
        yield _marks(OPEN, held)
    if key is not None:
        yield _edge(key, ids)


def dropped_lines(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                  min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, row and pos of the lines that go; equal rows give theirs once each."""
    keys = line_keys(docs, doc_col, text_col, min_chars)
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last(), F.col("row"), F.col("pos")]
    ranges = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    marks, _ = stored(docs.sparkSession, ranges.mapInArrow(lambda it: stream_range(it, min_docs), MARKS), "line-marks", ["kind"])
    # at most two keys a task, and min_docs ids of each
    last = marks.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(
        F.max("doc_id").alias("keeper"), F.count_distinct("doc_id").alias("n")).where(F.col("n") >= min_docs)
    left = marks.where(F.col("kind") == OPEN).join(F.broadcast(last), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return marks.where(F.col("kind") == DROP).select("doc_id", "row", "pos").union(left.select("doc_id", "row", "pos"))


def bitmap(dropped: np.ndarray) -> bytes:
    """The keep bitmap of the places of dropped lines."""
    keep = np.ones((int(dropped.max()) // 8 + 1) * 8, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def keep_bitmaps(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, row (hash of the text), n_dropped and keep (the bitmap) of the documents that lose lines."""
    of = dropped_lines(docs, doc_col, text_col, min_chars, min_docs).groupBy("doc_id", "row").agg(
        F.collect_set("pos").alias("dropped"))
    packed = F.pandas_udf(lambda dropped: dropped.map(bitmap), "binary")
    return of.select("doc_id", "row", F.size("dropped").cast("long").alias("n_dropped"), packed("dropped").alias("keep"))


def kept_lines(text: str, keep: bytes) -> str:
    """The lines of ``text`` that a bitmap keeps."""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    bits = np.concatenate([bits[:len(lines)], np.ones(max(0, len(lines) - len(bits)), np.uint8)])
    return "\n".join(line for line, b in zip(lines, bits.tolist()) if b)


def _kept(texts: pd.Series, keeps: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else kept_lines(t, k) for t, k in zip(texts, keeps)], dtype=object)


def without_repeated_lines(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                           min_docs: int = MIN_DOCS, lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
    """``docs`` with the kept lines as text (a null text as an empty one), the number of lines before, and of dropped ones."""
    own = fresh(docs)
    maps = keep_bitmaps(docs, doc_col, text_col, min_chars, min_docs)
    maps = maps.select(*[F.col(c).alias(own + c) for c in maps.columns])
    text, keep, kept = _text(text_col), F.col(own + "keep"), F.pandas_udf(lambda t, k: _kept(t, k), "string")
    same = F.col(doc_col).cast("long").eqNullSafe(F.col(own + "doc_id")) & (F.xxhash64(text) == F.col(own + "row"))
    return docs.join(maps, same, "left").withColumns({
        lines_col: F.size(F.split(text, "\n", -1)).cast("long"), dropped_col: F.coalesce(own + "n_dropped", F.lit(0).cast("long")),
        text_col: F.coalesce(kept(F.when(keep.isNotNull(), text), keep), text),
    }).drop(*maps.columns)
