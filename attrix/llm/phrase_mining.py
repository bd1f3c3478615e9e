"""Operator 13: phrase collocations by Toivonen's mining, counted per language.

A sample of the rows (one in ``SAMPLE`` by hash of id and text) proposes words and pairs that reach the lowered count there.
A full pass counts the proposals and their negative border, that is every phrase all of whose parts were proposed, exactly: all
words, pairs of proposed words, triples of proposed pairs. A border phrase that turns out frequent is a failure: it joins
the proposals, and a further full pass counts the phrases that only now have all parts proposed. Passes end when no border
phrase fails; then every frequent phrase was counted, since its parts are frequent too, and was counted in one pass only.

Proposals are kept as two bit tables of fixed size (``WORD_BITS``, ``PAIR_BITS``), the only thing that is broadcast or reaches
the driver. Phrases that share a bit are counted although nobody proposed them, which costs work but changes no result.
Tasks number the words they meet, count the runs of numbers in arrays of bounded size, and deal the counts over shards by
hash, as compressed blocks of bounded size; a shard's counts are added up in one group, a range of first words after the
other. Shards grow in number with the input, a hot phrase is one entry a task, so no group is hot. A word stands for itself
in the shuffle by a 64-bit hash of language and word; the words' own table shows whether two words share the hash of a
frequent one, and then all is counted again with another salt.

A candidate's cuts, the scores and the drop of phrases inside longer ones are joins of the frequent phrases. Products
are decimals of 38 digits, exact for counts below 10 ** 16, more than there are words in 10 PB of text. Ties are ordered by
the phrase's bytes, so ranks are unique.

Null and empty texts have no words; a null language is ``und``; repeated rows count each time; very long texts are read in
slices that overlap by two words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrix.llm.common import give_back, input_partitions, mix64, stored

MIN_COUNT = 10
TOP = 2000
#: One row in this many is sampled; a phrase is proposed if the sample has this share of the least count, lowered.
SAMPLE = 8
LOWERED = 0.8
#: Size of the tables of proposed words and pairs, as powers of two.
WORD_BITS, PAIR_BITS = 24, 27

#: A task's bounds: bytes of a slice of text, words of a run, different words and phrases held.
SLICE, RUN_WORDS, VOCABULARY, HELD = 1 << 20, 200_000, 1 << 18, 1_000_000
#: Texts taken from an Arrow batch at once; phrases of a block; bytes of blocks handed over at once, so that no row or Arrow batch
#: holds a whole task's counts; phrases of a shard added up at once.
TAKEN, BLOCK, HANDED, MERGED = 256, 1 << 14, 1 << 20, 1 << 17
#: Bits of a word's number in a packed phrase: more than VOCABULARY and the words of a run and a slice together.
WIDTH = 21
BREAK = b"\xff"  # in no UTF-8 text; parts pieces, is number 0
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(0xFF if c in _BREAKS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = re.compile(rb"[ \t\xff]")
_MASK = (1 << WIDTH) - 1


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(mix64(a) * np.uint64(0x9E3779B97F4A7C15) + b)


class Proposals:
    """The proposed words and pairs: bit tables indexed by the leading bits of a hash."""

    def __init__(self, word_bits: int, pair_bits: int):
        self.size = {1: word_bits, 2: pair_bits}
        self.bits = {level: np.zeros(1 << max(0, n - 3), np.uint8) for level, n in self.size.items()}

    def has(self, level: int, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - self.size[level])
        return ((self.bits[level][slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    def segment(self, level: int, shard: int, shards: int, hashes: np.ndarray) -> bytes:
        """The bits of ``hashes``, all of one shard, as the packed part of the table that is the shard's."""
        width = self.size[level] - shards
        slot = (hashes >> np.uint64(64 - self.size[level])) - np.uint64(shard << width)
        own = np.zeros(1 << width, np.uint8)
        own[slot] = 1
        return zlib.compress(np.packbits(own, bitorder="little").tobytes(), 1)

    def joined(self, segments: list, shards: int) -> Proposals:
        """These proposals and those of (level, shard, segment) rows."""
        out = Proposals(self.size[1], self.size[2])
        out.bits = {level: b.copy() for level, b in self.bits.items()}
        for level, shard, packed in segments:
            part = np.frombuffer(zlib.decompress(packed), np.uint8)
            at = shard * len(part)
            out.bits[level][at:at + len(part)] |= part
        return out


class _Numbers(dict):
    """Numbers of a language's words in this task."""

    def __init__(self, lang: bytes, task: TaskCounts):
        super().__init__({BREAK: 0})
        self.prefix, self.task = b"%d:%d:" % (task.salt, len(lang)) + lang, task

    def __missing__(self, word: bytes) -> int:
        t = self.task
        number = self[word] = len(t.hashes)
        t.hashes.append(int.from_bytes(hashlib.blake2b(self.prefix + word, digest_size=8).digest(), "little"))
        t.words.append(word)
        return number


_BLOCKS = "level int, shard long, lang string, phrases long, size long, packed binary"
_COLUMNS = ["level", "shard", "lang", "h1", "h2", "h3", "n", "words"]


class TaskCounts:
    """What one task has counted; ``old`` and ``new`` are the proposals of the pass before and of this one (None: all)."""

    def __init__(self, salt: int, shards: int, old: Proposals | None, new: Proposals | None, with_words: bool, most: int):
        self.salt, self.shards, self.old, self.new, self.with_words, self.most = salt, shards, old, new, with_words, most
        self._restart()

    def _restart(self) -> None:
        self.hashes, self.words, self.langs = array("Q", [0]), [BREAK], {}
        self.counts = np.zeros(1, np.int64)
        self.held: dict[int, list] = {2: [], 3: []}
        self.pending: list[np.ndarray] = []
        self.own: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> Iterator[pd.DataFrame]:
        at, tail, data = 0, [BREAK, BREAK], text.translate(_TABLE)
        while at < len(data):
            gap = _GAP.search(data, at + SLICE)
            end = gap.start() if gap else len(data)
            tokens = data[at:end].replace(BREAK, b" \xff ").split()
            at = end
            if lang not in self.langs:
                self.langs[lang] = _Numbers(lang.encode(), self)
            both = tail + tokens
            self.pending.append(np.fromiter(map(self.langs[lang].__getitem__, both), np.int64, len(both)))
            self.own.append(np.arange(len(both)) >= 2)
            tail = both[-2:]
            self.size += len(both)
            if self.size >= RUN_WORDS:
                yield from self.count()

    def count(self) -> Iterator[pd.DataFrame]:
        """Counts the pending words."""
        if self.pending:
            ids, own = np.concatenate(self.pending), np.concatenate(self.own)
            self.pending, self.own, self.size = [], [], 0
            self._count(ids, own)
        full = len(self.hashes) > VOCABULARY
        if not full and sum(len(k) for level in (2, 3) for k, _ in self.held[level]) > HELD:
            for level in (2, 3):
                self.held[level] = [self._summed(level)]
            full = sum(len(self.held[level][0][0]) for level in (2, 3)) > HELD // 2
        if full:
            yield from self.flush()

    def _count(self, ids: np.ndarray, own: np.ndarray) -> None:
        h = np.array(self.hashes, np.uint64)
        if self.with_words:
            self.counts = np.pad(self.counts, (0, len(h) - len(self.counts))) + np.bincount(ids[own], minlength=len(h))
        left, right = ids[:-1], ids[1:]
        pair = (left > 0) & (right > 0)
        before = np.zeros(len(pair), bool)  # counted in an earlier pass
        if self.new is not None:
            known = self.new.has(1, h)
            pair &= known[left] & known[right]
        if self.old is not None:
            known = self.old.has(1, h)
            before = pair & known[left] & known[right]
        which = np.flatnonzero(pair & own[1:] & ~before)
        self._hold(2, left[which] << WIDTH | right[which])
        if self.most < 3:
            return
        which = np.flatnonzero(pair)
        hashes = pair_hash(h[left[which]], h[right[which]])
        proposed = np.zeros(len(pair), bool)
        proposed[which] = self.new.has(2, hashes)
        triple = proposed[:-1] & proposed[1:] & own[2:]
        if self.old is not None:
            earlier = np.zeros(len(pair), bool)
            earlier[which] = before[which] & self.old.has(2, hashes)
            triple &= ~(earlier[:-1] & earlier[1:])
        at = np.flatnonzero(triple)
        self._hold(3, ids[at] << 2 * WIDTH | ids[at + 1] << WIDTH | ids[at + 2])

    def _hold(self, level: int, keys: np.ndarray) -> None:
        if len(keys):
            self.held[level].append(np.unique(keys, return_counts=True))

    def _summed(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if not any(len(k) for k, _ in self.held[level]):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, n = (np.concatenate(x) for x in zip(*self.held[level]))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n, first)

    def flush(self) -> Iterator[pd.DataFrame]:
        """The counts as blocks of one shard each; the task begins anew."""
        rows, size = [], 0
        for row in self._blocks():
            rows.append(row)
            size += sum(len(x) for x in row[3:])
            if size >= HANDED:
                yield pd.DataFrame(rows, columns=_COLUMNS)
                rows, size = [], 0
        self._restart()
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)

    def _blocks(self) -> Iterator[tuple]:
        h = np.array(self.hashes, np.uint64)
        down, small = np.uint64(64 - self.shards), np.uint16 if self.shards <= 16 else np.uint64
        for level in (2, 3):
            keys, n = self._summed(level)
            self.held[level] = []
            shard = np.empty(len(keys), small)
            for k in range(0, len(keys), MERGED):
                parts = _parts(level, h, keys[k:k + MERGED])
                hashed = pair_hash(parts[0], parts[1])
                shard[k:k + MERGED] = (pair_hash(hashed, parts[2]) if level == 3 else hashed) >> down
            for which, own in _by_shard(shard):
                parts = _parts(level, h, keys[own])
                order = np.lexsort(parts[1::-1])  # equal first words side by side compress well, and are found by range
                for k in range(0, len(own), BLOCK):
                    piece = order[k:k + BLOCK]
                    packed = [p[piece].tobytes() for p in parts] + [b""] * (3 - level)
                    yield level, which, None, *packed, n[own[piece]].astype(np.uint32).tobytes(), b""
        if not self.with_words:
            return
        own = np.concatenate([np.zeros(0, np.int64), *[np.fromiter(k.values(), np.int64, len(k)) for k in self.langs.values()]])
        of = np.repeat(np.arange(len(self.langs)), [len(k) for k in self.langs.values()])
        counts, names = np.pad(self.counts, (0, len(h) - len(self.counts))), list(self.langs)
        met = (own > 0) & (counts[own] > 0)
        own, of = own[met], of[met]  # words stand by language
        for which, at in _by_shard((h[own] >> down).astype(small)):
            for k in range(0, len(at), BLOCK):
                piece = at[k:k + BLOCK]
                lang, many = np.unique(of[piece], return_counts=True)
                listed = json.dumps([[names[g], int(c)] for g, c in zip(lang, many)])
                words = own[piece]
                yield (1, which, listed, h[words].tobytes(), b"", b"", counts[words].astype(np.uint32).tobytes(),
                       b"\n".join([self.words[w] for w in words.tolist()]))


def _parts(level: int, h: np.ndarray, keys: np.ndarray) -> list:
    """The hashes of the words of packed phrases."""
    return [h[(keys >> (k * WIDTH)) & _MASK] for k in range(level - 1, -1, -1)]


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each shard, in order."""
    if len(shard):
        order = np.argsort(shard, kind="stable")
        dealt = shard[order]
        bounds = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1], [True]]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield int(dealt[a]), order[a:b]


def _packed(frame: pd.DataFrame) -> pa.RecordBatch:
    """Blocks as rows of the shuffle: all of a block's parts compressed together."""
    whole = [b"".join(b) for b in zip(*(frame[c] for c in _COLUMNS[3:]))]
    return pa.RecordBatch.from_arrays(
        [pa.array(frame["level"], pa.int32()), pa.array(frame["shard"], pa.int64()), pa.array(frame["lang"], pa.string(), from_pandas=True),
         pa.array([len(n) // 4 for n in frame["n"]], pa.int64()), pa.array([len(w) for w in whole], pa.int64()),
         pa.array([pa.compress(w, codec="zstd", asbytes=True) for w in whole], pa.binary())],
        ["level", "shard", "lang", "phrases", "size", "packed"])


def _unpacked(frame: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one shard of one level."""
    level, rows = int(frame["level"].iloc[0]), []
    for lang, phrases, size, packed in zip(frame["lang"], frame["phrases"], frame["size"], frame["packed"]):
        whole = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True)
        view, at = memoryview(whole), 8 * phrases * level
        parts = [view[8 * phrases * k:8 * phrases * (k + 1)] for k in range(level)] + [b""] * (3 - level)
        rows.append((level, int(frame["shard"].iloc[0]), lang, *parts, view[at:at + 4 * phrases], whole[at + 4 * phrases:]))
    return pd.DataFrame(rows, columns=_COLUMNS)


def _rows(**columns) -> pd.DataFrame:
    """Findings with nullable integers, as a float can't hold a hash."""
    out = pd.DataFrame(columns).reindex(columns=["level", "shard", "h1", "h2", "h3", "lang", "word", "n", "segment"])
    return out.assign(**{c: out[c].astype("Int64") for c in ("level", "shard", "h1", "h2", "h3", "n")},
                      **{c: out[c].astype(object) for c in ("lang", "word", "segment")})


_FOUND = "level int, shard long, h1 long, h2 long, h3 long, lang string, word string, n long, segment binary"


def _merged(frame: pd.DataFrame, shards: int, least: int, proposals: Proposals, sampled: bool) -> pd.DataFrame:
    """One shard of one level: frequent phrases, and the segment of those that weren't proposed.

    Words also give the sum of their counts per language (level 0) and the hashes of two words (level -1).
    """
    level, shard = int(frame["level"].iloc[0]), int(frame["shard"].iloc[0])
    blocks = [[np.frombuffer(b, np.uint64) for b in frame[f"h{k + 1}"]] for k in range(level)]
    ns = [np.frombuffer(b, np.uint32) for b in frame["n"]]
    rows, wanted = [], []
    for cut in _ranges(level, blocks[0]):
        parts = [np.concatenate([b[c] for b, c in zip(p, cut)]) for p in blocks]
        n = np.concatenate([b[c] for b, c in zip(ns, cut)]).astype(np.int64)
        if not len(n):
            continue
        order = np.lexsort(parts[::-1])
        parts, n = [p[order] for p in parts], n[order]
        new = np.concatenate([[True], np.any([p[1:] != p[:-1] for p in parts], axis=0)])
        first = np.flatnonzero(new)
        total = np.add.reduceat(n, first)
        if not sampled:
            which = np.flatnonzero(total >= least)
            hashes = {f"h{k + 1}": p[first[which]].view(np.int64) for k, p in enumerate(parts)}
            found = _rows(level=np.full(len(which), level), n=total[which], **hashes)
            if level == 1:
                words = [w for block in frame["words"] for w in block.split(b"\n")]
                langs = [g for block in frame["lang"] for g, many in json.loads(block) for _ in range(many)]
                of = pd.Series(n).groupby([langs[k] for k in order], sort=False).sum()
                rows.append(_rows(level=np.zeros(len(of), int), lang=of.index, n=of.to_numpy()))
                found["lang"] = pd.Series([langs[order[first[k]]] for k in which], dtype=object)
                found["word"] = pd.Series([words[order[first[k]]].decode("utf-8", "replace") for k in which], dtype=object)
                ends = np.append(first, len(n))
                for k in which:
                    own = {(langs[j], words[j]) for j in order[ends[k]:ends[k + 1]]}
                    if len(own) > 1:
                        rows.append(_rows(level=[-1], n=[len(own)]))
            if len(found):
                rows.append(found)
        if level < 3:
            first = first[total >= least]
            hashes = parts[0][first] if level == 1 else pair_hash(parts[0][first], parts[1][first])
            wanted.append(hashes[~proposals.has(level, hashes)])
    if wanted and len(hashes := np.concatenate(wanted)):
        rows.append(_rows(level=[level], segment=[proposals.segment(level, shard, shards, hashes)]))
    return pd.concat(rows or [_rows(level=[])], ignore_index=True).assign(shard=shard)


def _ranges(level: int, firsts: list) -> Iterator[list[slice]]:
    """Slices of blocks that can be added up one after the other. Blocks of pairs and triples stand by their first word's hash."""
    ranges = 1 if level == 1 else -(-sum(map(len, firsts)) // MERGED)
    bounds = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    cuts = [[0, *np.searchsorted(h, bounds).tolist(), len(h)] for h in firsts]
    for k in range(ranges):
        yield [slice(c[k], c[k + 1]) for c in cuts]


def _pass(rows: DataFrame, salt: int, shards: int, least: int, old: Proposals | None, new: Proposals, sampled: bool) -> tuple[DataFrame, Proposals]:
    """Counts what ``new`` admits and ``old`` doesn't: the stored findings, and the proposals with the failures."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((old, new))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, now = shared.value
        task = TaskCounts(salt, shards, before, None if sampled else now, before is None, 2 if sampled else 3)
        for batch in batches:
            for k in range(0, batch.num_rows, TAKEN):
                some = batch.slice(k, TAKEN)
                for lang, text in zip(some.column("lang").to_pylist(), some.column("text").to_pylist()):
                    yield from map(_packed, task.add(lang, text))
        yield from map(_packed, task.count())
        yield from map(_packed, task.flush())
        del task
        give_back()

    merged = rows.mapInArrow(count, _BLOCKS).groupBy("level", "shard").applyInPandas(
        lambda f: _merged(_unpacked(f), shards, least, shared.value[1], sampled), _FOUND)
    found, _ = stored(spark, merged, "phrase-counts", ["level"])
    segments = found.where("segment is not null").select("level", "shard", "segment").collect()  # the tables' bits, compressed
    after = new.joined(segments, shards) if segments else new
    shared.destroy()
    return found, after


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, sample: int = SAMPLE, lang_col: str = "lang", doc_col: str = "doc_id",
                     text_col: str = "text", word_bits: int = WORD_BITS, pair_bits: int = PAIR_BITS) -> tuple[DataFrame, int]:
    """Words, pairs and triples that stand ``min_count`` times or more (level, h1-h3, lang, word, n; level 0 holds the number of words
    of a language), and the number of full passes it took."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"),
                       F.pmod(F.xxhash64(F.col(doc_col).cast("long"), text), F.lit(sample)).alias("part"))
    # a power of two of shards, at most one for eight bits of the smaller table
    shards = min((input_partitions(rows) - 1).bit_length(), word_bits - 3, pair_bits - 3)
    lowered = max(1, int(LOWERED * min_count / sample))
    for salt in range(8):
        _, now = _pass(rows.where("part = 0").drop("part"), salt, shards, lowered, None, Proposals(word_bits, pair_bits), True)
        before, passes = None, []
        while True:
            found, after = _pass(rows.drop("part"), salt, shards, min_count, before, now, False)
            passes.append(found.where("segment is null"))
            if after is now:
                break
            before, now = now, after
        if passes[0].where("level = -1").isEmpty():
            out = passes[0]
            for p in passes[1:]:
                out = out.unionByName(p)
            return out, len(passes)
    raise ValueError("different words share hashes under every salt")


def _score(a: str, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", wide(F.col(a)) * F.col(a).cast("decimal(19,0)") * F.lit(1000000).cast("decimal(7,0)"),
                           wide(left) * right.cast("decimal(19,0)"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, sample: int = SAMPLE, lang_col: str = "lang",
                 doc_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """Each language's first ``top`` phrases of two and three words: lang, rank, phrase, a, l, r, n, score."""
    found, _ = frequent_phrases(docs, min_count, sample, lang_col, doc_col, text_col, **sizes)
    words = found.where("level = 1").select("h1", "lang", "word", "n")
    pairs = found.where("level = 2").select("h1", "h2", "n")
    triples = found.where("level = 3").select("h1", "h2", "h3", "n")
    totals = found.where("level = 0").groupBy("lang").agg(F.sum("n").alias("n"))

    def word(k: int) -> DataFrame:
        return words.select(F.col("h1").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("n").alias(f"f{k}"),
                            *([F.col("lang")] if k == 1 else []))

    inside = triples.select(F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"), "n")
    inside = inside.groupBy("p.h1", "p.h2").agg(F.max("n").alias("longer"))
    two = pairs.withColumnRenamed("n", "a").join(inside, ["h1", "h2"], "left").where("longer is null or 100 * longer < 50 * a")
    two = two.join(word(1), "h1").join(word(2), "h2").select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
        _score("a", F.col("f1"), F.col("f2")).alias("score"))
    front = pairs.select("h1", "h2", F.col("n").alias("front"))
    back = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("n").alias("back"))
    three = triples.withColumnRenamed("n", "a").join(front, ["h1", "h2"]).join(back, ["h2", "h3"])
    three = three.join(word(1), "h1").join(word(2), "h2").join(word(3), "h3")
    three = three.withColumns({"s1": _score("a", F.col("f1"), F.col("back")), "s2": _score("a", F.col("front"), F.col("f3"))})
    cut = lambda one, other: F.when(F.col("s2") < F.col("s1"), F.col(other)).otherwise(F.col(one))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", cut("f1", "front").alias("l"),
                         cut("back", "f3").alias("r"), F.least("s1", "s2").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    spread = F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    every = two.unionByName(three).withColumn("part", spread)
    # first each part's best, then the language's: no task gets more than ``top`` rows of a part
    best = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                                              F.col("score").cast("long").alias("score"))
