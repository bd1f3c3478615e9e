"""Operator 3: BPE encoding and decoding with a contiguous rank array.

A word is a row of parts beside a row of the ranks of adjacent parts. The least rank is found by a scan of that
row, its boundary is deleted, and the ranks left and right of it are refreshed, until no rank is left; the rows of many
words are scanned together. Words of over ``SCANNED`` bytes, for which repeated scans would be quadratic, take their
merges from a heap in the same order.

Follows the tokenizer file: added tokens are cut out of the raw text, the rest is NFC-normalised and lower-cased by
code point, words are matched by the file's pattern, mapped to byte symbols and closed by the word-end suffix. The
file names no decoder, so decoding joins the tokens by one space. A null text counts as empty (no ids, empty decoded
text); other columns are ignored; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import Kept, hold, id_and_text, text_runs

SCANNED = 256           # symbols of a word up to which the rank array is scanned
ROWS = 5_000            # words whose arrays are scanned together
CACHE_CHUNKS = 80_000   # chunks in each of the two generations whose ids a worker keeps
CACHED_CHARS = 64
ENCODED_CHARS = 1 << 20  # characters of texts that are encoded together
MARK = "\0"             # stands before the string of an added token
NONE = 1 << 30          # the rank of a pair that never merges

# Unicode white space, as the library's patterns take it (without the control separators U+001C to U+001F)
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


CONTROLS = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class RankBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        kinds = [s["type"] for s in spec["pre_tokenizer"].get("pretokenizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or kinds != ["Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError(f"{path}: not a lower-casing word-end BPE file")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace("\\s", SPACE))
        self.ends = model["end_of_word_suffix"]
        self.ids = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.added.items()]}
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault(self.ids[a] << 32 | self.ids[b], k)
            self.merged.append(self.ids[a + b])
        symbols = byte_symbols()
        self.first = [self.ids[s] for s in symbols]
        self.last = [self.ids[s + self.ends] for s in symbols]
        self.first_ids, self.last_ids = np.array(self.first), np.array(self.last)
        self.merged_ids = np.array(self.merged)
        pairs = sorted(self.rank.items())
        self.pair_keys, self.pair_ranks = np.array([k for k, _ in pairs]), np.array([r for _, r in pairs])
        self.kept = Kept(CACHE_CHUNKS)

    def word(self, word: str) -> list[int]:
        """Ids of one word."""
        return self.word_ids([word])[0]

    def word_ids(self, words: list[str]) -> list[list[int]]:
        """Ids of many words; those of like length share the arrays, a row each."""
        out: list[list[int]] = [[]] * len(words)
        rows: dict[int, list[int]] = {}
        data = [w.encode("utf-8") for w in words]
        for k, d in enumerate(data):
            if len(d) <= SCANNED:
                rows.setdefault(max(4, 1 << (len(d) - 1).bit_length()), []).append(k)
            else:
                parts = [self.first[b] for b in d]
                parts[-1] = self.last[d[-1]]
                out[k] = self._from_heap(parts)
        for width, which in rows.items():
            for at in range(0, len(which), ROWS):
                some = which[at:at + ROWS]
                for k, ids in zip(some, self._scan([data[k] for k in some], width)):
                    out[k] = ids
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of parts; NONE where a pair never merges or a part is missing (-1)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def _scan(self, data: list[bytes], width: int) -> list[list[int]]:
        n = len(data)
        lengths = np.array([len(d) for d in data])
        raw = np.frombuffer(b"".join([d.ljust(width, b"\0") for d in data]), np.uint8).reshape(n, width)
        column = np.arange(width)
        parts = np.where(column < lengths[:, None], self.first_ids[raw], -1)
        parts[np.arange(n), lengths - 1] = self.last_ids[raw[np.arange(n), lengths - 1]]
        ranks = np.full((n, width), NONE)
        ranks[:, :-1] = self._ranks(parts[:, :-1], parts[:, 1:])
        done = np.empty_like(parts)
        row = np.arange(n)  # rows of ``parts`` that still have a rank, by their number among the words
        while len(row):
            i = ranks.argmin(axis=1)
            own = np.arange(len(row))
            least = ranks[own, i]
            over = least == NONE
            if over.any():
                done[row[over]] = parts[over]
                keep = ~over
                row, parts, ranks, i, least = row[keep], parts[keep], ranks[keep], i[keep], least[keep]
                own = np.arange(len(row))
                if not len(row):
                    break
            parts[own, i] = self.merged_ids[least]
            # delete the boundary after i: all parts and ranks behind it move up by one
            take = np.minimum(column + (column > i[:, None]), width - 1)
            last = parts.shape[1] - 1
            parts = np.take_along_axis(parts, take, 1)
            parts[:, last] = -1
            ranks = np.take_along_axis(ranks, np.minimum(column + (column >= i[:, None]), width - 1), 1)
            ranks[:, last] = NONE
            has = i > 0
            ranks[own[has], i[has] - 1] = self._ranks(parts[own[has], i[has] - 1], parts[own[has], i[has]])
            has = i < last
            ranks[own[has], i[has]] = self._ranks(parts[own[has], i[has]], parts[own[has], i[has] + 1])
        counts = (done >= 0).sum(axis=1)
        flat = done[done >= 0].tolist()
        stops = np.cumsum(counts).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]

    def _from_heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        before, after, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        rank = self.rank.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1)
                if (r := rank(parts[i] << 32 | parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], live[j] = self.merged[r], False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (s := rank(parts[p] << 32 | parts[q], NONE)) != NONE:
                    heapq.heappush(heap, (s, p, parts[p], parts[q]))
        return [p for p, on in zip(parts, live) if on]

    def _learn(self, chunks: list[str]) -> dict[str, tuple[str, str, int]]:
        words = [self.words.findall(c) for c in chunks]
        different = list(set().union(*words))
        ids = dict(zip(different, self.word_ids(different)))
        tokens, out = self.tokens, {}
        for c, ws in zip(chunks, words):
            got = [i for w in ws for i in ids[w]]
            out[c] = (" ".join(map(str, got)), " ".join([tokens[i] for i in got]), len(got))
        return out

    def _cut(self, text: str) -> list[str]:
        """Pieces that encode apart: added tokens behind a mark, the rest normalised and cut at white space.

        Python's white space has the control separators too; stretches with them stay whole.
        """
        out: list[str] = []
        for k, piece in enumerate(self.splits.split(text) if "<|" in text else (text,)):
            if k % 2:
                out.append(MARK + piece)
                continue
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece).replace("\u03a3", "\u03c3")
            piece = piece.lower()
            out += [piece] if any(x in piece for x in CONTROLS) else piece.split()
        return out

    def encode_many(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """Per text the ids in decimal and the decoded text, both joined by spaces, and the number of ids."""
        cut = [self._cut(t) for t in texts]
        kept = self.kept
        looked = [list(map(kept.__getitem__, chunks)) for chunks in cut]
        new = list(kept.new)
        if new:
            for c in new:
                if c[:1] == MARK and c[1:] in self.added:
                    kept[c] = (str(self.added[c[1:]]), c[1:], 1)
            kept.update(self._learn([c for c in new if c not in kept]))
            kept.new.clear()
        out = []
        for chunks, at_once in zip(cut, looked):
            if None in at_once:
                at_once = [kept[c] if x is None else x for x, c in zip(at_once, chunks)]
            got = [x for x in at_once if x[2]]
            if got:
                ids, tokens, counts = zip(*got)
                out.append((" ".join(ids), " ".join(tokens), sum(counts)))
            else:
                out.append(("", "", 0))
        for c in new:
            if len(c) > CACHED_CHARS:
                del kept[c]
        kept.turn()
        return out

    def encode(self, text: str) -> tuple[str, str, int]:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


_BPE: dict[str, RankBpe] = {}


def bpe(path: str) -> RankBpe:
    if path not in _BPE:
        _BPE[path] = RankBpe(path)
    return _BPE[path]


def _rows(frames: Iterator[pd.DataFrame], path: str, digest: bool) -> Iterator[pd.DataFrame]:
    hold("rank_bpe", _BPE.clear)
    model = bpe(path)
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
    for frame in frames:
        texts, of = frame["text"].tolist(), frame["doc_id"].tolist()
        for start, stop in text_runs(texts, ENCODED_CHARS):
            out = []
            for doc, (ids, decoded, n) in zip(of[start:stop], model.encode_many(texts[start:stop])):
                if digest:
                    out.append((doc, n, sha(ids), sha(decoded)))
                else:
                    out.append((doc, n, np.array(ids.split(), np.int32), decoded))
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})


def encode_documents(docs: DataFrame, path: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every text."""
    rows = id_and_text(docs, doc_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(lambda f: _rows(f, path, False),
                            "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by spaces) and decoded_sha256 of every text."""
    rows = id_and_text(docs, doc_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(lambda f: _rows(f, path, True),
                            "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
