"""Operator 1: token ids of whole texts in one concatenated array, document bounds as Elias-Fano lists.

File format: a Parquet table of blocks (so that Spark's commit protocol covers it on any file system), in ascending
order of document id over (part, block). A block holds whole documents:

- ``ids``: their ids, little-endian, ``id_bytes`` each, without separators;
- ``ends``: Elias-Fano list of the documents' end positions within the block;
- ``docs``: Elias-Fano list of the document ids less ``first_doc`` (``n_null`` documents with a null id come first).

An Elias-Fano list of n values below u keeps floor(log2(u / n)) low bits of each value packed, the rest in unary in a
bit vector, and the position of every 64th set bit, so ``select(i)`` scans a few bytes: about 2 + log2(u / n) bits a
value. Documents of equal id are in the order of their texts' hashes; a null or empty text has the end id alone; an
empty table gives a table without blocks; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrix.llm.common import Kept, hold, id_and_text, scratch, text_runs
from attrix.llm.rank_bpe import byte_symbols

END_ID = 0
BLOCK_IDS = 1 << 18      # a block is closed when it has as many ids; longer documents have a block of their own
SAMPLE = 64              # set bits between two select samples
CACHE_CHUNKS = 500_000   # chunks in each of the two generations whose ids a worker keeps
JOINED_CHUNKS = 500      # new chunks that go to the library in one call
ENCODED_CHARS = 1 << 22  # characters of texts that are encoded together
CACHED_CHARS = 64        # longer chunks are encoded anew
CACHE_MARKS = 10_000     # closing marks whose ids a worker keeps
MARKS = string.punctuation

ARRAY_CODES = {"u2": "H", "u4": "I"}
#: White space that only Python counts as such, and what keeps a text from being cut at spaces and line ends alone.
CONTROLS = "\x1c\x1d\x1e\x1f"
UNEVEN = ["  ", " \n", "\n ", "\n\n", *"\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000",
          *map(chr, range(0x2000, 0x200B))]

_ONES = np.array([bin(k).count("1") for k in range(256)], np.uint8)


class EliasFano:
    """An ascending list of integers below ``universe`` (uint64)."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if n == 0:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, (int(universe) // n).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        places = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1, np.uint8)
        high[places] = 1
        return cls(n, low_bits, np.packbits(bits.reshape(-1), bitorder="little").tobytes(),
                   np.packbits(high, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The value at position i."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, skip = at >> 3, at & 7
        first = int(self.high[byte]) >> skip << skip
        while left >= (ones := int(_ONES[first])):
            left -= ones
            byte += 1
            first = int(self.high[byte])
        place = -1
        for bit in range(8):
            if first >> bit & 1:
                if left == 0:
                    place = bit
                    break
                left -= 1
        upper = byte * 8 + place - i
        low = 0
        if self.low_bits:
            start = i * self.low_bits
            end = start + self.low_bits
            word = int.from_bytes(self.low[start >> 3:(end + 7) >> 3].tobytes(), "little")
            low = word >> (start & 7) & ((1 << self.low_bits) - 1)
        return upper << self.low_bits | low

    def __len__(self) -> int:
        return self.n

    def fields(self) -> dict:
        return {"n": self.n, "low_bits": self.low_bits, "low": self.low.tobytes(), "high": self.high.tobytes(),
                "samples": self.samples.tobytes()}


class ChunkEncoder:
    """Ids of whole texts by a byte-level tokenizer file, exactly those of the tokenizers library.

    The file's pre-tokenizer never joins text over the cuts made here (before a space and a non-space, and around
    other white space), so each different chunk is encoded by the library once and kept. New chunks are encoded
    many at a time, joined by line ends, whose id no chunk can have. Texts in which the cuts could differ (control
    separators, strings of added tokens) are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.id_bytes = int(self.kind[2])
        self.whole = [*CONTROLS, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.cut = re.compile(r" ?\S+|\s+(?!\S)|\s")
        (self.line_end,) = self._ids("\n")
        self.symbols = dict(enumerate(byte_symbols()))
        self.marks: dict[str, bytes] = {}
        self.kept = Kept(CACHE_CHUNKS)

    def _ids(self, text: str) -> np.ndarray:
        (got,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(got.ids, self.kind)

    def _even(self, text: str) -> bool:
        """Whether spaces and line ends alone say where the text's chunks end."""
        return not (text[0] in " \n" or text[-1] in " \n" or any(x in text for x in UNEVEN))

    def _chunks(self, text: str) -> list[str]:
        """The text's chunks; those after a space go without it, others have a line end in front as a mark."""
        return [c[1:] if c[0] == " " and c[1:].strip() else "\n" + c for c in self.cut.findall(text)]

    def _mark_ids(self, marks: str) -> bytes:
        got = self.marks.get(marks)
        if got is None:
            got = self._ids(marks).tobytes()
            if len(self.marks) < CACHE_MARKS:
                self.marks[marks] = got
        return got

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that aren't kept. The pre-tokenizer cuts between a letter or digit and the marks that end a
        chunk, so that such a chunk's ids are those of its body, which is kept in its place, and of the marks."""
        kept = self.kept
        bodies = [c.rstrip(MARKS) if c[-1] in MARKS else c for c in chunks]
        bodies = [b if b and b[-1].isalnum() else c for b, c in zip(bodies, chunks)]
        wanted = set(bodies)
        ids = dict(zip(wanted, map(kept.find, wanted)))
        new = [c for c, x in ids.items() if x is None]
        several: list[str] = []
        tokenize, code, symbols = self.tokenizer.model.tokenize, ARRAY_CODES[self.kind[1:]], self.symbols
        space = symbols[32]
        for c in new:
            word = c[1:] if c[0] == "\n" else c
            if word.isalpha():  # one word for the pre-tokenizer: straight to the model
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(symbols)
                ids[c] = array(code, [t.id for t in tokenize(word if c[0] == "\n" else space + word)]).tobytes()
            elif c[0] == "\n" and not word.strip():
                ids[c] = self._ids(word).tobytes()  # white space alone
            else:
                several.append(c)
        for at in range(0, len(several), JOINED_CHUNKS):
            some = several[at:at + JOINED_CHUNKS]
            got = self._ids("\n".join([c[1:] if c[0] == "\n" else " " + c for c in some]))
            ends = np.flatnonzero(got == self.line_end)
            starts = np.concatenate([[0], ends + 1]) * self.id_bytes
            stops = np.concatenate([ends, [len(got)]]) * self.id_bytes
            data = got.tobytes()
            ids.update(zip(some, [data[i:j] for i, j in zip(starts.tolist(), stops.tolist())], strict=True))
        kept.update([(c, ids[c]) for c in new if len(c) <= CACHED_CHARS])
        return [ids[c] if len(b) == len(c) else ids[b] + self._mark_ids(c[len(b):]) for b, c in zip(bodies, chunks)]

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks, from what is kept or the library."""
        got = list(map(self.kept.get, chunks))
        at = [k for k, x in enumerate(got) if x is None]
        for k, x in zip(at, self._learn([chunks[k] for k in at]) if at else ()):
            got[k] = x
        return got

    def _encode_even(self, texts: list[str]) -> list[bytes]:
        """Each text is a row of chunks with a space in front (a line end is one of its own); Arrow finds the
        different ones, and the chunks' ids are put together by their codes."""
        rows = [" \n" + t.replace("\n", " \n\n \n") for t in texts]
        data = np.frombuffer("".join(rows).encode(), np.uint8)
        starts = np.flatnonzero(data == 32)
        offsets = np.append(starts, len(data)).astype("<i8")
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        own = self._ids_of("".join(chunks.dictionary.to_numpy(zero_copy_only=False)).split(" ")[1:])
        size = np.fromiter(map(len, own), np.int64, len(own)) // self.id_bytes
        known, codes = np.frombuffer(b"".join(own), self.kind), chunks.indices.to_numpy()
        sizes = size[codes]
        ends = np.cumsum(sizes)
        ids = known[np.repeat((np.cumsum(size) - size)[codes] - (ends - sizes), sizes) + np.arange(ends[-1])]
        bounds = np.append(0, ends[np.cumsum([r.count(" ") for r in rows]) - 1]).tolist()
        return [ids[i:j].tobytes() for i, j in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        even: list[int] = []
        for k, text in enumerate(texts):
            if any(x in text for x in self.whole):
                out[k] = self._ids(text).tobytes()
            elif text and self._even(text):
                even.append(k)
            elif text:
                chunks = self._chunks(text)
                wanted = list(set(chunks))
                out[k] = b"".join(map(dict(zip(wanted, self._ids_of(wanted))).__getitem__, chunks))
        if even:
            for k, ids in zip(even, self._encode_even([texts[k] for k in even])):
                out[k] = ids
        self.kept.turn()
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


_LIST = "struct<n: int, low_bits: int, low: binary, high: binary, samples: binary>"
BLOCKS = (f"part int, block long, first_id long, n_docs int, n_ids long, id_bytes int, first_doc long, n_null int, "
          f"docs {_LIST}, ends {_LIST}, ids binary")


def _block(part: int, block: int, first_id: int, docs: list[int | None], ids: list[bytes], width: int) -> dict:
    ends = np.cumsum([len(x) // width for x in ids])
    known = [d for d in docs if d is not None]
    base = known[0] if known else 0
    deltas = np.array([d - base for d in known], np.uint64)
    return {"part": part, "block": block, "first_id": first_id, "n_docs": len(docs), "n_ids": int(ends[-1]),
            "id_bytes": width, "first_doc": base, "n_null": len(docs) - len(known),
            "docs": EliasFano.of(deltas, int(deltas[-1]) + 1 if known else 0).fields(),
            "ends": EliasFano.of(ends, int(ends[-1]) + 1).fields(), "ids": b"".join(ids)}


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, doc_col: str = "doc_id", text_col: str = "text",
                     end_id: int = END_ID) -> None:
    """Encodes every text, appends ``end_id``, and writes the blocks in ascending order of document id."""
    rows = id_and_text(docs, doc_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        hold("token_file", _ENCODERS.clear)
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        end = int(end_id).to_bytes(enc.id_bytes, "little")
        ids: list[bytes] = []
        ids_of: list[int | None] = []
        size = block = first = 0

        def close() -> pd.DataFrame:
            nonlocal ids, ids_of, size, block, first
            row = _block(part, block, first, ids_of, ids, enc.id_bytes)
            ids, ids_of, size, block, first = [], [], 0, block + 1, first + row["n_ids"]
            return pd.DataFrame([row])

        for frame in frames:
            texts, of = frame["text"].tolist(), frame["doc_id"].tolist()
            for start, stop in text_runs(texts, ENCODED_CHARS):
                for doc, got in zip(of[start:stop], enc.encode(texts[start:stop])):
                    ids.append(got + end)
                    ids_of.append(None if pd.isna(doc) else int(doc))
                    size += len(got) // enc.id_bytes + 1
                    if size >= BLOCK_IDS:
                        yield close()
        if ids:
            yield close()

    ordered.mapInPandas(encode, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_token_file(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian, four bytes) per document.

    Offsets within a block come from the lists' select; a block's place is that in its part plus the ids of the parts
    before, of which there is one row a write task.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                docs, ends = EliasFano(**row.docs), EliasFano(**row.ends)
                ids = np.frombuffer(row.ids, f"<u{row.id_bytes}")
                out, at = [], 0
                for k in range(row.n_docs):
                    end = ends.select(k)
                    doc = row.first_doc + docs.select(k - row.n_null) if k >= row.n_null else None
                    out.append((doc, row.before + row.first_id + at, end - at, ids[at:end].astype("<u4").tobytes()))
                    at = end
                yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids"]).astype({"doc_id": "Int64"})

    return blocks.join(F.broadcast(before), "part").mapInPandas(
        documents, "doc_id long, start long, n_tokens long, ids binary")


def token_digests(docs: DataFrame, tokenizer_path: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token file to the shared folder and reads it back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(docs.sparkSession, "token-file")
    write_token_file(docs, path, tokenizer_path, doc_col, text_col)
    return read_token_file(docs.sparkSession, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
