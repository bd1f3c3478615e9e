"""Token file and rank-array BPE against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from attrix.llm import rank_bpe, token_file
from attrix.llm.common import scratch
from attrix.llm.queries import tokenizer

from odd_cases import TEXTS

ALPHABET = " \n\t\x0b\x1c\x85\xa0aAéÉßſΣςİıǅ'sStTdD109.,!?<|>%́‍😀中　"


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(3)
    made = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    fixed = ["", "  a  b\n\n c \t d", "<|endoftext|>x <|startoftext|> y", "ΑΣ ΣΑΣ Σ İ", "it's I'LL don't'", "x" * 3000, "abc" * 700,
             "re,\nnext. Word; one: \n", "日本語 한국어 🇩🇪 ½ Ⅷ", "\x00<|endoftext|>"]
    return fixed + made + [t for _, t in TEXTS if t]


def test_byte_level_ids_equal_the_library(odd_texts):
    own, lib = token_file.ChunkEncoder(tokenizer("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    for text, ids in zip(odd_texts, own.encode(odd_texts)):
        assert np.frombuffer(ids, own.kind).tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_small_caches_change_nothing(odd_texts, monkeypatch):
    own = token_file.ChunkEncoder(tokenizer("byte_bpe_50k.json"))
    whole = own.encode(odd_texts)
    own.kept = token_file.Kept(50)
    assert [own.encode([t])[0] for t in odd_texts] == whole


def test_closing_marks_are_not_learned_with_their_words():
    own, lib = token_file.ChunkEncoder(tokenizer("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    own.encode(["first word$$$ word&&& word!!", "first line, word?\nword..."])
    assert set(own.kept) == {"\nfirst", "word", "line", "\nword", "\n\n"}
    marks = [*token_file.MARKS, *(a + b for a in token_file.MARKS for b in token_file.MARKS)]
    texts = [f"{w}{m} {w}{m}\n{m}{w}{m} {m}" for w in ("don't", "Ünï", "12", "ab-c9", "日本") for m in marks]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, own.kind).tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_rank_array_equals_the_library(odd_texts):
    path = tokenizer("word_bpe_49k.json")
    own, lib = rank_bpe.RankBpe(path), Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    for text, (ids, decoded, n) in zip(odd_texts, own.encode_many(odd_texts)):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want), text
        assert decoded == lib.decode(want, skip_special_tokens=False), text


def test_heap_and_scan_merge_alike():
    own = rank_bpe.RankBpe(tokenizer("word_bpe_49k.json"))
    rnd = random.Random(1)
    for _ in range(300):
        word = "".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(1, 60)))
        parts = [own.first[b] for b in word.encode()]
        parts[-1] = own.last[word.encode()[-1]]
        assert own.word(word) == own._from_heap(parts)


@pytest.mark.parametrize("n,universe", [(1, 1), (5, 3), (64, 64), (1000, 10), (1000, 10**6), (300, 2**60)])
def test_elias_fano_select(n, universe):
    values = np.sort(np.random.default_rng(1).integers(0, universe, n).astype(np.uint64))
    stored = token_file.EliasFano(**token_file.EliasFano.of(values, universe).fields())
    assert [stored.select(i) for i in range(n)] == values.tolist()


def test_elias_fano_is_small():
    values = np.sort(np.random.default_rng(1).integers(0, 500_000, 1000).astype(np.uint64))
    f = token_file.EliasFano.of(values, 500_000).fields()
    assert len(f["low"]) + len(f["high"]) + len(f["samples"]) < 1000 * 12 // 8


def test_token_file_round_trip(spark, odd):
    path, lib = scratch(spark, "token-file"), Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    token_file.write_token_file(odd, path, tokenizer("byte_bpe_50k.json"))
    got = token_file.read_token_file(spark, path).collect()
    assert len(got) == len(TEXTS)
    want = sorted(((i is not None, i or 0), tuple(lib.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in TEXTS)
    rows = sorted(got, key=lambda r: r.start)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    at, last = 0, (False, 0)
    for r in rows:  # ascending ids, offsets without gaps
        key = (r.doc_id is not None, r.doc_id or 0)
        assert r.start == at and key >= last
        at, last = at + r.n_tokens, key


def test_token_digests_of_nothing(spark, nothing):
    assert token_file.token_digests(nothing, tokenizer("byte_bpe_50k.json")).collect() == []


def test_digests(spark, odd):
    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in token_file.token_digests(odd.where("doc_id in (0, 4, 9, 10)"), tokenizer("byte_bpe_50k.json")).collect()}
    for i in (0, 4, 9, 10):
        ids = lib.encode(dict(TEXTS)[i] or "", add_special_tokens=False).ids + [0]
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_bpe_rows(spark, odd, nothing):
    path = tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = rank_bpe.encode_digests(odd, path).collect()
    want = []
    for i, t in TEXTS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    model = rank_bpe.bpe(path)
    for r in rank_bpe.encode_documents(odd, path).collect():
        assert model.decode(r.ids) == r.decoded
    assert rank_bpe.encode_digests(nothing, path).collect() == []


def test_another_operator_takes_over_the_worker():
    from attrix.llm import common

    gone = []
    before = list(common._HOLDER)
    try:
        common.hold("one", lambda: gone.append("one"))
        common.hold("one", lambda: gone.append("one again"))
        assert gone == []
        common.hold("two", lambda: gone.append("two"))
        assert gone == ["one again"] and common._HOLDER[0] == "two"
    finally:
        common._HOLDER[:] = before
