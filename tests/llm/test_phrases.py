"""Phrase mining against plain counts."""

import json
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from attrix.llm import phrase_mining

from odd_cases import TEXTS, prose


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counts(rows):
    f = defaultdict(Counter)
    for _, text, lang in rows:
        for ws in pieces(text):
            for size in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(ws[k:k + size]) for k in range(len(ws) - size + 1))
    return f


def brute(rows, least, top):
    out = []
    for lang, f in counts(rows).items():
        n, found = sum(c for p, c in f.items() if len(p) == 1), []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) > len(p) and c >= least and 100 * c >= 50 * a and p in (q[:2], q[1:]) for q, c in f.items() if len(p) == 2):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in phrase_mining.collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def table(seed, n=80):
    rnd = random.Random(seed)
    words = "The of a é ß to x y z w1 w2 w3 w4 w5 東京".split()
    stock = [" ".join(rnd.choice(words) for _ in range(4)) for _ in range(6)]
    def part():  # noqa: E306
        return rnd.choice(stock) if rnd.random() < 0.4 else rnd.choice(words) if rnd.random() < 0.8 else prose(rnd.randrange(9), 3)
    rows = [(k, "".join(part() + rnd.choice([" ", " ", "\t", "  ", ", ", ".\n", "\x0b", "\xa0"]) for _ in range(rnd.randint(0, 30))),
             rnd.choice(["en", "en", "de", None, "und"])) for k in range(n)]
    return rows + rows[:9] + [(None, "sich " * 60, "de"), (900, None, "xx"), (901, "", "xx")]


@pytest.mark.parametrize("seed,least,top,sample,bits", [(1, 10, 2000, 8, {}), (2, 3, 7, 40, {"word_bits": 12, "pair_bits": 12}),
                                                        (3, 4, 50, 1, {"word_bits": 16, "pair_bits": 16})])
def test_collocations_equal_brute_force(spark, odd, seed, least, top, sample, bits):
    """Also with a sample that misses most phrases, and with tables so small that most phrases share a bit."""
    rows = table(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    assert mined(df, min_count=least, top=top, sample=sample, **bits) == brute(rows, least, top)


def test_failures_of_the_border_lead_to_more_passes(spark, odd):
    """A phrase that no sampled row holds: its words, then its pairs, then its triples are found."""
    rows = [(k, "common words here", "en") for k in range(40)] + [(100, "rare one two " * 20, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    took = {phrase_mining.frequent_phrases(df, 10, sample)[1] for sample in (1, 1 << 30)}
    assert min(took) == 1 and max(took) == 3
    assert mined(df, sample=1 << 30) == mined(df, sample=1) == brute(rows, 10, 2000)


def test_odd_tables(odd, nothing):
    assert mined(odd) == brute([(i, t, "en") for i, t in TEXTS], 10, 2000)
    assert mined(nothing) == []


@pytest.mark.parametrize("slice_,run,vocabulary,held", [(1 << 20, 200_000, 1 << 19, 2_000_000), (7, 5, 3, 4), (40, 11, 1000, 30), (3, 1, 1, 1)])
def test_task_bounds_change_no_count(monkeypatch, slice_, run, vocabulary, held):
    for name, value in zip(("SLICE", "RUN_WORDS", "VOCABULARY", "HELD"), (slice_, run, vocabulary, held)):
        monkeypatch.setattr(phrase_mining, name, value)
    rows = table(5, 30)
    every = phrase_mining.Proposals(10, 10)
    for bits in every.bits.values():
        bits[:] = 255
    task = phrase_mining.TaskCounts(0, 2, None, every, True, 3)
    blocks = [b for _, text, lang in rows for b in task.add(lang or "und", (text or "").encode())]
    blocks = pd.concat([*blocks, *task.count(), *task.flush()], ignore_index=True)
    got = Counter()
    name = {}
    for b in blocks[blocks.level == 1].itertuples():
        langs = [g for g, many in json.loads(b.lang) for _ in range(many)]
        for g, w, h, n in zip(langs, b.words.split(b"\n"), np.frombuffer(b.h1, np.uint64).tolist(), np.frombuffer(b.n, np.uint32).tolist()):
            name[h] = (g, w.decode())
            got[g, (w.decode(),)] += n
    for b in blocks[blocks.level > 1].itertuples():
        parts = [np.frombuffer(h, np.uint64).tolist() for h in (b.h1, b.h2, b.h3)[:b.level]]
        for *hs, n in zip(*parts, np.frombuffer(b.n, np.uint32).tolist()):
            got[name[hs[0]][0], tuple(name[h][1] for h in hs)] += n
    assert got == Counter({(lang, p): c for lang, f in counts(rows).items() for p, c in f.items()})


def test_two_words_of_one_hash_are_noticed():
    h = np.array([5, 5, 9], np.uint64)
    block = {"level": 1, "shard": 0, "lang": '[["en", 3]]', "h1": h.tobytes(), "h2": b"", "h3": b"", "n": np.array([6, 7, 3], np.uint32).tobytes(),
             "words": b"a\nb\nc"}
    out = phrase_mining._merged(pd.DataFrame([block]), 2, 10, phrase_mining.Proposals(10, 10), False)
    assert out[out.level == -1]["n"].tolist() == [2] and out[out.level == 0]["n"].tolist() == [16]


def test_scores_beyond_64_bits(spark, odd):
    df = spark.createDataFrame([(9 * 10**14, 9 * 10**14 + 1, 10**15)], "a long, l long, r long")
    from pyspark.sql import functions as F

    got = df.select(phrase_mining._score("a", F.col("l"), F.col("r")).alias("s")).first().s
    assert got == 10**6 * (9 * 10**14) ** 2 // ((9 * 10**14 + 1) * 10**15)


def test_a_task_that_holds_many_pairs_and_no_triple(monkeypatch):
    """As in the pass over the sample, which counts no triples."""
    monkeypatch.setattr(phrase_mining, "HELD", 3)
    task = phrase_mining.TaskCounts(0, 1, None, None, True, 2)
    blocks = [b for k in range(5) for b in [*task.add("en", b"a b c d e f g h"), *task.count()]]
    blocks = pd.concat([*blocks, *task.flush()], ignore_index=True)
    got = {level: sum(np.frombuffer(n, np.uint32).sum() for n in blocks[blocks.level == level]["n"]) for level in (1, 2, 3)}
    assert got == {1: 40, 2: 35, 3: 0}


def test_blocks_and_batches_stay_small():
    """A task's counts leave it in pieces, also where it has few shards."""
    every = phrase_mining.Proposals(10, 10)
    for bits in every.bits.values():
        bits[:] = 255
    task = phrase_mining.TaskCounts(0, 1, None, every, True, 3)
    text = " ".join(f"w{k}" for k in range(200_000)).encode()
    frames = [*task.add("en", text), *task.count(), *task.flush()]
    sizes = [[sum(len(x) for x in row[3:]) for row in f.itertuples(index=False)] for f in frames]
    assert max(max(s) for s in sizes) < 1 << 19 and max(map(sum, sizes)) < 1 << 21
    entries = pd.concat(frames).groupby("level")["n"].agg(lambda c: sum(map(len, c)) // 4)
    assert entries.to_dict() == {1: 200_000, 2: 199_999, 3: 199_998}


def test_blocks_come_back_as_they_were_sent():
    every = phrase_mining.Proposals(10, 10)
    for bits in every.bits.values():
        bits[:] = 255
    task = phrase_mining.TaskCounts(0, 1, None, every, True, 3)
    blocks = pd.concat([*task.add("en", b"a b c a b"), *task.add("und", b"a \xc3\xa9"), *task.count(), *task.flush()], ignore_index=True)
    sent = phrase_mining._packed(blocks).to_pandas()
    assert set(blocks["level"]) == {1, 2, 3}
    for (level, shard), own in blocks.groupby(["level", "shard"]):
        back = phrase_mining._unpacked(sent[(sent["level"] == level) & (sent["shard"] == shard)])
        for c in ("h1", "h2", "h3", "n", "words"):
            assert [bytes(x) for x in back[c]] == own[c].tolist()
        assert level > 1 or back["lang"].tolist() == own["lang"].tolist()


def test_a_shard_is_added_up_in_little_memory():
    """Equal pairs of all blocks meet, and no more than a part of the shard is sorted at once."""
    rnd, blocks, plain = np.random.default_rng(1), [], Counter()
    for _ in range(40):
        h1 = np.sort(rnd.integers(0, 1 << 63, 25_000, dtype=np.uint64) * np.uint64(2))
        h1[:3], h2 = (1, 1, 2), rnd.integers(0, 1 << 63, 25_000, dtype=np.uint64)
        h2[:3] = (7, 8, 7)
        n = np.where(np.arange(25_000) == 9, 50, 1).astype(np.uint32)
        plain.update({(1, 7): 1, (1, 8): 1, (2, 7): 1, (int(h1[9]), int(h2[9])): 50})
        blocks.append({"level": 2, "shard": 0, "lang": None, "h1": h1.tobytes(), "h2": h2.tobytes(), "h3": b"", "n": n.tobytes(), "words": b""})
    frame, proposals = pd.DataFrame(blocks), phrase_mining.Proposals(10, 10)
    tracemalloc.start()
    out = phrase_mining._merged(frame, 0, 10, proposals, False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = out[out["segment"].isna()]
    got = {(int(np.int64(a).view(np.uint64)), int(np.int64(b).view(np.uint64))): int(n) for a, b, n in zip(found["h1"], found["h2"], found["n"])}
    assert got == plain
    assert most < 40e6  # the shard's blocks have 20 MB
