"""Line field, language lattice, toxicity network and n-gram model against brute force and held-out accuracy."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_cases import TEXTS, prose

from attrix.llm import gru_toxicity, kneser_ney, lang_lattice, line_crf
from attrix.llm.common import documents, table
from attrix.llm.queries import tokenizer

SF = "/root/testdata/sf0.01"


# line field


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    hit = {j for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for j in range(k, k + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_counts():
    rnd = random.Random(2)
    made = ["".join(rnd.choice("ab é\n\t\x0b\xa0#<|\x85") for _ in range(rnd.randint(0, 80))) for _ in range(500)]
    for text in made + [t or "" for _, t in TEXTS]:
        assert line_crf.base_counts(text.encode()) == brute_base(text), text


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(1)
    field = line_crf.Field(rng.normal(size=(2, line_crf.FEATURES)), rng.normal(size=2), rng.normal(size=(2, 2)))
    texts = [rng.integers(0, 2, (n, line_crf.FEATURES)).astype(np.float32) for n in (0, 1, 7, 3, 9, 9)]
    for x, got in zip(texts, field.decode(texts)):
        best = max(itertools.product((0, 1), repeat=len(x)), default=(), key=lambda y: sum(
            float(field.weights[b] @ r) for b, r in zip(y, x)) + (field.start[y[0]] if y else 0) + sum(
            field.moves[a, b] for a, b in zip(y, y[1:])))
        assert tuple(got) == best


def test_training_learns_lines():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 2, (20, line_crf.FEATURES)).astype(np.float32) for _ in range(60)]
    labels = [(x[:, 5] == 0).astype(int) for x in texts]
    field = line_crf.Field.train(texts, labels)
    assert np.mean(np.concatenate(field.decode(texts)) == np.concatenate(labels)) > 0.97


def test_all_lines_of_training_texts_are_learned(spark, odd, monkeypatch):
    seen = []
    monkeypatch.setattr(line_crf.Field, "train", lambda texts, lines: seen.append((texts, lines)))
    long = "\n".join(f"line {k} has some words of its own." for k in range(950))
    docs = spark.createDataFrame([(1, long), (2, "bad line\n" * 30), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    line_crf.train_field(docs, labels)
    (texts, lines), = seen
    whole = [line_crf.line_features(t.encode())[0] for t in ("bad line\n" * 30, long)]
    assert np.array_equal(np.concatenate(texts), np.concatenate(whole)) and list(map(len, texts)) == list(map(len, lines))


def test_line_rows(spark, odd, nothing):
    got = line_crf.line_quality(odd, line_crf.Field.fixed()).collect()
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(
        (str(i), *brute_base(t)) for i, t in TEXTS)
    assert line_crf.line_quality(nothing, line_crf.Field.fixed()).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert np.array_equal(line_crf.train_field(odd, labels).weights, line_crf.Field.fixed().weights)


def test_quality_of_labelled_documents(spark, odd):
    docs, labels = documents(spark, SF), table(spark, SF, "labels")
    kept = {r.doc_id: r for r in line_crf.line_quality(docs, line_crf.train_field(docs, labels)).collect()}
    good = [kept[r.doc_id] for r in labels.where("quality = 1").collect()]
    bad = [kept[r.doc_id] for r in labels.where("quality = 0").collect()]
    assert np.mean([r.kept for r in good if not r.base_failed]) > 0.95
    assert np.mean([r.kept for r in bad]) < 0.2


# language


def test_forward_sums_all_segmentations():
    lattice = lang_lattice.Lattice(["▁a", "▁", "a", "b", "ab", "ba", "▁ab", "c", "abc", "bc", "é"])
    rng = np.random.default_rng(2)
    table_ = np.vstack([rng.random((lattice.size - 1, 2)), np.full((1, 2), lang_lattice.RARE), np.zeros((1, 2))])
    model = lang_lattice.Model(lattice, ["x", "y"], table_)
    of = {p: table_[k] for k, p in enumerate(lattice.pieces)}

    def every(s):
        if not s:
            return np.ones(2)
        return sum((of[s[:k]] if s[:k] in of else np.full(2, lang_lattice.RARE if k == 1 else 0.0)) * every(s[k:])
                   for k in range(1, len(s) + 1))

    words = ["a", "abc", "abab", "éa", "zb", "b", "cabbage", "日"]
    assert np.allclose(model.word_logs(words), np.log([every("▁" + w) for w in words]))


def test_the_longest_pieces_are_summed():
    long = "▁straightforward"
    lattice = lang_lattice.Lattice([long, "▁", "a", "--------------------", "longword12"])
    assert lattice.width == len(long) and lattice.pieces and "--------------------" not in lattice.pieces
    table_ = np.full((lattice.size + 1, 1), 1e-9)
    table_[lattice.pieces.index(long)], table_[-1] = 0.5, 0
    assert np.isclose(lang_lattice.Model(lattice, ["x"], table_).word_logs([long[1:]])[0, 0], np.log(0.5))


def test_language_rows(spark, odd, nothing):
    path = tokenizer("piece_bpe_32k.model")
    docs = documents(spark, SF)
    got = lang_lattice.held_out_languages(docs, path).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    model = lang_lattice.train(docs.limit(50), path)
    rows = lang_lattice.predict_languages(odd, model).collect()
    assert sorted((str(r.doc_id), r.lang_pred == "und") for r in rows) == sorted(
        (str(i), not any(c.isalpha() for c in t or "")) for i, t in TEXTS)
    assert lang_lattice.predict_languages(nothing, model).collect() == []
    none = lang_lattice.train(docs.where("false"), path)
    assert {r.lang_pred for r in lang_lattice.predict_languages(odd, none).collect()} == {"und"}


def test_every_language_is_learned_in_blocks(spark, odd, monkeypatch):
    """More languages than one block, or than 200: each knows its own letters, and blocks change no score."""
    path = tokenizer("piece_bpe_32k.model")
    known = [p for p in lang_lattice.vocabulary(path) if p.isalpha() and p.islower() and 5 <= len(p) <= 8]
    own = {f"l{k:03d}": known[k * 5:k * 5 + 5] for k in range(207)}
    rows = [(k, " ".join(own[lang] * 4), lang) for k, lang in enumerate(own)] + [(999, "12 !", "l000"), (None, None, "l001")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).checkpoint()
    model = lang_lattice.train(docs, path)
    assert model.table.count() == 207
    got = {r.doc_id: r for r in lang_lattice.predict_languages(docs, model).collect()}
    assert len(got) == len(rows) and all(got[k].lang_pred == lang for k, (_, _, lang) in enumerate(rows[:207]))
    assert got[999].lang_pred == got[None].lang_pred == "und" and got[999].score == 0
    monkeypatch.setattr(lang_lattice, "BLOCK", 1000)
    for r in lang_lattice.predict_languages(docs, model).collect():
        assert r.lang_pred == got[r.doc_id].lang_pred and np.isclose(r.score, got[r.doc_id].score)


# toxicity


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    words = [b"one", b"two", b"three", b"x"]
    net = gru_toxicity.Network({b"one": 0, b"two": 1}, np.array([1.0, -1.0, 0.0]))
    at, y, weight = rng.integers(0, 4, (3, 6)), np.array([1, 0, 1], np.float32), np.array([1, 0.7, 1], np.float32)
    mask = np.arange(6) < np.array([[6], [4], [5]])

    def loss():
        z = net.logits(net.gates(net.inputs(words)), np.pad(at, ((0, 0), (0, 0))), mask).astype(float)
        return float(((np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)) * weight).sum() / weight.sum())

    grad = net.gradients(words, at, mask, y, weight)
    for name, p in net.p.items():
        flat, g = p.reshape(-1), grad[name].reshape(-1)
        for k in np.argsort(-np.abs(g))[:3]:
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert g[k] == pytest.approx((up - down) / 2e-2, abs=2e-3), name


def test_windows_cover_whole_texts():
    for n in (1, 31, 32, 33, 56, 57, 500):
        starts = gru_toxicity.window_starts(n)
        covered = set().union(*(range(s, min(n, s + gru_toxicity.WINDOW)) for s in starts))
        assert covered == set(range(n)) and all(b - a < gru_toxicity.WINDOW for a, b in zip(starts, starts[1:]))


def test_toxicity_rows(spark, odd, nothing):
    docs, labels = documents(spark, SF), table(spark, SF, "labels")
    net = gru_toxicity.fit(docs, labels)
    got = gru_toxicity.toxicity(docs, net).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in held]) > 0.9
    rows = gru_toxicity.toxicity(odd, net).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score < 0.5 for r in rows if r.doc_id in (4, 5, 6))
    assert gru_toxicity.toxicity(nothing, net).collect() == []
    again = odd.select(gru_toxicity.toxicity_column(net).alias("s")).collect()
    assert sorted(r.s for r in again) == pytest.approx(sorted(r.score for r in rows))
    assert gru_toxicity.fit(odd, labels.where("false")).constant == 0.0


# n-gram model


def brute_model(train):
    """The model's formulas on dictionaries."""
    text = [[w for w in re.split(r"[\x20\x09-\x0D]+", low(t)) if w] + ["</s>"] for t in train]
    uni, pairs = Counter(w for ws in text for w in ws), Counter(p for ws in text for p in zip(["<s>", *ws], ws))
    before, after = Counter(w for _, w in pairs), {}
    for (h, _), c in pairs.items():
        a = after.setdefault(h, [0, 0, 0, 0])
        a[0] += c
        a[min(c, 3)] += 1

    def cuts(values):
        v = list(values)
        n = [sum(x == k for x in v) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        raw = [1 - 2 * y * n[1] / n[0] if n[0] else 0, 2 - 3 * y * n[2] / n[1] if n[1] else 0, 3 - 4 * y * n[3] / n[2] if n[2] else 0]
        return [0] + [min(max(d, 0), k) for k, d in enumerate(raw, 1)]

    dp, dw = cuts(pairs.values()), cuts(before.values())
    rest = sum(dw[min(c, 3)] for c in before.values()) / len(pairs)

    def lower(w):
        return (before[w] - dw[min(before[w], 3)]) / len(pairs) + rest / (len(uni) + 1)

    def prob(h, w):
        if h not in after:
            return lower(w)
        total, *n = after[h]
        c = pairs[h, w]
        return (c - dp[min(c, 3)]) / total + sum(d * k for d, k in zip(dp[1:], n)) / total * lower(w)

    return uni, prob


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_scores_equal_the_formulas(spark, odd, nothing):
    rows = [(k, prose(k % 7, 40 + k) + (" new%d" % k) * (k % 3)) for k in range(40)] + TEXTS
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    uni, prob = brute_model([t for i, t in rows if not held(i)])
    n, v = sum(uni.values()), len(uni)
    want = []
    for i, t in rows:
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", low(t)) if w] + ["</s>"]
        want.append((str(i), held(i), len(ws), sum(w in uni for w in ws), n,
                     round(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws), 6),
                     round(sum(math.log10(prob(h, w)) for h, w in zip(["<s>", *ws], ws)), 6)))
    got = kneser_ney.held_out_scores(df).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4]) for r in got) == sorted(w[:5] for w in want)
    for g, w in zip(sorted((str(r[0]), r[2], r[5], r[6]) for r in got), sorted((w[0], w[2], w[5], w[6]) for w in want)):
        assert abs(g[2] - w[2]) < 1e-4 and abs(g[3] - w[3]) < 1e-4
    every = sum(prob("the", w) for w in uni) + prob("the", "unseen word")
    assert every == pytest.approx(1, abs=1e-9)
    assert kneser_ney.held_out_scores(nothing).collect() == []


def test_no_training_rows(spark, odd):
    path, meta = kneser_ney.train(odd.where("false"))
    got = kneser_ney.score(odd.where("doc_id = 7"), path, meta).first()
    assert (got.n_tokens, got.n_known, got.score, got.base_score) == (3, 0, 0.0, 0.0)


def test_a_lost_file_of_the_model_is_an_error(spark, odd):
    """Words, pairs or the whole folder: never scores as if the words were unknown."""
    import glob
    import os

    path, meta = kneser_ney.train(odd)
    folder = kneser_ney.local_form(path)
    rows = odd.where("doc_id = 0")
    want = kneser_ney.score(rows, path, meta).first()
    assert want.n_known > 0
    for kind in ("words", "pairs", "contexts", "before"):
        k = meta["written"][kind][0]
        name = os.path.join(folder, f"{kind}-{k}.npy")
        os.rename(name, name + ".away")
        with pytest.raises(Exception, match="No such file"):
            kneser_ney.score(rows, path, meta | {"ready": f"without-{kind}"}).collect()
        os.rename(name + ".away", name)
    assert kneser_ney.score(rows, path, meta | {"ready": "again"}).first() == want
    assert len(glob.glob(os.path.join(folder, "*.npy"))) == sum(map(len, meta["written"].values()))
    with pytest.raises(Exception, match="No such file"):
        kneser_ney.score(rows, path + "-absent", meta).collect()
