"""Jaccard components against all pairs, with caps of the salting and pairing lowered too."""

import zlib

import numpy as np
import pytest

from attrix.llm import jaccard_groups
from attrix.llm.common import id_and_bytes
from attrix.llm.components import connected_components

from odd_cases import TEXTS, prose


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    s = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(s[a] & s[b])
            if n and 100 * n >= 75 * (len(s[a]) + len(s[b]) - n):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((str(i), len(s[k]), str(min(ids) if ids else None) if s[k] else str(i)))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_groups.jaccard_components(df).collect())


def test_odd_documents(odd, nothing):
    assert result(odd) == brute(TEXTS)
    assert jaccard_groups.jaccard_components(nothing).collect() == []


@pytest.mark.parametrize("salt,paired", [(1 << 20, 4096), (2, 4096), (1 << 20, 1)])
def test_groups_of_edited_copies(spark, odd, monkeypatch, salt, paired):
    """Copies with growing edits form chains of links; shared passages tie unlike documents' prefixes."""
    monkeypatch.setattr(jaccard_groups, "SALT_FROM", salt)
    monkeypatch.setattr(jaccard_groups, "PAIRED", paired)
    rows, passage = [], prose(99, 40)
    for g in range(5):
        words = prose(g, 150).split()
        for k in range(12):
            rows.append((len(rows), " ".join(words)))
            at = (k * 37) % len(words)
            words[at:at + 3] = [f"edit{g}x{k}"]
    rows += [(len(rows) + k, passage + " " + prose(200 + k, 20)) for k in range(15)]
    rows += [(1000 + k, rows[k * 7][1].upper()) for k in range(8)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == brute(rows)


def test_components_of_chains_and_stars(spark, odd):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(300, 300), (None, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 160)}}


def test_order_sketch_counts_every_shingle(spark, odd):
    got = jaccard_groups._order_sketch(id_and_bytes(odd), jaccard_groups.WORDS)
    want = np.zeros(jaccard_groups.SKETCH, np.int64)
    for _, text in TEXTS:
        low = jaccard_groups.shingle_hashes((text or "").encode()) & np.uint64(jaccard_groups.SKETCH - 1)
        np.add.at(want, low.astype(np.int64), 1)
    assert (got == want).all()


def test_sketch_rows_reach_the_driver_small():
    """A row of few counts takes little of the driver's memory, however many counters it has."""
    counts = np.zeros(jaccard_groups.CHUNK, "<u8")
    counts[[3, 70, 4000]] = 1, 300, 2**30
    row = jaccard_groups._packed(jaccard_groups._planes(counts))
    assert len(row) < counts.nbytes // 100
    back = jaccard_groups._from_planes(zlib.decompress(row), np.dtype("<u4"))
    assert back.tolist() == np.minimum(counts, 2**24 - 1).tolist()
