"""Merkle manifest and line bitmaps against plain versions of their rules."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from attrix.llm import line_bitmaps, merkle_manifest

from odd_cases import TEXTS, prose


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k:k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def steps(levels, place):
    """(siblings before, siblings after) of the node's run, level by level."""
    for level in levels[:-1]:
        run = place // 2 * 2
        yield level[run:place], level[place + 1:run + 2]
        place //= 2


def brute_manifest(rows):
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = sha(*map(field, (doc_id, source, lang, n_chars, text)))
        changed = None
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
            changed = sha(*map(field, (doc_id, source, lang, None if n_chars is None else n_chars + 1, text)))
        trees[lang].append((doc_id is not None, doc_id or 0, leaf, changed))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {k: levels_of([t[2] for t in sorted(trees[k], key=lambda t: t[:3])]) for k in order}
    top = levels_of([built[k][-1][0] for k in order])
    out = []
    for at, k in enumerate(order):
        for place, (known, doc_id, leaf, changed) in enumerate(sorted(trees[k], key=lambda t: t[:3])):
            proof, folded = [], changed or leaf
            for before, after in [*steps(built[k], place), *steps(top, at)]:
                proof += before + after
                folded = sha(*before, folded, *after)
            out.append((str(doc_id if known else None), leaf, built[k][-1][0], top[-1][0], sha(*proof), folded, folded == top[-1][0]))
    return sorted(out)


def rows_of(df, block=10):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
                  for r in merkle_manifest.proofs(df, block).collect())


def test_path_copies_share_what_they_do_not_touch():
    rnd = random.Random(1)
    for n, levels in ((1, 0), (2, 1), (5, 3), (8, 3), (9, 4), (3, 4)):
        leaves = [rnd.randbytes(32) for _ in range(n)]
        tree = merkle_manifest.PathTree(leaves, levels)
        versions = [(tree.root, list(leaves))]
        for _ in range(12):
            base, held = rnd.choice(versions)
            place, leaf, size = rnd.randrange(n), rnd.randbytes(32), len(tree.digest)
            root = tree.update(place, leaf, base)
            assert len(tree.digest) == size + levels + 1
            assert all(a == b or b >= size for a, b in zip(tree.path(place, base), tree.path(place, root)))
            versions.append((root, [leaf if k == place else x for k, x in enumerate(held)]))
        for root, held in versions:
            assert tree.digest[root] == merkle_manifest.PathTree(held, levels).digest[-1]
            for place in range(n):
                path, alone = tree.siblings(place, root)
                assert merkle_manifest.folded_root(held[place], path, alone, place, levels) == tree.digest[root]


@pytest.mark.parametrize("block", [1, 2, 10])
def test_manifest_equals_brute_force(spark, odd, block):
    """Blocks of two and four nodes make many rounds, on both sides of a language's root."""
    rnd = random.Random(block)
    langs = [None, "", "a", "b", "é", "zz", "Z"]
    rows = [(k if rnd.random() < 0.95 else None, rnd.choice([None, "", "x", "text é"]), langs[min(6, int(rnd.expovariate(0.6)))],
             rnd.choice([None, "s"]), rnd.choice([None, 0, 9, 99])) for k in range(150)]
    rows += rows[:20] + [(7, "other", "a", "s", 1), (7, "more", "a", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert rows_of(df, block) == brute_manifest(rows)


def test_manifest_of_odd_tables(spark, odd, nothing):
    assert rows_of(odd) == brute_manifest([(i, t, "en", "s", 1) for i, t in TEXTS])
    assert rows_of(nothing) == []
    one = [(14, "t", None, None, 2**63 - 1)]
    got = rows_of(spark.createDataFrame(one, "doc_id long, text string, lang string, source string, n_chars long"))
    assert got == brute_manifest(one)


def brute_lines(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    having = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None:
                having[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(having[key(x)]) < 3 or i == max(having[key(x)])]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def kept_of(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in line_bitmaps.without_repeated_lines(df).collect())


def lines_table(seed, n=60):
    rnd = random.Random(seed)
    pool = [prose(k, 6) for k in range(30)] + ["é" * 19, "É" * 20, "short", "", "\x85" + "w" * 25, "x" * 20]
    def line():  # noqa: E306
        x = pool[min(len(pool) - 1, int(rnd.expovariate(0.12)))]
        return rnd.choice(["", " ", "\t\x0b", "\x0c"]) + (x.upper() if rnd.random() < 0.3 else x) + rnd.choice(["", "\r", "  "])
    rows = [(rnd.randrange(-5, 40) if rnd.random() < 0.9 else None, "\n".join(line() for _ in range(rnd.randint(0, 12)))) for _ in range(n)]
    return rows + rows[:4] + [(3, None), (500, "\n".join([prose(1, 6)] * 300)), (501, "a line of its own, long enough\n" * 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_lines_equal_brute_force(spark, odd, seed):
    rows = lines_table(seed)
    assert kept_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute_lines(rows)


def test_lines_of_odd_tables(odd, nothing):
    assert kept_of(odd) == brute_lines(TEXTS)
    assert kept_of(nothing) == [] and line_bitmaps.keep_bitmaps(nothing).collect() == []


@pytest.mark.parametrize("ranges,batch", [(1, 1000), (3, 7), (9, 1), (40, 3)])
def test_ranges_and_batches_change_no_mark(ranges, batch):
    """Keys that span batches and ranges, cut at any row."""
    rnd = random.Random(ranges)
    rows = sorted({(rnd.randrange(6), 0, rnd.choice([None, *range(5)]), rnd.randrange(2), rnd.randrange(9)) for _ in range(400)} |
                  {(9, 9, d, 0, p) for d in (None, 4, 6) for p in range(80)},
                  key=lambda r: (r[0], r[1], r[2] is None, -(r[2] or 0), r[3], r[4]))
    cuts = sorted(rnd.sample(range(1, len(rows)), ranges - 1))
    marks = []
    for part in [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]:
        batches = [pa.RecordBatch.from_pylist(
            [dict(zip(("h1", "h2", "doc_id", "row", "pos"), r)) for r in part[k:k + batch]],
            schema=pa.schema([f for f in line_bitmaps._MARKS if f.name != "kind"])) for k in range(0, len(part), batch)]
        for out in line_bitmaps.stream_range(iter(batches)):
            marks += [tuple(m.values()) for m in out.to_pylist()]
    having, edge = defaultdict(set), defaultdict(set)
    for h1, h2, doc, _, _ in rows:
        having[h1, h2] |= {doc} - {None}
    for kind, h1, h2, doc, _, _ in marks:
        if kind == line_bitmaps.EDGE:
            edge[h1, h2].add(doc)
    gone = sorted([m[1:] for m in marks if m[0] == line_bitmaps.DROP] + [
        m[1:] for m in marks if m[0] == line_bitmaps.OPEN and len(edge[m[1:3]]) >= 3 and m[3] != max(edge[m[1:3]])], key=str)
    assert gone == sorted([r for r in rows if len(having[r[:2]]) >= 3 and r[2] != max(having[r[:2]])], key=str)


def test_bitmaps_round_trip():
    rnd = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 200):
        gone = rnd.choice(n, max(1, n // 3), replace=False)
        text = "\n".join(map(str, range(n)))
        assert line_bitmaps.kept_lines(text, line_bitmaps.bitmap(gone)) == "\n".join(str(k) for k in range(n) if k not in gone)
