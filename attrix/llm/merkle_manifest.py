"""Operator 11: Merkle manifest of a table, with proofs and versions by a persistent path-copying tree.

H is the lowercase hex SHA-256 of its inputs' concatenation, digests as hex text. Each row is a leaf, H of its columns. Per
language the leaves ascend by document id, and every two consecutive nodes (the last may be alone) become their H until one
is left, the language's subroot. Subroots, ordered by language, give the root the same way.

Leaves get their place by one range partitioning (language, id, leaf) and counts a range. A tree is cut into aligned blocks of
2 ** ``BLOCK_LEVELS`` nodes; each block is a task's group, gives every node's siblings within the block and the block's root,
and the block roots are the nodes of the next round. So no group is larger than a block, whatever share of the rows one
language has. In a leaf block a ``PathTree`` holds the nodes; a tampered leaf makes a version that copies its ancestors within
the block and shares all else, and the version goes on above the block with the siblings of the block's own path, joined
on (language, block). Upper paths are few: one row a block.

Rows of the same id are ordered by their leaf; equal rows are told apart by their place alone. A null id comes first and is
never tampered with; a null language is a tree of its own, before all others; a null number of characters stays null. A tree of one
leaf has no siblings: its subroot is the leaf. Very long texts are hashed whole. An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrix.llm.common import stored

#: Levels of an aligned block: 1024 nodes.
BLOCK_LEVELS = 10
TAMPER_MODULUS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class PathTree:
    """A binary hash tree over up to 2 ** levels leaves, with versions that share nodes.

    Nodes are never changed. ``update`` copies the ancestors of one leaf and returns the new version's root node.
    """

    def __init__(self, leaves: list[bytes], levels: int):
        self.digest: list[bytes] = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        level, self.levels = list(range(len(leaves))), levels
        for _ in range(levels):
            level = [self._node(*level[k:k + 2]) for k in range(0, len(level), 2)]
        self.root = level[0]

    def _node(self, *children: int) -> int:
        self.digest.append(_hash(*[self.digest[c] for c in children]))
        self.children.append(children)
        return len(self.digest) - 1

    def path(self, place: int, root: int | None = None) -> list[int]:
        """The nodes from the root of a version down to the leaf at ``place``."""
        at = [self.root if root is None else root]
        for level in range(self.levels - 1, -1, -1):
            at.append(self.children[at[-1]][(place >> level) & 1])
        return at

    def update(self, place: int, leaf: bytes, root: int | None = None) -> int:
        """A version in which the leaf at ``place`` is ``leaf``: its root. Only the leaf and its ancestors are new nodes."""
        old = self.path(place, root)
        self.digest.append(leaf)
        self.children.append(())
        new = len(self.digest) - 1
        for level, above in enumerate(reversed(old[:-1])):
            side = (place >> level) & 1
            kids = list(self.children[above])
            kids[side] = new
            new = self._node(*kids)
        return new

    def siblings(self, place: int, root: int | None = None) -> tuple[bytes, int]:
        """The siblings' digests from the leaf upwards, and a bit for each level at which the node is alone."""
        nodes, out, alone = self.path(place, root), [], 0
        for level, above in enumerate(reversed(nodes[:-1])):
            kids = self.children[above]
            if len(kids) == 1:
                alone |= 1 << level
            else:
                out.append(self.digest[kids[1 - ((place >> level) & 1)]])
        return b"".join(out), alone


def folded_root(digest: bytes, path: bytes, alone: int, place: int, levels: int) -> bytes:
    """The digest ``levels`` above a node, from its own digest and its packed siblings."""
    at = 0
    for level in range(levels):
        if (alone >> level) & 1:
            digest = _hash(digest)
            continue
        sibling, at = path[at:at + 32], at + 32
        digest = _hash(sibling, digest) if (place >> level) & 1 else _hash(digest, sibling)
    return digest


_NODES = ("tree string, pos long, label string, hash binary, changed binary, todo int, path binary, alone long, left long, "
          "levels int, folded binary, top boolean")
_PATH = ("path", "alone", "left", "levels")


def climb_block(frame: pd.DataFrame, block_levels: int) -> pd.DataFrame:
    """One aligned block: its nodes with their siblings in the block, and a last row with its root for the next round.

    ``folded`` is the block's root in the version that the changed digest makes, or recomputed from the node's own digest.
    """
    frame = frame.sort_values("pos", ignore_index=True)
    tree, todo, block = frame["tree"].iloc[0], int(frame["todo"].iloc[0]), int(frame["pos"].iloc[0]) >> block_levels
    levels = min(block_levels, todo)
    kept = PathTree(frame["hash"].tolist(), levels)
    rows = []
    for place, (own, changed) in enumerate(zip(frame["hash"], frame["changed"])):
        path, alone = kept.siblings(place)
        folded = folded_root(own, path, alone, place, levels) if changed is None else kept.digest[kept.update(place, changed)]
        rows.append((path, alone, place & ((1 << levels) - 1), levels, folded, False))
    out = pd.concat([frame[["tree", "pos", "label", "hash", "changed", "todo"]],
                     pd.DataFrame(rows, columns=[*_PATH, "folded", "top"])], axis=1)
    last = (tree, block, None, kept.digest[kept.root], None, todo - levels, b"", 0, 0, 0, None, True)
    return pd.concat([out, pd.DataFrame([last], columns=out.columns)], ignore_index=True)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos, the place within ``tree`` by ``order``, and todo, the levels of its tree, as a stored table."""
    ranges = rows.repartitionByRange("tree", *order).withColumn("range", F.spark_partition_id())
    ranges, _ = stored(rows.sparkSession, ranges, "merkle-ranges")
    counts = ranges.groupBy("tree", "range").agg(F.count("*").alias("n"))
    w = Window.partitionBy("tree")
    offsets = counts.select("tree", "range", (F.sum("n").over(w.orderBy("range")) - F.col("n")).alias("before"),
                            F.sum("n").over(w).alias("size"))
    numbered = ranges.withColumn("pos", F.row_number().over(Window.partitionBy("tree", "range").orderBy(*order)) - 1)
    # levels until one is left: the bits of size - 1
    todo = F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0)
    placed = numbered.join(offsets, ["tree", "range"]).withColumns(
        {"pos": (F.col("pos") + F.col("before")).cast("long"), "todo": todo.cast("int")}).drop("range", "before", "size")
    return stored(rows.sparkSession, placed, "merkle-placed")[0]


def _continued(lower: DataFrame, upper: DataFrame, on: list[str]) -> DataFrame:
    """``lower`` with its paths continued by those of ``upper``, where that has a row."""
    up = upper.select(*on, *[F.col(c).alias(f"up_{c}") for c in _PATH], *[c for c in upper.columns if c not in (*on, *_PATH)])
    shifted = lambda c: F.col(c).bitwiseOR(F.expr(f"shiftleft(coalesce(up_{c}, 0L), levels)"))
    return lower.join(up, on, "left").withColumns({
        "path": F.concat("path", F.coalesce("up_path", F.lit(b""))), "alone": shifted("alone"), "left": shifted("left"),
        "levels": F.col("levels") + F.coalesce("up_levels", F.lit(0))}).drop(*[f"up_{c}" for c in _PATH])


def climb(nodes: DataFrame, block_levels: int = BLOCK_LEVELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (tree, pos, label, hash, changed, todo) with the path within their block; the blocks (tree, block) with the path
    from there to their tree's root; and the roots (tree, hash)."""
    rounds, tops, roots = [], [], []
    most, current = nodes.agg(F.max("todo").alias("m")).first()["m"] or 0, nodes
    while not rounds or most > 0:
        blocks = current.groupBy("tree", F.shiftright("pos", block_levels).alias("block"))
        done, _ = stored(nodes.sparkSession, blocks.applyInPandas(lambda b: climb_block(b, block_levels), _NODES), "merkle-nodes", ["top"])
        rounds.append(done.where("not top").withColumn("block", F.shiftright("pos", block_levels)))
        tops.append(done.where("top"))
        roots.append(tops[-1].where("todo <= 0").select("tree", "hash"))
        current = tops[-1].where("todo > 0").select("tree", "pos", "label", "hash", "changed", "todo")
        most -= block_levels
    above = None
    for level in reversed(rounds[1:]):
        level = level.select("tree", "pos", "block", *_PATH)
        above = level if above is None else _continued(level, above, ["tree", "block"])
        above = above.select("tree", F.col("pos").alias("block"), *_PATH)
    upper = tops[0].select("tree", F.col("pos").alias("block"), *_PATH)
    return rounds[0], upper if above is None else _continued(upper, above, ["tree", "block"]), reduce(DataFrame.unionByName, roots)


def fold(start: Column, path: Column, alone: Column, left: Column, levels: Column) -> Column:
    """The hex root that a digest (hex) and its packed siblings give; a set bit of ``left`` has the sibling on the left."""

    def step(acc: Column, k: Column) -> Column:
        own, single = acc["digest"], F.getbit(alone, k) == 1
        sibling = F.lower(F.hex(F.substring(path, acc["at"], F.lit(32))))
        joined = F.when(single, own).when(F.getbit(left, k) == 1, F.concat(sibling, own)).otherwise(F.concat(own, sibling))
        return F.struct(F.sha2(joined, 256).alias("digest"), (acc["at"] + F.when(single, 0).otherwise(32)).alias("at"))

    steps = F.when(levels > 0, F.sequence(F.lit(0), levels - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.struct(start.alias("digest"), F.lit(1).alias("at")), step, lambda acc: acc["digest"])


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    """The hex digest of a row: each field as byte count, colon and text, or ``-`` for null."""
    return F.sha2(F.concat(*[_field(f) for f in fields]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, and the leaf of the tampered row (one character more) where 7 divides the id's crc32."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    more = (n_chars.cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    tampered = F.crc32(doc_id.cast("string").cast("binary")) % TAMPER_MODULUS == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit("")).alias("tree"), doc_id.cast("long").alias("doc_id"),
        F.unhex(leaf_digest([doc_id, source, lang, n_chars, text])).alias("leaf"),
        F.when(tampered, F.unhex(leaf_digest([doc_id, source, lang, more, text]))).alias("changed"),
    )


def manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row for each row of ``docs``: place of its leaf, all digests, the packed proof (siblings from the leaf to the root),
    and the root folded from the tampered (else own) leaf with the original siblings."""
    spark = docs.sparkSession
    rows, _ = stored(spark, leaves(docs).withColumn("nth", F.monotonically_increasing_id()), "merkle-leaves")
    placed = _placed(rows, ["doc_id", "leaf", "nth"])
    nodes, blocks, subroots = climb(placed.select(
        "tree", "pos", F.col("doc_id").cast("string").alias("label"), F.col("leaf").alias("hash"), "changed", "todo"), block_levels)
    trees = _placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("label"), "hash"), ["label"])
    tops, above, root = climb(trees.withColumn("changed", F.lit(None).cast("binary")), block_levels)
    tops = _continued(tops.select("tree", "block", "label", "hash", *_PATH), above, ["tree", "block"]).crossJoin(  # one row
        root.select(F.col("hash").alias("root")))
    tops = tops.select(F.col("label").alias("tree"), F.col("hash").alias("subroot"), "root", *_PATH)
    upper = _continued(blocks.select("tree", "block", *_PATH), tops, ["tree"])
    upper = upper.select("tree", "block", "subroot", "root", *[F.col(c).alias(f"upper_{c}") for c in _PATH])
    hexed = lambda c: F.lower(F.hex(c))
    return nodes.join(upper, ["tree", "block"]).select(
        F.col("label").cast("long").alias("doc_id"), F.expr("if(tree = '', null, substring(tree, 2))").alias("lang"), "pos",
        hexed("hash").alias("leaf"), hexed("changed").alias("tampered_leaf"), hexed("subroot").alias("subroot"),
        hexed("root").alias("root"), F.concat("path", "upper_path").alias("proof"),
        fold(hexed("folded"), *[F.col(f"upper_{c}") for c in _PATH]).alias("folded_root"))


def proofs(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    return manifest(docs, block_levels).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
