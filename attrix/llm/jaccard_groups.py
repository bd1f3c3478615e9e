"""Operator 8: exact n-gram Jaccard components by a grouped prefix join.

A document's set holds its distinct word shingles; two documents link when 100 * |A n B| >= 75 * |A u B|.

1. Every shingle adds to a fixed-size sketch of counters (all documents). The sketch only orders shingles, rare
   before frequent; any order that all documents share gives the same links.
2. Each document's prefix is what it must share a shingle of with any partner. Documents of identical prefix and
   size form one group, and one entry (token, group, size, shingles left from this position) stands for all of it.
   Entries travel as sorted binary blobs to shards by token; a shard keeps tokens that two groups share. Very
   frequent tokens are dealt over several shards.
3. A shard links each group of a token with one pivot group. Of these candidate pairs (as many as entries at most)
   those whose prefixes share as much as links need, and those between the sets of one group and its first set, are
   verified on whole sets.
4. The rest of the candidates (every pair of a token that passes the size and position bounds) comes from a join of
   the entries on the token, without pairs whose sets are already in one component. So a large group of near copies
   costs about as many pairs as it has members, and no link between components is lost.
5. Links give connected components; every document of a set gets the component's smallest document id.

Defined cases: a null or wordless text has an empty set, links with nothing and is its own component; under five
words the whole word sequence is the one shingle; repeated rows and exact copies share a set; a null id takes the
smallest id of its component's other rows, or null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import drop_path, hold, id_and_bytes, input_partitions, mix64, scratch, signed, stored, text_runs
from attrix.llm.components import connected_components

WORDS = 5            # words of a shingle
PERCENT = 75         # least similarity, in percent
SKETCH = 1 << 22     # counters of the order sketch
CHUNK = 1 << 12      # counters of one sketch row
PAIRED = 4096        # entries of a token up to which partners are looked for one by one
BROADCAST_IDS = 500_000  # ids of wanted sets that are broadcast at most
RUN_BYTES = 1 << 22  # bytes of texts whose sets go back together
SALT_FROM = 1 << 20  # tokens that may be this frequent are dealt over several shards

_MULTIPLIERS = np.array([2 * k * 0x9E3779B97F4A7C15 % 2**64 | 1 for k in range(3, 3 + 64)], dtype=np.uint64)
_ENTRY = np.dtype([("token", "<u8"), ("group", "<u8"), ("n", "<u4"), ("left", "<u4")])
_MEMBER = np.dtype([("group", "<u8"), ("set", "<u8"), ("n", "<u4"), ("known", "<u4"), ("doc", "<i8")])


def _nothing() -> None:
    """This operator keeps nothing in a worker."""


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text (UTF-8; A-Z in lower case)."""
    parts = text.lower().split()
    a = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    if len(a) == 0:
        return a
    width = min(words, len(a))
    n = len(a) - width + 1
    h = np.full(n, np.uint64(width))
    for k in range(width):
        h += a[k:k + n] * _MULTIPLIERS[k % 64]
    return np.unique(mix64(h))


def set_hash(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def _planes(a: np.ndarray) -> bytes:
    """Byte planes of a structured array: leading zero bytes lie together, so the shuffle's compression takes them."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def _from_planes(b: bytes, kind: np.dtype) -> np.ndarray:
    n = len(b) // kind.itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def _sketch_rows(counts: np.ndarray, salt: int) -> pd.DataFrame:
    live = np.flatnonzero(counts.reshape(-1, CHUNK).any(axis=1))
    rows = counts.astype("<u8").reshape(-1, CHUNK)
    return pd.DataFrame({"chunk": live.astype("int32"), "salt": salt,
                         "counts": [_planes(rows[k].copy()) for k in live]})


def _packed(counts: bytes) -> bytes:
    """A finished sketch row on its way to the driver: counters of 4 bytes, compressed."""
    return zlib.compress(_planes(np.minimum(_from_planes(counts, np.dtype("<u8")), 2**24 - 1).astype("<u4")), 1)


def _order_sketch(texts: DataFrame, words: int) -> np.ndarray:
    """Counts of shingles by the low bits of their hash over all documents; fixed size, summed in two levels."""
    salts = max(1, -(-input_partitions(texts) // 256))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        hold("jaccard_groups", _nothing)
        total = np.zeros(SKETCH, np.int64)
        for frame in frames:
            rows = frame["text"].tolist()
            for start, stop in text_runs(rows, RUN_BYTES):
                low = np.concatenate([shingle_hashes(t, words) for t in rows[start:stop]]) & np.uint64(SKETCH - 1)
                place, n = np.unique(low, return_counts=True)
                total[place] += n
        yield _sketch_rows(total, TaskContext.get().partitionId() % salts)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for chunk, counts in zip(frame["chunk"], frame["counts"]):
                got = _from_planes(counts, np.dtype("<u8"))
                sums[chunk] = sums[chunk] + got if chunk in sums else got
        yield pd.DataFrame({"chunk": np.array(list(sums), "int32"), "salt": np.zeros(len(sums), "int32"),
                            "counts": [_planes(v) for v in sums.values()]})

    schema = "chunk int, salt int, counts binary"
    rows = texts.select("text").mapInPandas(count, schema)
    for keys in (["chunk", "salt"], ["chunk"]) if salts > 1 else (["chunk"],):
        rows = rows.repartition(*keys).mapInPandas(add, schema)
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"chunk": frame["chunk"], "counts": [_packed(b) for b in frame["counts"]]})

    out = np.zeros((SKETCH // CHUNK, CHUNK), np.uint32)
    # at most 4 bytes for each of SKETCH counters at any input size, most of them zero bytes that compress away
    for row in rows.mapInPandas(pack, "chunk int, counts binary").toLocalIterator():
        out[row["chunk"]] = _from_planes(zlib.decompress(row["counts"]), np.dtype("<u4"))
    return out.reshape(-1)


def _prefix_length(n: np.ndarray | int, percent: int):
    return n - -(-percent * n // 100) + 1


def _may_link(left_a, n_a, left_b, n_b, percent: int):
    """Whether the shingles left from the first common one can reach the overlap that the similarity needs."""
    return (100 + percent) * np.minimum(left_a, left_b) >= percent * (n_a + n_b)


def _has_partner(n: np.ndarray, left: np.ndarray, start: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Entries that may link with another entry of their token; entries lie token by token.

    Of tokens with over PAIRED entries, all that could link with one like themselves stay, which is more than needed.
    """
    stay = np.zeros(len(n), bool)
    two = start[size == 2]
    hit = two[_may_link(left[two], n[two], left[two + 1], n[two + 1], percent)]
    stay[hit] = stay[hit + 1] = True
    for s, k in zip(start[size > 2].tolist(), size[size > 2].tolist()):
        own_n, own_left = n[s:s + k], left[s:s + k]
        if k > PAIRED:
            reach = (100 + percent) * own_left - percent * own_n
            stay[s:s + k] = (reach >= percent * own_n.min()) & (reach.max() >= percent * own_n)
            continue
        for at in range(0, k, 256):
            some = np.arange(at, min(at + 256, k))
            may = _may_link(own_left[some, None], own_n[some, None], own_left, own_n, percent)
            may[np.arange(len(some)), some] = False
            stay[s + some] = may.any(axis=1)
    return stay


def _entry_rows(texts: DataFrame, sketch, shards: int, words: int, percent: int) -> DataFrame:
    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("jaccard_groups", _nothing)
        for frame in frames:
            ids, rows = frame["doc_id"].astype("Int64").tolist(), frame["text"].tolist()
            for start, stop in text_runs(rows, RUN_BYTES):
                yield blobs_of(ids[start:stop], rows[start:stop])

    def blobs_of(ids: list, rows: list[bytes]) -> pd.DataFrame:
        counts = sketch.value
        entries, members = [], np.zeros(len(rows), _MEMBER)
        for k, (doc, text) in enumerate(zip(ids, rows)):
            s = shingle_hashes(text, words)
            n = len(s)
            group = 0
            if n:
                c = counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64)
                key = np.sort((c << np.uint64(40)) | (s >> np.uint64(24)))[: _prefix_length(n, percent)]
                group = xxhash.xxh3_64_intdigest(key.tobytes() + n.to_bytes(8, "little"))
                e = np.zeros(len(key), _ENTRY)
                e["token"], e["group"], e["n"], e["left"] = key, group, n, n - np.arange(len(key))
                entries.append(e)
            known = not pd.isna(doc)
            members[k] = (group, set_hash(s) if n else 0, n, known, int(doc) if known else 0)
        blobs = []
        if entries:
            e = np.unique(np.concatenate(entries))  # one entry for all copies here
            salts = 1 + (e["token"] >> np.uint64(40)) // np.uint64(SALT_FROM)
            shard = mix64(e["token"] * np.uint64(0x9E3779B97F4A7C15) + e["group"] % salts) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            shard, e = shard[order], e[order]
            cuts = np.flatnonzero(np.diff(shard)) + 1
            blobs = [(int(shard[at]), 0, _planes(part)) for at, part in
                     zip(np.concatenate([[0], cuts]), np.split(e, cuts))]
        if len(members):
            at = int(mix64(members["set"][:1] + np.uint64(len(members)))[0] % np.uint64(shards))
            blobs.append((at, 1, _planes(members)))
        return pd.DataFrame(blobs, columns=["shard", "kind", "blob"]).astype({"shard": "int64", "kind": "int32"})

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in frame.loc[frame["kind"] == 1, "blob"]:
            m = _from_planes(b, _MEMBER)
            out.append(pd.DataFrame({"kind": 2, "a": signed(m["group"].copy()), "b": signed(m["set"].copy()),
                                     "n": m["n"].astype("int64"), "r": m["known"].astype("int64"),
                                     "doc_id": m["doc"]}))
        blobs = [_from_planes(b, _ENTRY) for b in frame.loc[frame["kind"] == 0, "blob"]]
        if blobs:
            e = np.unique(np.concatenate(blobs))
            start = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1]]))
            size = np.diff(np.concatenate([start, [len(e)]]))
            n, left = e["n"].astype(np.int64), e["left"].astype(np.int64)
            whole = e["token"] >> np.uint64(40) < np.uint64(SALT_FROM)  # all entries of the token are here
            stay = ~whole | _has_partner(n, left, start, size, percent)
            # pivot: the entry nearest to the front of its set, so that it may link with the most others
            front = np.lexsort((e["group"], -(left / n), np.repeat(np.arange(len(start)), size)))[start]
            pivot = np.repeat(front, size)
            pair = _may_link(left, n, left[pivot], n[pivot], percent) & (e["group"] != e["group"][pivot])
            g, p = signed(e["group"].copy()), signed(e["group"][pivot])
            pairs = np.unique(np.stack([np.minimum(g, p)[pair], np.maximum(g, p)[pair]], axis=1), axis=0)
            out.append(pd.DataFrame({"kind": 1, "a": pairs[:, 0], "b": pairs[:, 1], "n": 0, "r": 0, "doc_id": 0}))
            # entries without a possible partner here (r below 0) only count towards what two prefixes share
            met = ~whole | (np.repeat(size, size) > 1)
            out.append(pd.DataFrame({"kind": 0, "a": signed(e["token"][met]), "b": g[met], "n": n[met],
                                     "r": np.where(stay, left, -left)[met], "doc_id": 0}))
        schema = {"kind": "int32", "a": "int64", "b": "int64", "n": "int64", "r": "int64", "doc_id": "int64"}
        empty = pd.DataFrame({k: np.zeros(0, v) for k, v in schema.items()})
        return pd.concat([*out, empty], ignore_index=True).astype(schema)[list(schema)]

    rows = texts.mapInPandas(emit, "shard long, kind int, blob binary")
    return rows.groupBy("shard").applyInPandas(meet, "kind int, a long, b long, n long, r long, doc_id long")


def _plausible(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose groups (columns ga, gb) share as many prefix shingles as linked ones must.

    Of two linked sets, the prefix that ends first in the common order lacks at most n - overlap of its shingles in the
    other set, and those it shares are in the other's prefix as well. Two are given away for equal order keys.
    """
    one, two = (prefixes.select(F.col("group").alias(g), F.col("n").alias(n), F.col("tokens").alias(t))
                for g, n, t in (("ga", "na", "ta"), ("gb", "nb", "tb")))
    overlap = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    least = [overlap - F.ceil(percent * F.col(n) / 100) - 1 for n in ("na", "nb")]
    shared = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(one, "ga").join(two, "gb").where(
        (F.col("ga") == F.col("gb")) | (shared >= F.greatest(F.lit(1), F.least(*least)))).select(*pairs.columns)


def _whole_sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of the wanted sets (node, rep, times), from the rows with their representative ids."""
    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, rows = frame["doc_id"].astype("Int64").tolist(), frame["text"].tolist()
            for start, stop in text_runs(rows, RUN_BYTES):
                got = [(i, shingle_hashes(t, words)) for i, t in zip(ids[start:stop], rows[start:stop])]
                got = [(i, x) for i, x in got if len(x)]
                yield pd.DataFrame({"doc_id": pd.array([i for i, _ in got], "Int64"),
                                    "node": np.array([set_hash(x) for _, x in got], np.uint64).view(np.int64),
                                    "hashes": pd.Series([signed(x) for _, x in got], dtype=object)})

    wanted, path = stored(texts.sparkSession, wanted.select("node", "rep", "times").distinct(), "wanted")
    ids = wanted.select(F.col("rep").alias("r0")).distinct()
    exact = wanted.select(F.col("node").alias("k"), F.col("rep").alias("r1"), "times")
    if wanted.count() <= BROADCAST_IDS:  # 16 bytes each; beyond, both sides are shuffled on the id
        ids, exact = F.broadcast(ids), F.broadcast(exact)
    rows = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("r0")), "left_semi")
    found = rows.mapInPandas(hashed, "doc_id long, node long, hashes array<long>").join(
        exact, (F.col("node") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("r1"))).select("node", "hashes", "times")
    sets, found_path = stored(texts.sparkSession, found, "shingle-sets", by=["times"])
    # repeated rows of one id and text: one of them is enough
    return sets.where("times = 1").select("node", "hashes").unionByName(
        sets.where("times > 1").groupBy("node").agg(F.min("hashes").alias("hashes")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of set ids whose whole sets reach the similarity."""
    one, two = (sets.select(F.col("node").alias(k), F.col("hashes").alias(h)) for k, h in (("a", "ha"), ("b", "hb")))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.where(100 * common >= percent * (F.size("ha") + F.size("hb") - common)).select("a", "b")


def jaccard_components(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, node (the id of its set; null when empty) and root (the
    least node of its component, also where no row has an id; null when empty)."""
    spark = docs.sparkSession
    texts = id_and_bytes(docs, doc_col, text_col)
    shards = input_partitions(texts)
    sketch = spark.sparkContext.broadcast(_order_sketch(texts, words))  # SKETCH counters of 4 bytes
    path = scratch(spark, "prefix-join")
    _entry_rows(texts, sketch, shards, words, percent).write.partitionBy("kind").parquet(path)
    sketch.destroy()
    rows = spark.read.schema("a long, b long, n long, r long, doc_id long, kind int").parquet(path)
    entries = rows.where("kind = 0").select(F.col("a").alias("token"), F.col("b").alias("group"), "n", "r")
    stars = rows.where("kind = 1").select("a", "b").distinct()
    members = rows.where("kind = 2").select(
        F.col("a").alias("group"), F.col("b").alias("node"), F.col("n"),
        F.when(F.col("r") == 1, F.col("doc_id")).alias("doc_id"),
    )

    # a set's representative is its smallest id; how many rows have both
    alike = members.where("n > 0").groupBy("group", "node", "n", "doc_id").agg(F.count("*").alias("times"))
    nodes, nodes_path = stored(spark, alike.groupBy("group", "node", "n").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("rep"), "times")).alias("r")).select(
        "group", "node", "n", "r.rep", F.least("r.times", F.lit(2)).cast("int").alias("times")), "sets")
    groups = nodes.groupBy("group").agg(F.count("*").alias("sets"), F.min("node").alias("first"))
    several = groups.where("sets > 1").select("group", "first")
    open_entries = entries.where("r > 0")
    prefixes, prefixes_path = stored(spark, entries.join(open_entries.select("group").distinct(), "group", "left_semi")
                                     .groupBy("group").agg(F.collect_list("token").alias("tokens"), F.first("n").alias("n")),
                                     "prefixes")
    met = open_entries.select("group").union(several.select("group")).distinct()
    candidates, candidates_path = stored(spark, nodes.join(met, "group", "left_semi"), "candidates")

    def fetched(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        return _whole_sets(texts, candidates.join(ends, "node"), words)

    first = candidates.join(groups, "group").select("group", "first").distinct()
    one, two = (first.select(F.col("group").alias(k), F.col("first").alias(f)) for k, f in (("ga", "fa"), ("gb", "fb")))
    near = _plausible(stars.select(F.col("a").alias("ga"), F.col("b").alias("gb")), prefixes, percent).join(
        one, "ga").join(two, "gb").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"))
    inside = candidates.join(several, "group").where("node <> first").select(
        F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"))
    checked, checked_path = stored(spark, near.union(inside).distinct(), "star-pairs")
    links, links_path = stored(spark, _verified(checked, fetched(checked), percent), "links")
    roots, roots_path = stored(spark, connected_components(links), "roots")

    # the other candidates: sets of one token in different components, within the bounds of size and position
    labelled = candidates.select("group", "node", F.col("n").alias("size")).join(
        roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    spots = open_entries.join(labelled, "group").select("token", "group", "node", "n", "r", "root").union(
        labelled.join(several.select("group"), "group", "left_semi").select(
            F.col("group").alias("token"), "group", "node", F.col("size").alias("n"), F.col("size").alias("r"), "root"))
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) + 1e-6)).cast("int")
    columns = ("group", "node", "n", "r", "root")
    x = spots.select("token", step.alias("bin"), *(F.col(c).alias(f"x_{c}") for c in columns))
    y = spots.select("token", F.explode(F.array(step, step - 1)).alias("bin"), *(F.col(c).alias(f"y_{c}") for c in columns))
    ahead = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_node") < F.col("y_node")))
    bound = (100 + percent) * F.least("x_r", "y_r") >= percent * (F.col("x_n") + F.col("y_n"))
    others, others_path = stored(spark, x.join(y, ["token", "bin"]).where(
        ahead & bound & (F.col("x_root") != F.col("y_root"))).select(
        F.col("x_node").alias("a"), F.col("y_node").alias("b"), F.col("x_group").alias("ga"), F.col("y_group").alias("gb"))
        .distinct(), "other-pairs")
    likely, likely_path = stored(spark, _plausible(others.where("ga <> gb"), prefixes, percent).union(
        others.where("ga = gb")).select("a", "b"), "likely-pairs")
    more, more_path = stored(spark, _verified(likely, fetched(likely), percent), "links")
    final = roots if more.isEmpty() else connected_components(
        roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    rooted = nodes.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels, _ = stored(spark, rooted.join(least, "root").select("node", "component_id", "root"), "set-components")
    for p in (candidates_path, prefixes_path, checked_path, links_path, roots_path, others_path, likely_path, more_path,
              nodes_path):
        drop_path(spark, p)
    return members.withColumn("node", F.when(F.col("n") > 0, F.col("node"))).join(labels, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node", "root")


def set_nodes(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", words: int = WORDS):
    """A column with the set id of each text (as ``node`` of jaccard_components), for joins back to whole rows."""
    @F.pandas_udf("long")
    def node(texts: pd.Series) -> pd.Series:
        hold("jaccard_groups", _nothing)
        hashes = [set_hash(s) if len(s := shingle_hashes(t, words)) else 0 for t in texts]
        return pd.Series(np.array(hashes, np.uint64).view(np.int64))

    return node(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
