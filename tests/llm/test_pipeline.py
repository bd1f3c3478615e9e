"""The pipeline on a small folder of tables, against what each stage should do to planted rows."""

import random

import pytest
from odd_cases import prose
from tokenizers import Tokenizer

import corpus_pipeline
from attrix.llm.common import scratch
from attrix.llm.queries import ORACLES, QUERIES, tokenizer

INSULTS = ["grobnik", "zornutz", "pliff"]


def planted():
    rnd = random.Random(8)
    rows, labels = [], []
    for k in range(160):
        words = prose(1000 + k, 60 + k % 30).split()
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    clean = dict(r for r in rows if r[0] % 4)
    near = clean[1].split()
    near[30] = "another"
    rows += [(200, clean[1]), (201, " ".join(near)), (1, clean[1]), (202, clean[2]), (None, clean[2])]
    item = prose(77, 30)
    rows += [(210, prose(78, 50) + " " + item.upper() + " " + prose(79, 20)), (211, prose(80, 50) + " " + item[:40] + "x" + item[41:])]
    rows += [(220, "Call +1 (366) 555-9807 or write to joe.doe@mail1.example.com. " + prose(81, 60)), (221, ""), (222, None), (223, "  ")]
    rows += [(230, prose(82, 50) + " pliff " + prose(83, 50))]
    return rows, labels, item


@pytest.fixture(scope="module")
def folder(spark, odd):
    rows, labels, item = planted()
    path = scratch(spark, "pipeline-input")
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, node string, _has string")
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder).checkpoint()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        kept.append(sorted(str(r.doc_id) for r in docs.select("doc_id").collect()))
        if name == "personal_data":
            texts = {r.doc_id: r.text for r in docs.collect()}
    rows, _, _ = planted()
    clean = [i for i, _ in rows if i is None or not (i < 160 and i % 4 == 0) and i != 230]
    assert kept[0] == sorted(map(str, clean))
    left = list(kept[0])
    for gone in ("1", "200", "201", "202", "None"):  # the second row of document 1 and the copies
        left.remove(gone)
    assert kept[1] == sorted(left)
    left.remove("210")
    left.remove("211")
    assert kept[2] == kept[3] == kept[4] == sorted(left)
    assert "555-9807" not in texts[220] and "joe.doe" not in texts[220] and texts[222] is None and texts[221] == ""
    assert all(texts[i] == t for i, t in rows if i in texts and i < 200)
    lib = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    for r in docs.collect():
        assert list(r.ids) == lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_near_copies_without_ids_leave_one_row(spark, odd):
    text, other = prose(901, 80), prose(902, 80)
    near = text.split()
    near[40] = "another"
    more = list(near)
    more[70] = "third"
    rows = [(None, text), (None, " ".join(near)), (None, " ".join(more)), (None, text), (None, other), (7, prose(903, 80)), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.text for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()]
    assert len(kept) == 4 and {other, prose(903, 80), ""} < set(kept)


def test_rows_that_share_an_id_are_told_apart(spark, odd):
    """Two rows of one id with one set of words: the least text stays, whatever the order; others keep their own way."""
    text, other = prose(911, 80), prose(912, 80)
    rows = [(5, text.upper(), "b"), (5, text, "a"), (5, text, "b"), (5, other, "x"), (6, text, "y"), (None, other + " z", "n"), (8, None, "q"),
            (8, None, "q")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string")
        kept = sorted((str(r.doc_id), r.text or "", r.source) for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect())
        assert kept == sorted([("5", min(text, text.upper()), "b" if text.upper() < text else "a"), ("5", other, "x"), ("8", "", "q"), ("8", "", "q")])


def test_run_is_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    assert out.where("doc_id in (2, 3, 220)").count() == 3 and out.where("doc_id in (4, 200, 210)").count() == 0


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).checkpoint()
        assert docs.count() == 0


def test_registered_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *QUERIES} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) == set(QUERIES)
