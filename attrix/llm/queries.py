"""The registered queries of this package and their DuckDB twins (None: not expressible in SQL)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.llm import (decontaminate, gru_toxicity, jaccard_groups, kneser_ney, lang_lattice, license_automaton, line_bitmaps,
                        line_crf, merkle_manifest, phrase_mining, rank_bpe, surrogates, token_file)
from attrix.llm.common import documents, fold, ship, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str | None] = {}

#: A text's words and A-Z lower case in DuckDB.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name], ORACLES[name] = run, sql
        return run

    return add


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file (a parameter of the operators that use one)."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_token_file")
def token_file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_digests(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


@register("op3_rank_array_bpe")
def rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.encode_digests(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w
),
g AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS c
  FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (total - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM s JOIN r ON s.doc_id = r.x GROUP BY ALL
"""


@register("op8_ngram_jaccard_join", JACCARD_SQL)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.jaccard_components(documents(spark, sf_dir)).drop("node", "root")


@register("op9_kneser_ney")
def kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.held_out_scores(documents(spark, sf_dir))


@register("op2_line_crf")
def line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = line_crf.train_field(docs, table(spark, sf_dir, "labels"))
    return line_crf.line_quality(docs, field).drop("line_labels")


@register("op7_license_automaton")
def license_automaton_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_automaton.license_scan(documents(spark, sf_dir)).drop("spans")


@register("op4_lang_lattice")
def lang_lattice_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_lattice.held_out_languages(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


@register("op6_gru_toxicity")
def gru_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = gru_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return gru_toxicity.toxicity(docs, net).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op5_surrogates")
def surrogate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.private_documents(documents(spark, sf_dir))


@register("op10_decontaminate")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


MERKLE_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    ORDER BY i) AS t FROM range(256) r(i)
),
d AS (
  SELECT doc_id, lang, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail, n_chars,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS tampered
  FROM documents, crc
),
f AS (
  SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS leaf,
    CASE WHEN coalesce(tampered, false) THEN sha256(head || CASE WHEN n_chars IS NULL THEN '-'
      ELSE strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END || tail) END AS changed
  FROM d
),
p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM f
),
nodes AS (
  SELECT lang, 0 AS lvl, pos, leaf AS h, n FROM p
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), max((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY lang, lvl, pos // 2
),
subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
),
tops AS (
  SELECT 0 AS lvl, pos, h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), max((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY lvl, pos // 2
),
root AS (SELECT h FROM tops WHERE n = 1),
own AS (
  SELECT x.lang, x.pos, o.lvl, coalesce(CASE WHEN s.pos % 2 = 0 THEN 'L' ELSE 'R' END || s.h, 'A') AS step
  FROM p x JOIN nodes o ON o.lang IS NOT DISTINCT FROM x.lang AND o.pos = x.pos >> o.lvl AND o.n > 1
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM x.lang AND s.lvl = o.lvl AND s.pos = xor(o.pos, 1)
),
top AS (
  SELECT x.lang, o.lvl, coalesce(CASE WHEN s.pos % 2 = 0 THEN 'L' ELSE 'R' END || s.h, 'A') AS step
  FROM subroots x JOIN tops o ON o.pos = x.pos >> o.lvl AND o.n > 1
  LEFT JOIN tops s ON s.lvl = o.lvl AND s.pos = xor(o.pos, 1)
),
own_steps AS (SELECT lang, pos, list(step ORDER BY lvl) AS steps FROM own GROUP BY lang, pos),
top_steps AS (SELECT lang, list(step ORDER BY lvl) AS steps FROM top GROUP BY lang),
rows AS (
  SELECT p.doc_id, p.leaf, p.changed, s.h AS subroot, root.h AS root,
    list_concat(coalesce(o.steps, []::VARCHAR[]), coalesce(t.steps, []::VARCHAR[])) AS steps
  FROM p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN root
  LEFT JOIN own_steps o ON o.lang IS NOT DISTINCT FROM p.lang AND o.pos = p.pos
  LEFT JOIN top_steps t ON t.lang IS NOT DISTINCT FROM p.lang
),
folded AS (
  SELECT *, list_reduce(list_prepend(coalesce(changed, leaf), steps), lambda acc, x: sha256(CASE x[1] WHEN 'A' THEN acc
    WHEN 'L' THEN x[2:] || acc ELSE acc || x[2:] END)) AS folded_root FROM rows
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(steps, lambda x: x <> 'A'), lambda x: x[2:]), ''))
  AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""


@register("op11_merkle_manifest", MERKLE_SQL)
def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.proofs(documents(spark, sf_dir))


LINES_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS key FROM l
),
hot AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
m AS (SELECT k.*, hot.key IS NOT NULL AND k.doc_id IS DISTINCT FROM hot.keeper AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@register("op12_line_bitmaps", LINES_SQL)
def line_bitmap_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_bitmaps.without_repeated_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


PHRASES_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, regexp_split_to_array({LOWER}, '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents
),
q AS (SELECT doc, lang, unnest(ps) AS p, generate_subscripts(ps, 1) AS piece FROM t),
v AS (SELECT doc, lang, piece, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM q),
u AS (SELECT doc, lang, piece, unnest(ws) AS w, generate_subscripts(ws, 1) AS place FROM v),
x AS (
  SELECT lang, w AS w1, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM u WINDOW s AS (PARTITION BY doc, piece ORDER BY place)
),
n AS (SELECT lang, count(*) AS n FROM x GROUP BY lang),
c1 AS (SELECT lang, w1, count(*) AS f FROM x GROUP BY ALL),
c2 AS (SELECT lang, w1, w2, count(*) AS f FROM x WHERE w2 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM x WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
s3 AS (
  SELECT c3.*, p.f AS l1, q.f AS r1, pq.f AS l2, r.f AS r2,
    1000000::HUGEINT * a * a // (p.f::HUGEINT * q.f) AS s1, 1000000::HUGEINT * a * a // (pq.f::HUGEINT * r.f) AS s2
  FROM c3 JOIN c1 p ON p.lang = c3.lang AND p.w1 = c3.w1 JOIN c2 q ON q.lang = c3.lang AND q.w1 = c3.w2 AND q.w2 = c3.w3
  JOIN c2 pq ON pq.lang = c3.lang AND pq.w1 = c3.w1 AND pq.w2 = c3.w2 JOIN c1 r ON r.lang = c3.lang AND r.w1 = c3.w3
),
longer AS (
  SELECT lang, w1, w2, max(a) AS a FROM (SELECT lang, w1, w2, a FROM c3 UNION ALL SELECT lang, w2, w3, a FROM c3) GROUP BY ALL
),
phrases AS (
  SELECT lang, w1 || ' ' || w2 || ' ' || w3 AS phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END AS l,
    CASE WHEN s2 < s1 THEN r2 ELSE r1 END AS r, least(s1, s2) AS score FROM s3
  UNION ALL
  SELECT c2.lang, c2.w1 || ' ' || c2.w2, c2.f, p.f, r.f, 1000000::HUGEINT * c2.f * c2.f // (p.f::HUGEINT * r.f)
  FROM c2 JOIN c1 p ON p.lang = c2.lang AND p.w1 = c2.w1 JOIN c1 r ON r.lang = c2.lang AND r.w1 = c2.w2
  LEFT JOIN longer g ON g.lang = c2.lang AND g.w1 = c2.w1 AND g.w2 = c2.w2
  WHERE c2.f >= 10 AND (g.a IS NULL OR 100 * g.a < 50 * c2.f)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM phrases
)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n.n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""


@register("op13_phrase_mining", PHRASES_SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(documents(spark, sf_dir))
