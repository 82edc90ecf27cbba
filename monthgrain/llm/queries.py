"""Registered queries of the subpackage and, where SQL can state them, their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from monthgrain.llm import (
    ball_tree,
    kneser_ney,
    minhash_dedup,
    nn_descent,
    packing,
    pii,
    quality_rules,
    sentencepiece_viterbi,
    simhash_pigeonring,
    source_divergence,
    suffix_dedup,
    url_filter,
    warc,
)
from monthgrain.llm.work import Work

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP3_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM t),
win AS (SELECT r, i, ws[i:i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
lines AS (SELECT r, unnest(ls) AS l FROM w),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n
        FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dup.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS BIGINT) AS n_upper,
        CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_excl
      FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN 10 * n_upper > 5 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_excl > 3 * n_words THEN 32 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END) + (CASE WHEN word_chars > 12 * n_words THEN 128 ELSE 0 END) AS bits
      FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, CAST(bits AS BIGINT) AS fail_bits,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, bits = 0 AS kept FROM b
"""


@query("op3_quality_rules", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = quality_rules.apply_policy(rows)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "fail_bits", "base_failed", "kept")


OP5_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM p),
u AS (SELECT row_number() OVER () AS r, page_id,
        translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM s),
rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hits AS (SELECT r, rh || rp AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(rh || rp) DESC) AS k
  FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, hits.rule AS rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN hits ON u.r = hits.r AND k = 1
"""


@query("op5_url_filter", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(url_filter.RULES), url_filter.RULE_SCHEMA)
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f
"""


@query("op2_warc", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.captures(table(spark, sf_dir, "pages"), Work(spark, "warc"), with_payload=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query("op7_minhash_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return minhash_dedup.near_duplicates(docs, Work(spark, "minhash"), minhash_dedup.CONTRACT)


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"), Work(spark, "suffix"))


@query("op4_nn_descent")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, Work(spark, "nn_descent"))


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_viterbi.encode(docs, keep=["doc_id", "text"])
    back = sentencepiece_viterbi.decode(coded, out="decoded")
    same = F.translate("text", sentencepiece_viterbi.SPACE, " ").eqNullSafe(F.col("decoded"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", same.alias("round_trip"))


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return kneser_ney.score(docs, labels, Work(spark, "kneser_ney"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
asked AS (SELECT q, item_id, term, count(*) AS repeats FROM (SELECT q, item_id, unnest(ts) AS term FROM b) GROUP BY ALL),
f AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT tf.r, tf.term, (1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * len(d.ts) * f.n_docs) // f.total)) AS x
      FROM tf JOIN d ON d.r = tf.r, f),
w AS (SELECT term, CAST(floor(1000 * ln((2 * f.n_docs + 2) / (2 * df.df + 1))) AS BIGINT) AS w FROM df, f),
s AS (SELECT asked.q, asked.item_id, x.r, CAST(sum(asked.repeats * w.w * x.x) AS BIGINT) AS score
      FROM asked JOIN w ON w.term = asked.term JOIN x ON x.term = asked.term GROUP BY ALL),
k AS (SELECT s.*, d.doc_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s JOIN d ON d.r = s.r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""


@query("op11_ball_tree_search", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Work(spark, "ball_tree"))


@query("op12_simhash_pigeonring")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pigeonring.near_duplicates(table(spark, sf_dir, "documents"), Work(spark, "simhash"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
vocab AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN vocab v ON v.lang = t.lang AND v.term = t.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS terms FROM vocab GROUP BY lang),
total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
whole AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
whole_total AS (SELECT lang, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, vocab.term, coalesce(c.n, 0) AS n,
        CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (coalesce(total.total, 0) + v.terms) AS HUGEINT) AS p
      FROM g JOIN vocab ON vocab.lang = g.lang JOIN v ON v.lang = g.lang
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = vocab.term
        LEFT JOIN total ON total.lang = g.lang AND total.source = g.source),
q AS (SELECT whole.lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (total + terms) AS HUGEINT) AS q
      FROM whole JOIN whole_total USING (lang) JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
        FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value
          FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
            LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // q.q AS value
          FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query("op13_source_divergence", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"), Work(spark, "divergence"))
