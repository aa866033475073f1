"""Registered queries of the training-data operators and their DuckDB oracle SQL.

Each query applies one operator with production parameters to its whole table; names without SQL are
iterative, trained or model-like operators that tests/llm compares with brute force instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (best_fit_packing, byte_bpe, chat_rotation, exact_dedup, hard_negatives, html_labeller, impact_search,
               ngram_join, secret_scan, source_mixing, toxicity, url_rules, word_runs)
from .common import UPPER, table

def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


LOWER_SQL = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


@register("op1_exact_dedup", f"""
WITH t AS (SELECT doc_id, {LOWER_SQL} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM t""")
def op1(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@register("op2_exact_topk", """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def op2(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return impact_search.top_k(vectors, vectors.where("vec_id % 50 = 0"))


@register("op4_secret_scan")
def op4(spark, sf_dir):
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


#: Rules of the registered query: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@register("op5_url_rules", f"""
WITH r(rhost, rpath, verdict) AS (VALUES {", ".join(map(str, RULES))}),
p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}',
                                     '{UPPER.lower()}') AS host,
             regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT p.*, rhost || rpath AS rule, verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""")
def op5(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


@register("op8_chat_rotation", """
WITH t AS (SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker, coalesce(text, '') AS text
           FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system'),
v AS (SELECT t.*, perspective,
             '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
                                    ELSE 'user name=' || regexp_replace(replace(speaker, '<|', '< |'), '[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]', ' ', 'g') END || chr(10) AS head
      FROM t JOIN p ON conv_id IS NOT DISTINCT FROM c),
s AS (SELECT *, head || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS segment FROM v),
w AS (SELECT *, row_number() OVER o AS position, CAST(sum(length(segment)) OVER o AS BIGINT) AS seg_end FROM s
      WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text
                   ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, speaker, position, segment, seg_end - length(segment) AS seg_start, seg_end,
       CASE WHEN speaker = perspective THEN seg_end - length(segment) + length(head) ELSE seg_end END AS mask_start,
       CASE WHEN speaker = perspective THEN seg_end - 1 ELSE seg_end END AS mask_end FROM w""")
def op8(spark, sf_dir):
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


@register("op7_best_fit_packing")
def op7(spark, sf_dir):
    return best_fit_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@register("op9_byte_bpe")
def op9(spark, sf_dir):
    import public_tokenizers

    return byte_bpe.digest(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"),
                           public_tokenizers.PATTERN)


@register("op3_toxicity")
def op3(spark, sf_dir):
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@register("op6_ngram_join", f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id
      GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT doc_id, any_value(CAST(len(s) AS BIGINT)) AS n_shingles, min(c) AS component_id FROM s JOIN r USING (doc_id)
GROUP BY doc_id""")
def op6(spark, sf_dir):
    return ngram_join.classes(table(spark, sf_dir, "documents"))


@register("op10_html_labeller")
def op10(spark, sf_dir):
    return html_labeller.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@register("op11_source_mixing", """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n,
             [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
o AS (SELECT *, coalesce(sum(n) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(w) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(n) OVER () AS total
      FROM s WINDOW b AS (ORDER BY n / w, source)),
l AS (SELECT max(CAST(1.5 * total - 2.0 * held AS DOUBLE) / CAST(rest AS DOUBLE)) AS level FROM o),
r AS (SELECT source, n, least(CAST(w AS DOUBLE) * level, 2.0 * CAST(n AS DOUBLE)) AS target,
             CASE WHEN n > 0 THEN target / CAST(n AS DOUBLE) ELSE 0 END AS rate FROM s, l)
SELECT doc_id, size, n AS source_size, target,
       CAST(size * (floor(rate) + CASE WHEN
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || t), 1, 13) AS BIGINT)
           / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""")
def op11(spark, sf_dir):
    plan = source_mixing.assign(table(spark, sf_dir, "documents"))
    return plan.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))

@register("op12_hard_negatives", """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
             CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""")
def op12(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, vectors.where("vec_id % 100 = 0")).drop("positive_rank")

def planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``documents``, where a tenth of the documents repeat themselves from a word on.

    With h = crc32(doc_id), g = h / 10 and n words: if h % 10 = 0, each word i >= a = g % n becomes word
    a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8), and words are joined by one space.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def repeated(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.slice(w, a + 1, p)
        times = F.ceil((n - a) / p).cast("int")
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(F.flatten(F.array_repeat(tail, times)), F.lit(1), n - a)), " ")

    # the words are bound once by a transform over a one-element array
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


@register("op13_word_runs", """
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT i, c FROM bits WHERE k = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, CAST(doc_id AS VARCHAR) AS s,
                          regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
crc(r, s, k, c) AS (
  SELECT r, s, 0, 4294967295 FROM d WHERE s IS NOT NULL
  UNION ALL SELECT r, s, k + 1, xor(tab.c, crc.c >> 8)
  FROM crc JOIN tab ON tab.i = xor(crc.c, CAST(ascii(substr(s, k + 1, 1)) AS BIGINT)) & 255 WHERE k < length(s)),
h AS (SELECT r, xor(c, 4294967295) AS h FROM crc WHERE k = length(s)),
n AS (SELECT d.r, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a,
             1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM d LEFT JOIN h ON d.r = h.r),
o AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS i FROM d),
t AS MATERIALIZED (SELECT x.r, x.i, o.w FROM
  (SELECT o.r, i, CASE WHEN i >= a THEN a + (i - a) % p ELSE i END AS j FROM o JOIN n ON o.r = n.r) x
  JOIN o ON x.r = o.r AND x.j = o.i),
g AS MATERIALIZED (SELECT * FROM (SELECT r, i, w || ' ' || lead(w, 1) OVER v || ' ' || lead(w, 2) OVER v || ' ' || lead(w, 3) OVER v
             || ' ' || lead(w, 4) OVER v || ' ' || lead(w, 5) OVER v AS g FROM t WINDOW v AS (PARTITION BY r ORDER BY i))
             WHERE g IS NOT NULL),
m AS (SELECT a.r, b.i - a.i AS q, a.i, a.i - row_number() OVER (PARTITION BY a.r, b.i - a.i ORDER BY a.i) AS part
      FROM g a JOIN g b ON a.r = b.r AND a.g = b.g AND a.i < b.i),
c AS MATERIALIZED (SELECT r, q, min(i) AS s, count(*) + 5 + q AS l FROM m GROUP BY r, q, part HAVING l >= greatest(12, 2 * q)),
u AS MATERIALIZED (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.r = c.r AND b.q < c.q AND b.s <= c.s AND b.s + b.l >= c.s + c.l)),
lost AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM u),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM t ANTI JOIN lost ON t.r = lost.r AND t.i = lost.i GROUP BY r),
runs AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM u GROUP BY r),
best AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY l DESC, s, q) = 1)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(l AS BIGINT) AS length,
       CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN runs ON d.r = runs.r LEFT JOIN best ON d.r = best.r LEFT JOIN kept ON d.r = kept.r""")
def op13(spark, sf_dir):
    return word_runs.digest(word_runs.find_runs(planted_repeats(table(spark, sf_dir, "documents"))))

@register("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
