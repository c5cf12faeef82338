"""The operators over their whole tables, with production parameters, and the SQL that some have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import backoff, codebooks, embed_dedup, langid, licenses, mixing, ngram_join, packing, phrases, secrets, topk, toxicity, warc
from .common import read


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op5_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(read(spark, sf_dir, "documents"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup(read(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.codes(read(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


#: The smallest id that links reach: rounds over pairs (a, b) of both directions.
_REACH = """reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)"""

OP7 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
links AS (SELECT a, b FROM l UNION SELECT b, a FROM l), {_REACH},
c AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(c.m, d.doc_id)) AS BIGINT) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""

OP8 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), links AS (SELECT a, b FROM l UNION SELECT b, a FROM l), {_REACH},
c AS (SELECT a, min(b) AS m FROM reach GROUP BY 1), k AS (SELECT a, count(*) AS k FROM links GROUP BY 1)
SELECT vec_id, CAST(coalesce(k.k, 0) AS BIGINT) AS n_links, CAST(least(vec_id, coalesce(c.m, vec_id)) AS BIGINT) AS component_id,
       least(vec_id, coalesce(c.m, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id
"""

OP9 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

OP11 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
longer AS (SELECT lang, phrase, max(f) AS f FROM (
  SELECT lang, f, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, f, w, m, unnest(range(1, k - m + 2)) AS i FROM f, range(2, 5) t(m) WHERE m < k)) GROUP BY 1, 2),
kept AS (SELECT f.* FROM f LEFT JOIN longer o ON f.lang = o.lang AND f.phrase = o.phrase WHERE f.k > 1 AND 100 * coalesce(o.f, 0) < 100 * f.f),
cut AS (SELECT lang, phrase, f AS a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
s AS (
  SELECT cut.lang, cut.phrase, a, c, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y JOIN n ON n.lang = cut.lang
), one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM one QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

_FLOORED = "(({s} - ((({s} % {n}) + {n}) % {n})) // {n})"  # of a quotient, also below zero


def _codes_sql(rounds: int = 6) -> str:
    """Rounds unrolled: near<r> has each part's nearest entry, book<r> the entries after r rounds."""
    sum_of_squares = "CAST(list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    parts = [
        f"""near{r} AS MATERIALIZED (
  SELECT x.k, x.p, min_by(b.e, ({sum_of_squares}, b.e)) AS e, min({sum_of_squares}) AS d FROM x JOIN book{r} b ON x.p = b.p GROUP BY x.k, x.p
), book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT p, e, list(v ORDER BY i) AS c FROM (
      SELECT p, e, i, {_FLOORED.format(s="sum(v)::HUGEINT", n="count(*)")}::BIGINT AS v
      FROM (SELECT x.p, n.e, unnest(range(len(x.c))) AS i, unnest(x.c) AS v FROM x JOIN near{r} n ON x.k = n.k AND x.p = n.p) GROUP BY p, e, i) GROUP BY p, e
  ) m ON b.p = m.p AND b.e = m.e
)"""
        for r in range(rounds + 1)
    ]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT k, p, q[p * (len(q) // 8) + 1 : (p + 1) * (len(q) // 8)] AS c FROM v, range(8) r(p)
), book0 AS MATERIALIZED (SELECT p, k - 1 AS e, c FROM x WHERE k <= 16),
{", ".join(parts)},
codes AS (SELECT k, string_agg(lpad(printf('%x', e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY k),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN codes USING (k), books
"""


OP12 = _codes_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix, op2_topk, op3_licenses, op4_secrets, op5_backoff, op6_pack, op7_ngram_join, op8_embedding_dedup, op9_warc, op10_langid, op11_phrases, op12_codes, op13_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2, "op7_ngram_join": OP7, "op8_embedding_dedup": OP8, "op9_warc": OP9, "op11_phrases": OP11, "op12_codes": OP12}
