"""Queries opN_<name> over the driver's tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.bpe import encode_decode
from kmerloom.llm.chunk_dedup import dedup_substrings
from kmerloom.llm.collocations import collocations
from kmerloom.llm.contamination import contamination
from kmerloom.llm.content_dedup import exact_dedup
from kmerloom.llm.divergence import divergence
from kmerloom.llm.html_text import extract
from kmerloom.llm.language import identify
from kmerloom.llm.licenses import scan, scan_sql
from kmerloom.llm.line_dedup import apply_bitmaps, keep_bitmaps
from kmerloom.llm.packing import pack
from kmerloom.llm.repetition import quality
from kmerloom.llm.simhash import simhash_components
from kmerloom.storage import spread

#: The vocabulary file by its name; executors find it in their own installation.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id, text and ``more`` columns, over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *more), "doc_id", "text")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(_documents(spark, sf_dir))
    return found.select("doc_id", "text", "n_spans", "n_bytes_dropped")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    kept = apply_bitmaps(docs, keep_bitmaps(docs, min_chars=20, min_docs=3))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_documents(spark, sf_dir), vocabulary_path())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_documents(spark, sf_dir, "lang"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), vocabulary_path(), capacity=1024, end_id=2)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_documents(spark, sf_dir), least=0.8)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), "page_id", "html"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(_documents(spark, sf_dir), shingle=3, seed=42, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir), keep="largest")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_documents(spark, sf_dir, "lang", "source"), least_docs=30, top=50)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir, "lang"), least=10, longest=3, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_bpe": op3_bpe,
        "op4_language_id": op4_language_id,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_license_scan": op6_license_scan,
        "op7_html_extraction": op7_html_extraction,
        "op8_quality_rules": op8_quality_rules,
        "op9_simhash": op9_simhash,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_source_divergence": op11_source_divergence,
        "op12_decontamination": op12_decontamination,
        "op13_collocations": op13_collocations,
    }


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), often AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT d.doc_id, d.pos, d.line, (o.k IS NOT NULL AND d.doc_id <> o.last_doc) AS dropped
  FROM keyed d LEFT JOIN often o ON d.k = o.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP10_SQL = """
WITH g AS (
  SELECT doc_id, coalesce(text, '') AS body FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM g
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS body FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS MATERIALIZED (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM d
), size AS (
  SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v
  FROM groups g JOIN kept k USING (lang) JOIN size USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (total + 5 * v)::HUGEINT AS p FROM dense
), whole AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n) AS n, any_value(v) AS v FROM dense GROUP BY lang, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), rows_ AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM rows_
)
SELECT lang, source, part, item, value::BIGINT AS value, r::INT AS rank FROM ranked WHERE part = 'pair' OR r <= 50
"""

OP12_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS k FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)
), own AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM sized) WHERE len(w) >= m)
), met AS MATERIALIZED (
  SELECT doc_id, m, i, item FROM own JOIN windows USING (m, k)
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM met) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP13_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), f AS MATERIALIZED (
  SELECT lang, phrase, size, count(*) AS f FROM (
    SELECT lang, 1 AS size, unnest(w) AS phrase FROM p
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p WHERE len(w) >= 2
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p WHERE len(w) >= 3
  ) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang
), often AS MATERIALIZED (
  SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT lang, phrase, size, a, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : size], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM often)
), scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, k, l.f AS l, r.f AS r, 1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covered AS (
  SELECT lang, part, max(a) AS a FROM (
    SELECT lang, w[1] || ' ' || w[2] AS part, a FROM often WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM often WHERE size = 3
  ) GROUP BY ALL
), ranked AS (
  SELECT s.*, n, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, phrase) AS rank
  FROM lowest s JOIN totals t ON t.lang = s.lang LEFT JOIN covered c ON c.lang = s.lang AND c.part = s.phrase
  WHERE c.a IS NULL OR 100 * c.a < 50 * s.a
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": OP2_SQL,
        "op6_license_scan": scan_sql(least=0.8),
        "op10_exact_dedup": OP10_SQL,
        "op11_source_divergence": OP11_SQL,
        "op12_decontamination": OP12_SQL,
        "op13_collocations": OP13_SQL,
    }
