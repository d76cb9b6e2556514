"""The queries op1_ to op10_ with production parameters over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import UPPER, LOWER, read
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .html_text import html_text
from .jaccard_join import jaccard_components
from . import language_id as _language
from . import toxicity as _toxicity
from .license_scan import BASE, TEMPLATES, license_scan, step_of
from .mixing import mix_sources
from . import passages as _passages
from .substring_dedup import repeated_lines
from .token_counts import token_counts


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return _language.language_id(docs, _language.fit(docs))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(read(spark, sf_dir, "documents"), min_words=1)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents")).drop("matches")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(read(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op9_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).drop("rate", "copies")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return _toxicity.toxicity(docs, _toxicity.fit(docs, read(spark, sf_dir, "labels")))


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that documents share: what op2_substring_dedup, whose rows are lines, does not show."""
    return _passages.repeated_passages(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_license_scan, op4_token_counts, op5_jaccard_join, op6_html_text, op7_decontamination, op8_exact_dedup, op9_entropy_mixing, op10_toxicity, repeated_passages)}

_OP8 = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)
"""


def _op3() -> str:
    base = ", ".join(f"('{label}', {[*phrase.split()]})" for phrase, label in BASE.items())
    own = ", ".join(f"('{label}', {sorted(set(text.split()))}, {step_of(len(text.split()))})" for label, text in TEMPLATES)
    return rf"""
WITH w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
base(label, phrase) AS (VALUES {base}),
own(label, tokens, step) AS (VALUES {own}),
places AS (SELECT doc_id, label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1:i + len(phrase)] = phrase)) AS pos FROM w, base),
by_base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
blocks AS MATERIALIZED (SELECT doc_id, step, ws[b + 1:b + 2 * step] AS block FROM (SELECT doc_id, ws, step, unnest(range(0, len(ws), step)) AS b FROM w, (SELECT DISTINCT step FROM own))),
matched AS (SELECT doc_id, label, len(list_intersect(tokens, block)) / len(tokens) AS containment FROM blocks JOIN own USING (step) WHERE len(list_intersect(tokens, block)) >= ceil(0.85 * len(tokens) - 1e-9)),
found AS (SELECT doc_id, label, containment FROM matched UNION ALL SELECT doc_id, label, 1.0 FROM places),
by_label AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS score FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN by_base USING (doc_id) LEFT JOIN by_label USING (doc_id)
"""


_OP2 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS unit FROM documents),
o AS (SELECT doc_id, unit, CAST(length(raw) AS BIGINT) AS length, CAST(coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, trim(regexp_replace(translate(raw, '{UPPER}', '{LOWER}'), '[\\x09-\\x0D\\x20]+', ' ', 'g'), ' ') AS norm FROM l),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_doc_id, first_value(start) OVER w AS keep_start, count(*) OVER (PARTITION BY norm) AS occurrences FROM o WHERE norm <> '' WINDOW w AS (PARTITION BY norm ORDER BY doc_id, start))
SELECT doc_id, unit, start, length, keep_doc_id, keep_start, occurrences FROM g WHERE occurrences > 1 AND NOT (doc_id = keep_doc_id AND start = keep_start)
"""

_PASSAGES = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
v AS MATERIALIZED (SELECT r, doc_id, s, array_to_string(ws[s + 1:s + 51], ' ') AS win FROM (SELECT r, doc_id, ws, unnest(range(0, len(ws) - 50)) AS s FROM d WHERE len(ws) > 50)),
g AS (SELECT win, min(doc_id) AS keep_doc_id FROM v GROUP BY win HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INTEGER)) > 1),
i AS (SELECT r, doc_id, keep_doc_id, s, s - row_number() OVER (PARTITION BY r, keep_doc_id ORDER BY s) AS run FROM v JOIN g USING (win))
SELECT doc_id, min(s) AS first_word, max(s) - min(s) + 51 AS n_words, keep_doc_id, doc_id IS NOT DISTINCT FROM keep_doc_id AS kept FROM i GROUP BY r, doc_id, keep_doc_id, run
"""

ORACLE_SQL = {"op2_substring_dedup": _OP2, "op3_license_scan": _op3(), "op8_exact_dedup": _OP8, "repeated_passages": _PASSAGES}
