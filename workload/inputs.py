"""Case reports, reviews, names and model outputs as views over the given tables.

Each view is one SQL text that Spark and the comparing database both run, over whole
tables. ``{name}`` stands for a given table or for an earlier view.
"""

from __future__ import annotations

import string
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# One line item is one drug and one reaction of the case that its order stands for.
VIEWS = {
    "cases": "SELECT o_orderkey AS caseid FROM {orders}",
    "case_drugs": """
        SELECT l_orderkey AS caseid, l_linenumber AS drug_seq, p_name AS drugname_raw,
               p_brand AS drugname_norm
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "case_reactions": """
        SELECT l_orderkey AS caseid, p_name AS pt_name
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "case_rows": """
        SELECT l_orderkey AS caseid, p_brand AS generic_drug,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE p_name END AS meddra_pt
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    # raw files: numbers as text, damaged values, repeated keys, cases nobody knows
    "demo_raw": """
        SELECT CAST(l_orderkey AS STRING) AS caseid,
               CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CAST(l_linenumber AS STRING) END AS caseversion,
               CASE WHEN l_partkey % 11 = 0 THEN '-1' WHEN l_partkey % 13 = 0 THEN 'n/a'
                    ELSE CAST(p_size AS STRING) END AS age,
               CASE p_type WHEN 'SMALL' THEN 'YR' WHEN 'LARGE' THEN 'dec' WHEN 'STANDARD' THEN 'MON'
                    WHEN 'ECONOMY' THEN 'WK' WHEN 'MEDIUM' THEN 'DY'
                    ELSE CASE WHEN l_suppkey % 5 = 0 THEN 'XX' ELSE 'HR' END END AS age_cod,
               CASE WHEN l_partkey % 7 = 0 THEN '2001-13' WHEN l_partkey % 17 = 0 THEN '20011399'
                    ELSE replace(substr(CAST(l_shipdate AS STRING), 1, 10), '-', '') END AS fda_dt,
               '19990101' AS rept_dt,
               CASE WHEN l_suppkey % 3 = 0 THEN 'f ' WHEN l_suppkey % 3 = 1 THEN 'M' END AS sex,
               'N' || CAST(l_suppkey % 25 AS STRING) AS occr_country,
               CASE l_linestatus WHEN 'F' THEN '1 ' ELSE CASE WHEN l_suppkey % 2 = 0 THEN '2' ELSE 'x' END END AS serious
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "drug_raw": """
        SELECT CASE WHEN l_quantity > 45 THEN 'X' || CAST(l_orderkey AS STRING)
                    ELSE CAST(l_orderkey AS STRING) END AS caseid,
               CAST(l_linenumber AS STRING) AS drug_seq,
               CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE upper(p_name) END AS prod_ai,
               p_name || ' HCl' AS drugname,
               CASE WHEN l_linenumber = 1 THEN 'PS' ELSE 'SS' END AS role_cod
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "reac_raw": """
        SELECT CASE WHEN l_quantity > 45 THEN 'X' || CAST(l_orderkey AS STRING)
                    ELSE CAST(l_orderkey AS STRING) END AS caseid,
               CASE WHEN l_suppkey % 2 = 0 THEN p_name || ' ' ELSE p_name END AS pt
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "outc_raw": """
        SELECT CAST(l_orderkey AS STRING) AS caseid,
               CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN ' ho ' WHEN l_returnflag = 'A' THEN 'OT' END AS outc_cod
        FROM {lineitem}""",
    "known_cases": """
        SELECT CAST(o_orderkey AS STRING) AS caseid,
               CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS serious
        FROM {orders}""",
    # names: as listed, with salts, reordered, with a dose form
    "raw_names": """
        SELECT p_partkey,
               CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN upper(p_name) || ' HCL'
                    WHEN 2 THEN 'Sodium  ' || p_name
                    WHEN 3 THEN substr(p_name, instr(p_name, ' ') + 1) || ' ' || substr(p_name, 1, instr(p_name, ' ') - 1)
                    ELSE p_name || ' tab' END AS drugname_raw
        FROM {part}""",
    "drug_names": """
        SELECT l_orderkey AS caseid, l_linenumber AS drug_seq, drugname_raw,
               CAST(NULL AS STRING) AS drugname_norm, CAST(NULL AS STRING) AS rxnorm_rxcui
        FROM {lineitem} JOIN {raw_names} n ON l_partkey = n.p_partkey""",
    "terms_file": """
        SELECT 'C' || CAST(p_partkey AS STRING) AS RXCUI, p_brand AS FULL_GENERIC_NAME,
               ' ' || p_name AS DISPLAY_NAME,
               CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type || ' ' || p_brand END AS BRAND_NAME
        FROM {part}""",
    # reviews: documents with markup around and between their lines
    "reviews_raw": """
        SELECT source AS drugname, lang AS condition,
               '"' || replace(text, chr(10), '<br />') || ' &amp; <i>it&#039;s</i> &lt;ok&gt; "' AS review,
               CAST(doc_id % 12 AS STRING) || '.0' AS rating,
               CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS source, doc_id
        FROM {documents}""",
    "reviews": """
        SELECT CAST(doc_id AS STRING) AS review_id, source AS drug_norm, text AS review_text,
               (contains(lower(text), 'tion') OR contains(lower(text), 'pain')) AS has_ae_mention,
               CAST(doc_id % 12 AS INT) AS rating, n_chars
        FROM {documents}""",
    # model outputs: one to three attempts per report, in six shapes
    "outputs_shape": """
        SELECT doc_id, text, a.attempt,
               CASE WHEN doc_id % 7 < 3 THEN doc_id % 6 ELSE (doc_id + 2 * a.attempt) % 6 END AS shape,
               'Brand#' || CAST(doc_id % 25 + 1 AS STRING) AS drug, p_brand, p_name, p_type, n_chars
        FROM {documents} JOIN {part} ON doc_id = p_partkey
        JOIN (SELECT 1 AS attempt UNION ALL SELECT 2 UNION ALL SELECT 3) a ON a.attempt <= 1 + doc_id % 3""",
    "outputs_json": """
        SELECT doc_id, text, attempt, shape, p_brand,
               '{{"drugs": ["' || p_brand || '", "' || drug || '"], "reactions": ["' || p_name || '", "' || p_type || '"]'
               AS body,
               CASE n_chars % 4 WHEN 0 THEN 'serious' WHEN 1 THEN 'non-serious' WHEN 2 THEN 'unknown' ELSE 'mild' END AS severity
        FROM {outputs_shape}""",
    "outputs": """
        SELECT CAST(doc_id AS STRING) AS report_id, attempt, p_brand AS drug_norm,
               CASE shape
                 WHEN 0 THEN body || ', "severity": "' || severity || '"}}'
                 WHEN 1 THEN '```json' || chr(10) || body || ', "severity": "' || severity || '"}}' || chr(10) || '```'
                 WHEN 2 THEN text || chr(10) || body || '}}' || chr(10) || 'as asked'
                 WHEN 3 THEN body || ', "severity": "unkn'
                 WHEN 4 THEN text
                 ELSE '{{"drugs": [], "reactions": [], "severity": "' || severity || '"}}' END AS raw
        FROM {outputs_json}""",
    "term_map": """
        SELECT p_type AS text, min(p_name) AS mapped_term, CAST(0.9 AS DOUBLE) AS similarity
        FROM {part} GROUP BY p_type
        UNION ALL
        SELECT p_name, upper(p_name), CAST(0.95 AS DOUBLE) FROM {part} WHERE p_name NOT LIKE 'r%' GROUP BY p_name""",
    "label_rows": """
        SELECT CAST(l.doc_id AS STRING) AS review_id, p_brand AS drug_norm,
               substr(text, 1, 200) AS review_text_preview,
               CASE WHEN l.toxic = 1 THEN p_brand ELSE ' ' || upper(p_brand) || ', the' END AS drugs_gt,
               CASE WHEN l.quality = 1 THEN p_name || ',' || p_type || ', other' END AS reactions_gt,
               CASE WHEN n_chars % 3 = 0 THEN 'Serious' WHEN n_chars % 3 = 1 THEN 'non-serious' ELSE 'unknown' END AS severity_gt,
               '' AS notes
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id JOIN {part} ON l.doc_id = p_partkey""",
    "latencies": """
        SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS extract_latency_ms,
               CASE WHEN user_id % 2 = 0 THEN value * 2 END AS map_terms_latency_ms,
               value / 4 AS signal_check_latency_ms
        FROM {events}""",
}


def _fields(sql: str) -> list[str]:
    return list(dict.fromkeys(f for _, f, _, _ in string.Formatter().parse(sql) if f))


@lru_cache(maxsize=None)
def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or one of the views above; the plan, not the data, is kept for reuse."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{f: view(spark, sf_dir, f) for f in _fields(sql)})


table = view


def with_views(body: str, *names: str) -> str:
    """SQL text for the comparing database: the views named, and those they need, then the body."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in TABLES or name in order:
            return
        for field in _fields(VIEWS[name]):
            need(field)
        order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({VIEWS[n].format(**{f: f for f in _fields(VIEWS[n])})})" for n in order]
    head = "WITH " + ",\n".join(parts)
    body = body.strip()
    return f"{head},\n{body[4:].lstrip()}" if body.startswith("WITH") else f"{head}\n{body}"
