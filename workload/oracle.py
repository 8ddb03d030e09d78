"""The SQL each registered query is compared with.

Written from the definition of each result, not from the Spark plan: window functions and
plain joins over the same views.
"""

from __future__ import annotations

from casewatch import constants as K
from workload.inputs import with_views
from workload.queries import BRANDS, CHOSEN, CONTROLS, NOUNS, SOURCES, STEMS, TARGETS, TERMS

ORACLE: dict[str, str] = {}


def oracle(name: str, body: str, *views: str) -> None:
    ORACLE[name] = with_views(body, *views) if views else body


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def any_of(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w.lower()}')" for w in words) + ")"


# --- signals -----------------------------------------------------------------------------

SCORES = """
    round((a / (a + b)) / (c / (c + d)), 3) AS prr, round((a * d) / (b * c), 3) AS ror,
    round((n * ((abs(a * d - b * c) - n / 2) * (abs(a * d - b * c) - n / 2)))
          / ((a + b) * (c + d) * (a + c) * (b + d)), 3) AS chi2"""
RAW_PRR = "(a / (a + b)) / (c / (c + d))"
RAW_CHI2 = (
    "(n * ((abs(a * d - b * c) - n / 2) * (abs(a * d - b * c) - n / 2)))"
    " / ((a + b) * (c + d) * (a + c) * (b + d))"
)
CELLS = """
    SELECT drug, reaction, a::DOUBLE AS a, (nd - a)::DOUBLE AS b, (nr - a)::DOUBLE AS c,
           (n - nd - nr + a)::DOUBLE AS d, n::DOUBLE AS n FROM counted"""


def case_signals(min_cases: int = 3, min_prr: float = 2.0, min_chi2: float = 3.84) -> str:
    return f"""WITH counted AS (
        SELECT p.drug, p.reaction, p.a, x.nd, y.nr, (SELECT count(DISTINCT caseid) FROM cases) AS n
        FROM (SELECT g.drugname_norm AS drug, r.pt_name AS reaction, count(DISTINCT g.caseid) AS a
              FROM case_drugs g JOIN case_reactions r ON g.caseid = r.caseid GROUP BY ALL) p
        JOIN (SELECT drugname_norm AS drug, count(DISTINCT caseid) AS nd FROM case_drugs GROUP BY ALL) x USING (drug)
        JOIN (SELECT pt_name AS reaction, count(DISTINCT caseid) AS nr FROM case_reactions GROUP BY ALL) y USING (reaction)),
      cells AS ({CELLS}),
      signals AS (
        SELECT drug, reaction, a::BIGINT AS n_cases, {SCORES},
               {RAW_PRR} >= {min_prr}::DOUBLE AND {RAW_CHI2} >= {min_chi2}::DOUBLE AS is_signal,
               (c + d) / n < 0.2::DOUBLE AS masking_warning
        FROM cells WHERE a >= {min_cases} AND b > 0 AND c > 0)"""


SIGNAL_VIEWS = ("cases", "case_drugs", "case_reactions")
LOW = case_signals(3, 1.1, 0.5)

oracle("marginals", """
    SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS term, count(DISTINCT caseid) AS n FROM cases
    UNION ALL SELECT 'drug', drugname_norm, count(DISTINCT caseid) FROM case_drugs GROUP BY 2
    UNION ALL SELECT 'reaction', pt_name, count(DISTINCT caseid) FROM case_reactions GROUP BY 2""", *SIGNAL_VIEWS)
oracle("pair_counts", """
    SELECT d.drugname_norm, r.pt_name, count(DISTINCT d.caseid) AS n_cases
    FROM case_drugs d JOIN case_reactions r ON d.caseid = r.caseid
    GROUP BY ALL HAVING count(DISTINCT d.caseid) >= 3""", *SIGNAL_VIEWS)
oracle("signals", case_signals() + " SELECT * FROM signals", *SIGNAL_VIEWS)
oracle("signal_flow", LOW + " SELECT * FROM signals", *SIGNAL_VIEWS)
oracle("signals_rowlevel", f"""WITH counted AS (
        SELECT p.drug, p.reaction, p.a,
               (SELECT count(*) FROM case_rows w WHERE w.generic_drug = p.drug) AS nd,
               (SELECT count(*) FROM case_rows w WHERE w.meddra_pt = p.reaction) AS nr,
               (SELECT count(*) FROM case_rows) AS n
        FROM (SELECT generic_drug AS drug, meddra_pt AS reaction, count(*) AS a FROM case_rows
              WHERE generic_drug IS NOT NULL AND meddra_pt IS NOT NULL GROUP BY ALL) p),
      cells AS ({CELLS})
    SELECT drug, reaction, a::BIGINT AS n_cases, {SCORES},
           {RAW_PRR} >= 2.0::DOUBLE AND {RAW_CHI2} >= 3.84::DOUBLE AS is_signal,
           (c + d) / n < 0.2::DOUBLE AS masking_warning
    FROM cells WHERE a >= 3 AND b > 0 AND c > 0""", "case_rows")
oracle("signals_all", case_signals(0) + f"""
    SELECT drug, reaction, a::BIGINT AS n_cases,
           CASE WHEN ok THEN prr END AS prr, CASE WHEN ok THEN ror END AS ror, CASE WHEN ok THEN chi2 END AS chi2,
           ok AND is_signal AS is_signal, ok AND masking_warning AS masking_warning,
           CASE WHEN NOT ok THEN 'insufficient_data' END AS reason
    FROM (SELECT *, a >= 30 AND b > 0 AND c > 0 AS ok, {RAW_PRR} >= 2.0::DOUBLE AND {RAW_CHI2} >= 3.84::DOUBLE AS is_signal,
                 (c + d) / n < 0.2::DOUBLE AS masking_warning, {SCORES} FROM cells)""", *SIGNAL_VIEWS)
oracle("signal_summary", case_signals() + """
    SELECT count(*) AS total_pairs, count(*) FILTER (is_signal) AS signals,
           count(*) FILTER (masking_warning) AS masking FROM signals""", *SIGNAL_VIEWS)
oracle("signals_per_drug", case_signals() + """
    SELECT drug, count(*) AS pairs, count(*) FILTER (is_signal) AS signals FROM signals GROUP BY drug""", *SIGNAL_VIEWS)
oracle("top_signals", LOW + """
    SELECT drug, reaction, prr, ror, n_cases FROM signals WHERE is_signal
    ORDER BY prr DESC, drug, reaction LIMIT 20""", *SIGNAL_VIEWS)
oracle("signal_filter", LOW + f"""
    SELECT drug, reaction, prr, n_cases, is_signal, masking_warning FROM signals
    WHERE drug IN ({quoted(CHOSEN)}) AND prr >= 1.1 AND is_signal""", *SIGNAL_VIEWS)
oracle("heatmap", LOW + f""",
    shown AS (SELECT * FROM signals WHERE drug IN ({quoted(CHOSEN)}) AND prr >= 1.1 AND is_signal),
    top AS (SELECT reaction FROM shown GROUP BY reaction ORDER BY sum(n_cases) DESC, reaction LIMIT 20)
    SELECT reaction, {", ".join(f"coalesce(max(prr) FILTER (drug = '{c}'), 0.0) AS \"{c}\"" for c in CHOSEN)}
    FROM shown WHERE reaction IN (SELECT reaction FROM top) GROUP BY reaction""", *SIGNAL_VIEWS)
oracle("controls", LOW + f""",
    known(drug, reaction) AS (VALUES {", ".join(f"('{x}', '{y}')" for x, y in CONTROLS)})
    SELECT k.drug, k.reaction, prr, ror, chi2, n_cases, coalesce(is_signal, FALSE) AS is_signal,
           masking_warning, prr IS NOT NULL AS found,
           CASE WHEN prr IS NULL THEN 'NOT FOUND' WHEN prr >= 1.1 THEN 'PASS'
                WHEN k.drug = 'Brand#13' THEN 'WEAK' ELSE 'FAIL' END AS status,
           CASE WHEN is_signal THEN 'PASS' ELSE 'FAIL' END AS signal_status
    FROM known k LEFT JOIN signals s ON s.drug = k.drug AND s.reaction = k.reaction""", *SIGNAL_VIEWS)
LISTS = """,
    wanted AS (SELECT p_partkey, i, j, lower(d.drug) AS drug, lower(t.term) AS term FROM part,
        LATERAL (SELECT unnest([p_brand, lower(p_brand), 'Brand#7']) AS drug, unnest([1, 2, 3]) AS i) d,
        LATERAL (SELECT unnest([upper(p_name), 'old bolt']) AS term, unnest([1, 2]) AS j) t),
    hits AS (SELECT w.p_partkey, row_number() OVER (PARTITION BY w.p_partkey ORDER BY i, j) AS place,
                    s.drug, s.reaction, s.prr, s.ror, s.chi2, s.n_cases, s.masking_warning
             FROM wanted w JOIN signals s ON lower(s.drug) = w.drug AND lower(s.reaction) = w.term WHERE s.is_signal)"""
oracle("signal_lookup", LOW + LISTS + " SELECT * FROM hits", *SIGNAL_VIEWS)
oracle("signal_flag", LOW + LISTS + """
    SELECT p_partkey, CASE WHEN max(prr) IS NULL THEN 'noise' WHEN max(prr) >= 1.6 THEN 'high'
                           WHEN max(prr) >= 1.3 THEN 'medium' ELSE 'low' END AS signal_flag
    FROM part LEFT JOIN hits USING (p_partkey) GROUP BY p_partkey""", *SIGNAL_VIEWS)

# --- case reports ------------------------------------------------------------------------

AGE = """CASE WHEN years BETWEEN 0 AND 150 THEN round(years, 6) END"""
AGED = """SELECT *, CASE upper(age_cod) WHEN 'YR' THEN v WHEN 'DEC' THEN v * 10 WHEN 'MON' THEN v / 12
                        WHEN 'WK' THEN v / 52 WHEN 'DY' THEN v / 365 WHEN 'HR' THEN v / 8760 END AS years
          FROM (SELECT *, TRY_CAST(age AS DOUBLE) AS v FROM demo_raw)"""
DATED = "TRY_STRPTIME(CASE WHEN length(fda_dt) = 8 THEN fda_dt END, '%Y%m%d')::DATE"
oracle("age_years", f"SELECT caseid, age, age_cod, {AGE} AS age_years FROM ({AGED})", "demo_raw")
oracle("report_date", f"SELECT caseid, fda_dt, {DATED} AS report_date FROM demo_raw", "demo_raw")
oracle("latest_version", """
    SELECT * EXCLUDE rk FROM (
      SELECT *, row_number() OVER (PARTITION BY caseid ORDER BY caseversion DESC NULLS LAST, age NULLS LAST,
        age_cod NULLS LAST, fda_dt NULLS LAST, rept_dt, sex NULLS LAST, occr_country NULLS LAST, serious NULLS LAST) AS rk
      FROM demo_raw) WHERE rk = 1""", "demo_raw")
CASES = f"""cleaned AS (
      SELECT caseid, TRY_CAST(caseversion AS INT) AS caseversion, {AGE} AS age_years, trim(upper(sex)) AS sex,
             {DATED} AS report_date, occr_country AS country,
             CASE trim(serious) WHEN '1' THEN TRUE WHEN '2' THEN FALSE END AS serious, years
      FROM ({AGED})),
    built AS (SELECT * EXCLUDE (rk, years) FROM (
      SELECT *, row_number() OVER (PARTITION BY caseid ORDER BY caseversion DESC NULLS LAST,
        CASE WHEN years BETWEEN 0 AND 150 THEN years END NULLS LAST, sex NULLS LAST, report_date NULLS LAST,
        country NULLS LAST, serious NULLS LAST) AS rk FROM cleaned) WHERE rk = 1)"""
oracle("case_build", f"WITH {CASES} SELECT * FROM built", "demo_raw")
oracle("dedupe_first", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey,
        l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rk
      FROM lineitem) WHERE rk = 1""")


def drugs_sql(cases: str) -> str:
    return f"""
      SELECT * EXCLUDE rk FROM (
        SELECT *, row_number() OVER (PARTITION BY caseid, drug_seq ORDER BY drugname_raw NULLS LAST, role_cod NULLS LAST) AS rk
        FROM (SELECT caseid, TRY_CAST(drug_seq AS INT) AS drug_seq, coalesce(nullif(prod_ai, ''), drugname) AS drugname_raw,
                     CAST(NULL AS VARCHAR) AS drugname_norm, CAST(NULL AS VARCHAR) AS rxnorm_rxcui, role_cod FROM drug_raw)
        WHERE {any_of("lower(drugname_raw)", TARGETS)} AND caseid IN (SELECT caseid FROM {cases})) WHERE rk = 1"""


def reactions_sql(cases: str) -> str:
    return f"""
      SELECT caseid, row_number() OVER (PARTITION BY caseid ORDER BY pt_name)::INT AS reac_seq, pt_name
      FROM (SELECT DISTINCT caseid, trim(pt) AS pt_name FROM reac_raw) WHERE caseid IN (SELECT caseid FROM {cases})"""


oracle("drug_build", drugs_sql("known_cases"), "drug_raw", "known_cases")
oracle("reac_build", reactions_sql("known_cases"), "reac_raw", "known_cases")
oracle("target_filter", f"SELECT * FROM raw_names WHERE {any_of('lower(drugname_raw)', TARGETS)}", "raw_names")
oracle("first_target", """
    SELECT * FROM (SELECT *, CASE WHEN contains(n, 'red') THEN 'red' WHEN contains(n, 'ring') THEN 'ring'
                                  WHEN contains(n, 'bolt') THEN 'bolt' WHEN contains(n, 'hcl') THEN 'hcl' END AS drug_norm
                   FROM (SELECT *, lower(drugname_raw) AS n FROM raw_names)) WHERE drug_norm IS NOT NULL""".replace(
    "SELECT * FROM (SELECT *, CASE", "SELECT p_partkey, drugname_raw, drug_norm FROM (SELECT *, CASE"), "raw_names")
SERIOUS = """flags AS (SELECT caseid, count(*) FILTER (upper(trim(outc_cod)) IN ('DE','LT','HO','DS','CA','RI')) > 0 AS hit
                       FROM outc_raw GROUP BY caseid),
             flagged AS (SELECT k.caseid, coalesce(f.hit, k.serious) AS serious
                         FROM known_cases k LEFT JOIN flags f ON k.caseid = f.caseid)"""
oracle("seriousness", f"WITH {SERIOUS} SELECT * FROM flagged", "outc_raw", "known_cases")
oracle("serious_dist", f"WITH {SERIOUS} SELECT serious, count(*) AS n FROM flagged GROUP BY serious", "outc_raw", "known_cases")


def coverage_sql(cases: str, drugs: str, reactions: str) -> str:
    return f"""
    SELECT count(DISTINCT c.caseid) AS total_cases, count(DISTINCT d.caseid) AS cases_with_drugs,
           count(DISTINCT r.caseid) AS cases_with_reactions, count(d.caseid) AS total_drug_records,
           count(r.caseid) AS total_reaction_records,
           (SELECT count(*) FROM {drugs} x WHERE x.caseid IN (SELECT caseid FROM {cases})) AS drug_rows,
           (SELECT count(*) FROM {reactions} x WHERE x.caseid IN (SELECT caseid FROM {cases})) AS reaction_rows
    FROM {cases} c LEFT JOIN {drugs} d ON c.caseid = d.caseid LEFT JOIN {reactions} r ON c.caseid = r.caseid"""


oracle("coverage", coverage_sql("cases", "case_drugs", "case_reactions"), *SIGNAL_VIEWS)
oracle("table_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("orders", "lineitem", "part", "documents", "events")
) + " UNION ALL SELECT 'not_there', 0")

# --- drug names --------------------------------------------------------------------------

oracle("salt_strip", f"""
    SELECT p_partkey, trim(regexp_replace(regexp_replace(drugname_raw, '\\b({"|".join(K.SALT_WORDS)})\\b', '', 'gi'), '\\s+', ' ', 'g')) AS stripped
    FROM raw_names""", "raw_names")
KEYWORDS = "keywords(place, word, generic, code) AS (VALUES " + ", ".join(
    f"({i}, '{w.strip()}', '{g}', '{c}')"
    for i, (w, g, c) in enumerate((w, g, c) for g, c, words in NOUNS for w in words)
) + ")"


def matched_sql(source: str) -> str:
    return f"""{KEYWORDS},
    names AS (SELECT DISTINCT drugname_raw FROM {source}),
    matched AS (SELECT drugname_raw, generic AS drugname_norm, code AS rxnorm_rxcui,
                       CASE WHEN word IS NULL THEN 0.0::DOUBLE WHEN lower(trim(drugname_raw)) = word THEN 100.0::DOUBLE ELSE 90.0::DOUBLE END AS match_score
                FROM (SELECT n.drugname_raw, k.*, row_number() OVER (PARTITION BY n.drugname_raw ORDER BY length(word) DESC, place) AS rk
                      FROM names n LEFT JOIN keywords k ON contains(lower(trim(n.drugname_raw)), k.word)) WHERE rk = 1)"""


oracle("keyword_match", f"WITH {matched_sql('raw_names')} SELECT * FROM matched", "raw_names")
LOOKUP = """stacked AS (
      SELECT 0 AS place, upper(trim(FULL_GENERIC_NAME)) AS display_name, RXCUI AS rxcui, lower(trim(FULL_GENERIC_NAME)) AS generic_name FROM terms_file
      UNION ALL SELECT 1, upper(trim(DISPLAY_NAME)), RXCUI, lower(trim(FULL_GENERIC_NAME)) FROM terms_file
      UNION ALL SELECT 2, upper(trim(BRAND_NAME)), RXCUI, lower(trim(FULL_GENERIC_NAME)) FROM terms_file),
    lookup AS (SELECT display_name, rxcui, generic_name FROM (
      SELECT *, row_number() OVER (PARTITION BY display_name ORDER BY place, rxcui, generic_name) AS rk
      FROM stacked WHERE display_name <> '') WHERE rk = 1)"""
oracle("vocab_lookup", f"WITH {LOOKUP} SELECT * FROM lookup", "terms_file")
# longest common subsequence as a table-row recurrence over two nested folds
LCS = """list_reduce(
        list_transform(string_split({a}, ''), lambda ch: [unicode(ch)]),
        lambda line, x: list_reduce(
            list_transform(range(1, length({b}) + 1), lambda j: [j::INT]),
            lambda done, j: list_append(done, CASE WHEN unicode(substr({b}, j[1], 1)) = x[1] THEN line[j[1]] + 1
                                                  ELSE greatest(line[j[1] + 1], done[j[1]]) END), [0::INT]),
        list_transform(range(0, length({b}) + 1), lambda j: 0::INT))[length({b}) + 1]"""
FUZZY = f"""{LOOKUP},
    names AS (SELECT DISTINCT drugname_raw, upper(trim(drugname_raw)) AS whole,
                upper(trim(regexp_replace(regexp_replace(drugname_raw, '\\b({"|".join(K.SALT_WORDS)})\\b', '', 'gi'), '\\s+', ' ', 'g'))) AS bare
              FROM raw_names),
    forms AS (SELECT drugname_raw, whole, 1 AS form, whole AS name FROM names
              UNION ALL SELECT drugname_raw, whole, 0, bare FROM names WHERE bare <> whole AND bare <> ''),
    sides AS (SELECT f.*, l.*, array_to_string(list_sort(list_filter(string_split(name, ' '), lambda w: w <> '')), ' ') AS a,
                     array_to_string(list_sort(list_filter(string_split(display_name, ' '), lambda w: w <> '')), ' ') AS b
              FROM forms f, lookup l WHERE whole NOT IN (SELECT display_name FROM lookup)),
    texts AS (SELECT DISTINCT a, b FROM sides),
    scores AS (SELECT a, b, 200.0::DOUBLE * {LCS.format(a="a", b="b")} / (length(a) + length(b)) AS score FROM texts),
    best AS (SELECT drugname_raw, generic_name, rxcui, score FROM (
      SELECT *, row_number() OVER (PARTITION BY drugname_raw ORDER BY score DESC, form, display_name) AS rk
      FROM sides JOIN scores USING (a, b)) WHERE rk = 1),
    fuzzy AS (
    SELECT drugname_raw, generic_name AS drugname_norm, rxcui AS rxnorm_rxcui, 100.0::DOUBLE AS match_score
    FROM names JOIN lookup ON whole = display_name
    UNION ALL SELECT drugname_raw, CASE WHEN score >= 80 THEN generic_name END, CASE WHEN score >= 80 THEN rxcui END, round(score, 1)
    FROM best)"""
for name in ("fuzzy_match", "fuzzy_match_blocks"):
    oracle(name, f"WITH {FUZZY} SELECT * FROM fuzzy", "raw_names", "terms_file")
oracle("normalize_fuzzy", f"""WITH {FUZZY}
    SELECT r.p_partkey, r.drugname_raw, f.drugname_norm, CASE WHEN f.drugname_norm IS NOT NULL THEN f.rxnorm_rxcui END AS rxnorm_rxcui
    FROM raw_names r LEFT JOIN fuzzy f USING (drugname_raw)""", "raw_names", "terms_file")
NORMALIZED = f"""{matched_sql('drug_names')},
    done AS (SELECT d.caseid, d.drug_seq, d.drugname_raw, coalesce(m.drugname_norm, d.drugname_norm) AS drugname_norm,
                    coalesce(m.rxnorm_rxcui, d.rxnorm_rxcui) AS rxnorm_rxcui
             FROM drug_names d LEFT JOIN matched m ON d.drugname_raw = m.drugname_raw)"""
oracle("normalize_apply", f"WITH {NORMALIZED} SELECT * FROM done", "drug_names")
oracle("normalize_direct", f"WITH {NORMALIZED} SELECT * FROM done", "drug_names")
oracle("norm_coverage", f"""WITH {NORMALIZED}
    SELECT count(*) AS total_drugs, count(drugname_norm) AS normalized,
           round(count(drugname_norm) * 100.0::DOUBLE / count(*), 1) AS pct_normalized FROM done""", "drug_names")
oracle("variant_collapse", f"""WITH {NORMALIZED}
    SELECT drugname_raw, drugname_norm, count(*) AS n FROM done WHERE drugname_norm IN ('ring', 'bolt')
    GROUP BY ALL ORDER BY n DESC, drugname_raw, drugname_norm LIMIT 20""", "drug_names")
oracle("top_drugs", """
    SELECT drugname_norm, count(*) AS n FROM case_drugs GROUP BY ALL ORDER BY n DESC, drugname_norm LIMIT 15""", "case_drugs")
oracle("match_stats", f"""WITH {matched_sql('raw_names')}
    SELECT count(*) AS total, count(drugname_norm) AS matched, count(*) - count(drugname_norm) AS unmatched,
           round(count(drugname_norm) * 100.0::DOUBLE / count(*), 1) AS match_rate_pct FROM matched""", "raw_names")
oracle("mapping_samples", f"""WITH {matched_sql('raw_names')}
    (SELECT 'matched' AS kind, *, (SELECT greatest(count(*) - 15, 0) FROM matched WHERE drugname_norm IS NOT NULL) AS n_more
     FROM matched WHERE drugname_norm IS NOT NULL ORDER BY drugname_raw LIMIT 15)
    UNION ALL
    (SELECT 'unmatched', *, (SELECT greatest(count(*) - 10, 0) FROM matched WHERE drugname_norm IS NULL)
     FROM matched WHERE drugname_norm IS NULL ORDER BY drugname_raw LIMIT 10)""", "raw_names")
oracle("distinct_terms", "SELECT DISTINCT drugname_raw FROM raw_names", "raw_names")

# --- reviews -----------------------------------------------------------------------------

BLANKS = (
    "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
    "\\x{202F}\\x{205F}\\x{3000}]+"
)


def cleaned_sql(column: str) -> str:
    for pattern, new in K.MARKUP:
        column = "regexp_replace({}, '{}', '{}', 'gi')".format(
            column, pattern.replace("'", "''"), new.replace("'", "''")
        )
    return f"trim(regexp_replace({column}, '{BLANKS}', ' ', 'g'))"


def unquoted_sql(column: str) -> str:
    return f"""CASE WHEN starts_with({column}, '"') AND ends_with({column}, '"')
                    THEN trim(substr({column}, 2, greatest(length({column}) - 2, 0))) ELSE {column} END"""


oracle("html_clean", f"SELECT page_id, {unquoted_sql('t')} AS clean FROM (SELECT page_id, {cleaned_sql('html')} AS t FROM pages)")
WORDS = "len(string_split(t, ' '))"
oracle("word_filter", f"""
    SELECT doc_id, {WORDS} AS word_count FROM (
      SELECT doc_id, {unquoted_sql('t')} AS t FROM (SELECT doc_id, {cleaned_sql('text')} AS t FROM documents))
    WHERE t <> '' AND {WORDS} > 20""")
oracle("ae_flag", f"SELECT doc_id, {any_of('lower(text)', STEMS)} AS has_ae_mention FROM documents")
oracle("review_id", "SELECT doc_id, sha256(source || chr(31) || text) AS review_id FROM documents")
REVIEWS = f"""named AS (SELECT *, CASE {" ".join(f"WHEN contains(lower(drugname), '{s}') THEN '{s}'" for s in SOURCES)} END AS drug_norm FROM reviews_raw),
    cleaned AS (SELECT * EXCLUDE t, {unquoted_sql('t')} AS t FROM (SELECT *, {cleaned_sql('review')} AS t FROM named WHERE drug_norm IS NOT NULL)),
    rows_ AS (SELECT sha256(drugname || chr(31) || t) AS review_id, drugname AS drug_name, drug_norm,
                     condition, t AS review_text, TRY_CAST(TRY_CAST(rating AS DOUBLE) AS INT) AS rating, {WORDS}::INT AS word_count,
                     source, {any_of('lower(t)', STEMS)} AS has_ae_mention
              FROM cleaned WHERE t <> '' AND {WORDS} > 20),
    built AS (SELECT * EXCLUDE rk FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY drug_name, drug_norm, condition,
                     review_text, rating, word_count, source, has_ae_mention) AS rk FROM rows_) WHERE rk = 1)"""
oracle("review_build", f"WITH {REVIEWS} SELECT * FROM built", "reviews_raw")
oracle("review_dist", f"""WITH {REVIEWS}
    SELECT drug_norm, count(*) AS total_reviews, count(*) FILTER (has_ae_mention) AS ae_reviews FROM built GROUP BY drug_norm""", "reviews_raw")
oracle("label_sheet", f"""WITH {REVIEWS}
    SELECT review_id, drug_norm, substr(review_text, 1, 200) AS review_text_preview, '' AS drugs_gt, '' AS reactions_gt,
           '' AS severity_gt, '' AS notes FROM built WHERE has_ae_mention ORDER BY review_id LIMIT 50""", "reviews_raw")
# words and the gaps between them in order, with the running length as the position
PIECES = """pieces AS (
      SELECT review_id, k, piece, coalesce(sum(length(piece)) OVER (PARTITION BY review_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char
      FROM (SELECT review_id, unnest(p) AS piece, unnest(range(len(p))) AS k
            FROM (SELECT review_id, regexp_extract_all(review_text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+') AS p FROM reviews))),
    seen AS (SELECT *, lower(piece) AS word, lag(lower(piece), 2) OVER w AS word_before, lag(piece) OVER w AS gap_before,
                    lead(piece) OVER w AS gap, lead(piece, 2) OVER w AS next_word
             FROM pieces WINDOW w AS (PARTITION BY review_id ORDER BY k)),"""
MENTIONS = PIECES + f"""
    found AS (
      SELECT review_id, piece || gap || next_word AS entity_text, 'DISEASE' AS entity_label, start_char
      FROM seen WHERE word = 'of' AND gap = ' ' AND lower(next_word) = 'the'
      UNION ALL SELECT review_id, piece, CASE word {" ".join(f"WHEN '{t}' THEN '{c}'" for t, c in TERMS if " " not in t)} END, start_char
      FROM seen WHERE word IN ({quoted(t for t, _ in TERMS if " " not in t)})
        AND NOT (word = 'the' AND coalesce(word_before, '') = 'of' AND coalesce(gap_before, '') = ' '))"""
oracle("mentions", f"""WITH {MENTIONS}
    SELECT review_id, entity_text, entity_label, start_char::INT AS start_char, (start_char + length(entity_text))::INT AS end_char FROM found""", "reviews")
oracle("mention_coverage", f"""WITH {MENTIONS}
    SELECT entity_label, count(*) AS total_entities, count(DISTINCT review_id) AS reviews_covered FROM found GROUP BY ALL""", "reviews")
oracle("unprocessed", """
    SELECT review_id, drug_norm FROM reviews WHERE has_ae_mention AND review_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""", "reviews")
oracle("unprocessed_only", """
    SELECT review_id, drug_norm FROM reviews WHERE has_ae_mention AND review_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)
    AND review_id IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations)""", "reviews")
oracle("score_texts", """
    SELECT doc_id, length(text) || ':' || CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS VARCHAR) AS raw_output
    FROM documents""")

# --- triage ------------------------------------------------------------------------------


def listed_sql(field: str) -> str:
    pattern = f'"{field}"\\s*:\\s*\\[([^\\]]*)\\]'
    return f"""CASE WHEN regexp_matches(raw, '{pattern}') THEN
        list_filter(list_transform(string_split(regexp_extract(raw, '{pattern}', 1), ','),
                                   lambda v: trim(trim(trim(v), '"'), '''')), lambda v: v <> '') END"""


def from_object_sql(field: str) -> str:
    return f"""CASE WHEN json_type(js, '$.{field}') = 'ARRAY' THEN CAST(json_extract(js, '$.{field}') AS VARCHAR[]) END"""


PARSED = f"""bare AS (SELECT *, trim(regexp_replace(regexp_replace(trim(raw), '^```(?:json)?\\s*', ''), '\\s*```$', ''), E' \\n') AS direct,
                  regexp_extract(raw, '(?s)\\{{.*\\}}') AS block FROM outputs),
    objects AS (SELECT *, CASE WHEN starts_with(direct, '{{') AND json_valid(direct) THEN direct
                               WHEN block <> '' AND json_valid(block) THEN block END AS js,
                       {listed_sql("drugs")} AS ld, {listed_sql("reactions")} AS lr,
                       regexp_extract(raw, '"severity"\\s*:\\s*"(serious|non-serious|unknown)"', 1) AS ls FROM bare),
    parsed AS (SELECT report_id, attempt, drug_norm, raw,
                 CASE WHEN js IS NOT NULL THEN 'json' WHEN ld IS NOT NULL OR lr IS NOT NULL THEN 'regex_fallback' END AS method,
                 CASE WHEN js IS NOT NULL THEN coalesce({from_object_sql("drugs")}, []::VARCHAR[])
                      WHEN ld IS NOT NULL OR lr IS NOT NULL THEN coalesce(ld, []::VARCHAR[]) END AS drugs,
                 CASE WHEN js IS NOT NULL THEN coalesce({from_object_sql("reactions")}, []::VARCHAR[])
                      WHEN ld IS NOT NULL OR lr IS NOT NULL THEN coalesce(lr, []::VARCHAR[]) END AS reactions,
                 CASE WHEN js IS NOT NULL THEN json_extract_string(js, '$.severity')
                      WHEN ld IS NOT NULL OR lr IS NOT NULL THEN CASE WHEN ls = '' THEN 'unknown' ELSE ls END END AS sev
               FROM objects),
    scored AS (SELECT report_id, attempt, drug_norm, coalesce(drugs, []::VARCHAR[]) AS drugs, coalesce(reactions, []::VARCHAR[]) AS reactions,
                 coalesce(sev, 'unknown') AS severity, coalesce(method, 'failed') AS method,
                 CASE WHEN method IS NULL THEN 0.0::DOUBLE ELSE round(0.40::DOUBLE
                   + ((len(drugs) > 0)::INT + (len(reactions) > 0)::INT + coalesce(sev IN ('serious', 'non-serious', 'unknown'), FALSE)::INT)::DOUBLE / 3 * 0.35::DOUBLE
                   + CASE WHEN len(drugs) > 0 THEN len(list_filter(drugs, lambda x: {any_of("lower(trim(x))", [w for _, _, ws in BRANDS for w in ws])}))::DOUBLE
                                                 / len(drugs) ELSE 0.0::DOUBLE END * 0.25::DOUBLE, 3) END AS confidence
               FROM parsed)"""
oracle("parse_output", f"""WITH {PARSED}
    SELECT report_id, attempt, array_to_string(drugs, '|') AS drugs, array_to_string(reactions, '|') AS reactions,
           sev AS severity, method FROM parsed""", "outputs")
oracle("confidence", f"WITH {PARSED} SELECT report_id, attempt, method, severity, confidence FROM scored", "outputs")
ROUTED = PARSED + """,
    decided AS (SELECT report_id, min(attempt) FILTER (confidence >= 0.75) AS hit, max(attempt) AS last_try, count(*) AS tries
                FROM scored GROUP BY report_id),
    routed AS (SELECT s.*, CASE WHEN hit IS NOT NULL THEN 'map_terms' WHEN tries >= 3 THEN 'flag_human' ELSE 'extract' END AS route
               FROM decided d JOIN scored s ON s.report_id = d.report_id AND s.attempt = coalesce(hit, last_try)),
    entries AS (SELECT s.report_id, string_agg(
                  CASE WHEN s.attempt > 1 THEN 'EXTRACTION_RETRY:' ELSE 'EXTRACTION:' END || s.attempt || ',conf=' || s.confidence || ',drugs='
                  || CASE WHEN s.method = 'failed' THEN 'none' ELSE array_to_string(s.drugs[1:3], ',') END
                  || '|VALIDATION:conf=' || s.confidence || ',retries=' || s.attempt, '|' ORDER BY s.attempt) AS trace
                FROM scored s JOIN routed r ON s.report_id = r.report_id AND s.attempt <= r.attempt GROUP BY s.report_id)"""
oracle("route_attempts", f"""WITH {ROUTED}
    SELECT report_id, route, attempt, confidence, trace AS agent_trace FROM routed JOIN entries USING (report_id)""", "outputs")
TRIAGE_VIEWS = ("outputs", "term_map", *SIGNAL_VIEWS)
TRIAGE = LOW + ", " + ROUTED + """,
    spoken AS (SELECT report_id, unnest(reactions) AS text, unnest(range(len(reactions))) AS pos FROM routed WHERE route = 'map_terms'),
    mapped AS (SELECT report_id, pos, coalesce(m.mapped_term, s.text) AS pt, coalesce(m.similarity, 0.0) AS score
               FROM spoken s LEFT JOIN term_map m ON s.text = m.text),
    terms AS (SELECT report_id, list(pt ORDER BY pos) AS pts, list(score ORDER BY pos) AS scores FROM mapped GROUP BY report_id),
    asked AS (SELECT report_id, unnest(drugs) AS drug, unnest(range(len(drugs))) AS i FROM routed WHERE route = 'map_terms'),
    found AS (SELECT a.report_id, a.i, m.pos, s.* FROM asked a JOIN mapped m ON a.report_id = m.report_id
              JOIN signals s ON lower(s.drug) = lower(a.drug) AND lower(s.reaction) = lower(m.pt) WHERE s.is_signal),
    hits AS (SELECT report_id, count(*) AS n, max(prr) AS top, string_agg(drug || '/' || reaction || '/' || prr, '|' ORDER BY i, pos) AS text
             FROM found GROUP BY report_id),
    flat AS (SELECT r.*, coalesce(pts, []::VARCHAR[]) AS pts, coalesce(scores, []::DOUBLE[]) AS scores, coalesce(n, 0) AS n,
                    top, coalesce(h.text, '') AS hits_text, trace, route = 'flag_human' AS flagged,
                    CASE WHEN top IS NULL THEN 'noise' WHEN top >= 10 THEN 'high' WHEN top >= 5 THEN 'medium' ELSE 'low' END AS flag
             FROM routed r JOIN entries USING (report_id) LEFT JOIN terms USING (report_id) LEFT JOIN hits h USING (report_id)
             WHERE route <> 'extract'),
    results AS (SELECT report_id AS review_id, drug_norm, array_to_string(drugs, '|') AS extracted_drugs,
                  array_to_string(reactions, '|') AS extracted_reactions, array_to_string(pts, '|') AS meddra_pts,
                  array_to_string(scores, '|') AS mapping_scores, hits_text AS prr_signals, severity,
                  confidence AS extraction_confidence, CASE WHEN NOT flagged THEN flag END AS signal_flag, flagged AS needs_human_review,
                  trace || '|' || CASE WHEN flagged THEN 'HUMAN_FLAG:reason=low_confidence' ELSE
                    CASE WHEN len(reactions) > 0 THEN 'MAPPING:reactions=' || len(reactions) || ',top_pt=' || pts[1] || ',top_score=' || scores[1]
                         ELSE 'MAPPING:no_reactions_to_map' END || '|' ||
                    CASE WHEN len(drugs) > 0 AND len(pts) > 0
                         THEN 'SIGNAL_CHECK:signals=' || n || ',flag=' || flag || ',top_prr='
                              || printf('%.2f', round(coalesce(top, 0)::DECIMAL(18, 3), 2)::DOUBLE)
                         ELSE 'SIGNAL_CHECK:no_input,flag=noise' END END AS agent_trace, drugs, reactions, pts, trace
                FROM flat)"""
RESULT = """review_id, drug_norm, extracted_drugs, extracted_reactions, meddra_pts, mapping_scores, prr_signals,
    severity, extraction_confidence, signal_flag, needs_human_review, agent_trace"""
oracle("triage", f"{TRIAGE} SELECT {RESULT} FROM results", *TRIAGE_VIEWS)
oracle("stream_triage", f"{TRIAGE} SELECT {RESULT} FROM results", *TRIAGE_VIEWS)
oracle("result_detail", TRIAGE + """
    SELECT r.review_id, CAST(to_json(r.drugs) AS VARCHAR) AS extracted_drugs, CAST(to_json(r.pts) AS VARCHAR) AS meddra_pts,
           r.signal_flag, v.review_text
    FROM results r JOIN reviews v ON r.review_id = v.review_id""", *TRIAGE_VIEWS, "reviews")
oracle("run_summary", TRIAGE + """
    SELECT count(*) AS n, count(*) FILTER (extraction_confidence >= 0.75) AS confident, count(*) FILTER (needs_human_review) AS human_flagged,
           count(*) FILTER (NOT needs_human_review) AS mapped, 0::BIGINT AS cached,
           count(*) FILTER (signal_flag = 'high') AS flag_high, count(*) FILTER (signal_flag = 'medium') AS flag_medium,
           count(*) FILTER (signal_flag = 'low') AS flag_low, count(*) FILTER (coalesce(signal_flag, 'noise') = 'noise') AS flag_noise,
           count(*) FILTER (coalesce(signal_flag, 'noise') <> 'noise') AS with_signals FROM results""", *TRIAGE_VIEWS)
oracle("conf_hist", f"""WITH {PARSED}
    SELECT bin::INT AS bin, round((bin - 1)::DOUBLE / 20, 4) AS low, count(*) AS n
    FROM (SELECT least(floor(confidence * 20) + 1, 20) AS bin FROM scored) GROUP BY bin""", "outputs")
oracle("flag_dist", TRIAGE + " SELECT signal_flag, count(*) AS n FROM results GROUP BY signal_flag", *TRIAGE_VIEWS)
oracle("recent_results", TRIAGE + """
    SELECT * FROM (SELECT review_id, signal_flag, (length(review_id) + len(string_split(agent_trace, '|')))::INT AS processed_at FROM results
                   ORDER BY processed_at DESC, review_id LIMIT 200) WHERE signal_flag = 'low'""", *TRIAGE_VIEWS)
oracle("trace_steps", TRIAGE + """
    SELECT review_id, step::INT AS step, split_part(entry, ':', 1) AS stage, entry
    FROM (SELECT review_id, unnest(string_split(agent_trace, '|')) AS entry,
                 unnest(range(1, len(string_split(agent_trace, '|')) + 1)) AS step FROM results)""", *TRIAGE_VIEWS)
NEAREST = """WITH known AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    asked AS (SELECT vec_id, list_transform(e, lambda x, i: CASE WHEN i <= 10 THEN -x ELSE x END) AS q FROM known),
    near AS (SELECT a.vec_id, k.vec_id AS term,
               round((1 + list_inner_product(q, e) / sqrt(list_inner_product(q, q) * list_inner_product(e, e))) / 2, 12) AS s
             FROM asked a, known k),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, term) AS rk FROM near) WHERE rk = 1)
    SELECT 'q' || vec_id AS text, CASE WHEN s >= 0.85 THEN term END AS matched_term,
           CASE WHEN s >= 0.85 THEN CAST(term AS VARCHAR) ELSE 'q' || vec_id END AS mapped_term, round(s, 3) AS similarity FROM best"""
oracle("nearest_term", NEAREST)
oracle("nearest_term_blocks", NEAREST)
LETTERS = "[" + ", ".join(f"(length(t) - length(replace(lower(t), '{c}', '')))::DOUBLE" for c in "abdegilnort") + "]"
oracle("term_map", f"""WITH {PARSED},
    asked AS (SELECT t, {LETTERS} AS q FROM (SELECT DISTINCT unnest(reactions) AS t FROM scored)),
    known AS (SELECT t AS term, {LETTERS} AS e FROM (SELECT DISTINCT p_name AS t FROM part)),
    best AS (SELECT * FROM (SELECT a.t, k.term, round((1 + list_inner_product(q, e) / sqrt(list_inner_product(q, q) * list_inner_product(e, e))) / 2, 12) AS s,
               row_number() OVER (PARTITION BY a.t ORDER BY round((1 + list_inner_product(q, e) / sqrt(list_inner_product(q, q) * list_inner_product(e, e))) / 2, 12) DESC, k.term) AS rk
             FROM asked a, known k) WHERE rk = 1)
    SELECT t AS text, CASE WHEN s >= 0.85 THEN term ELSE t END AS mapped_term, round(s, 3) AS similarity FROM best""", "outputs")
HIT = """CASE WHEN (length(review_text) + 1) % 5 < 2 THEN 1 WHEN (length(review_text) + 2) % 5 < 2 THEN 2
                       WHEN (length(review_text) + 3) % 5 < 2 THEN 3 END AS hit"""
STAND_IN = """
    terms AS (SELECT 1 AS i, coalesce((SELECT mapped_term FROM term_map WHERE text = 'old bolt'), 'old bolt') AS pt,
                     coalesce((SELECT similarity FROM term_map WHERE text = 'old bolt'), 0.0::DOUBLE) AS score
              UNION ALL SELECT 2, coalesce((SELECT mapped_term FROM term_map WHERE text = 'red gear'), 'red gear'), 0.0),
    hits AS (SELECT count(*) AS n, max(prr) AS top, coalesce(string_agg(s.drug || '/' || s.reaction || '/' || prr, '|' ORDER BY i), '') AS found
             FROM terms JOIN signals s ON s.drug = 'Brand#3' AND lower(s.reaction) = lower(pt) WHERE is_signal),
    flags AS (SELECT *, CASE WHEN top IS NULL THEN 'noise' WHEN top >= 10 THEN 'high' WHEN top >= 5 THEN 'medium' ELSE 'low' END AS flag FROM hits)"""
oracle("triage_batch", LOW + f""",
    tried AS (SELECT review_id, drug_norm, {HIT} FROM reviews WHERE has_ae_mention),{STAND_IN}
    SELECT review_id, drug_norm, CASE WHEN hit IS NULL THEN '' ELSE (SELECT string_agg(pt, '|' ORDER BY i) FROM terms) END AS meddra_pts,
           CASE WHEN hit IS NULL THEN '' ELSE found END AS prr_signals, CASE WHEN hit IS NOT NULL THEN flag END AS signal_flag, hit IS NULL AS needs_human_review,
           'EXTRACTION:1,conf=' || CASE WHEN hit = 1 THEN '1.0,drugs=Brand#3|VALIDATION:conf=1.0' ELSE '0.0,drugs=none|VALIDATION:conf=0.0' END || ',retries=1'
           || CASE WHEN hit = 1 THEN '' ELSE '|EXTRACTION_RETRY:2,conf=' || CASE WHEN hit = 2 THEN '1.0,drugs=Brand#3|VALIDATION:conf=1.0' ELSE '0.0,drugs=none|VALIDATION:conf=0.0' END || ',retries=2' END
           || CASE WHEN hit <= 2 THEN '' ELSE '|EXTRACTION_RETRY:3,conf=' || CASE WHEN hit = 3 THEN '1.0,drugs=Brand#3|VALIDATION:conf=1.0' ELSE '0.0,drugs=none|VALIDATION:conf=0.0' END || ',retries=3' END
           || CASE WHEN hit IS NULL THEN '|HUMAN_FLAG:reason=low_confidence'
                   ELSE '|MAPPING:reactions=2,top_pt=' || (SELECT pt FROM terms WHERE i = 1) || ',top_score=' || (SELECT score FROM terms WHERE i = 1)
                        || '|SIGNAL_CHECK:signals=' || n || ',flag=' || flag || ',top_prr=' || printf('%.2f', round(coalesce(top, 0)::DECIMAL(18, 3), 2)::DOUBLE) END AS agent_trace
    FROM tried, flags""", "reviews", "term_map", *SIGNAL_VIEWS)
oracle("cached_summary", LOW + f""",
    delivered AS (SELECT review_text, FALSE AS same FROM reviews WHERE has_ae_mention
             UNION ALL SELECT CASE WHEN n_chars % 2 = 0 THEN review_text ELSE review_text || '!' END, n_chars % 2 = 0 FROM reviews WHERE has_ae_mention),
    tried AS (SELECT same, {HIT} FROM delivered),{STAND_IN}
    SELECT count(*) AS n, count(hit) AS confident, count(*) - count(hit) AS human_flagged, count(hit) AS mapped, count(*) FILTER (same) AS cached,
           {", ".join(f"count(*) FILTER (hit IS NOT NULL AND flag = '{f}') AS flag_{f}" for f in ("high", "medium", "low"))},
           count(*) FILTER (hit IS NULL OR flag = 'noise') AS flag_noise, count(*) FILTER (hit IS NOT NULL AND flag <> 'noise') AS with_signals
    FROM tried, flags""", "reviews", "term_map", *SIGNAL_VIEWS)
oracle("latency_stats", """
    SELECT round(avg(extract_latency_ms), 3) AS avg_extract, round(avg(map_terms_latency_ms), 3) AS avg_map_terms,
           round(avg(signal_check_latency_ms), 3) AS avg_signal_check, max(extract_latency_ms) AS max_extract,
           max(map_terms_latency_ms) AS max_map_terms, max(signal_check_latency_ms) AS max_signal_check
    FROM latencies WHERE extract_latency_ms IS NOT NULL""", "latencies")

# --- evaluation --------------------------------------------------------------------------


def label_set_sql(values: str) -> str:
    return f"list_distinct(list_filter(list_transform({values}, lambda v: lower(trim(v))), lambda v: v <> ''))"


def f1_sql(t: str, p: str) -> str:
    hits = f"len(list_intersect({t}, {p}))::DOUBLE"
    precision, recall = f"({hits} / len({p}))", f"({hits} / len({t}))"
    return f"""CASE WHEN len({t}) = 0 AND len({p}) = 0 THEN 1.0::DOUBLE WHEN len({t}) = 0 OR len({p}) = 0 OR {hits} = 0 THEN 0.0::DOUBLE
                    ELSE 2 * {precision} * {recall} / ({precision} + {recall}) END"""


EVALUATED = TRIAGE + ", " + MENTIONS.replace("found AS", "heard AS") + f""",
    tagged AS (SELECT review_id, list(DISTINCT lower(entity_text)) AS names FROM heard WHERE entity_label = 'CHEMICAL' GROUP BY review_id),
    sets AS (SELECT l.review_id, {label_set_sql("string_split(l.drugs_gt, ',')")} AS td, {label_set_sql("coalesce(string_split(l.reactions_gt, ','), []::VARCHAR[])")} AS tr,
                    {label_set_sql("r.drugs")} AS pd, {label_set_sql("r.reactions")} AS pr,
                    {label_set_sql("coalesce(g.names, []::VARCHAR[])")} AS pb, lower(l.severity_gt) = lower(r.severity) AS same,
                    len(r.reactions) AS nr, len(r.pts) AS np
             FROM label_rows l JOIN results r ON l.review_id = r.review_id LEFT JOIN tagged g ON l.review_id = g.review_id
             WHERE l.drugs_gt <> ''),
    f1s AS (SELECT *, {f1_sql("td", "pd")} AS drug_f1, {f1_sql("tr", "pr")} AS reaction_f1, {f1_sql("td", "pb")} AS baseline_f1 FROM sets)"""
EVAL_VIEWS = (*TRIAGE_VIEWS, "label_rows", "reviews")
oracle("eval_f1", EVALUATED + """
    SELECT review_id, round(drug_f1, 6) AS drug_f1, round(reaction_f1, 6) AS reaction_f1, round(baseline_f1, 6) AS baseline_f1 FROM f1s""", *EVAL_VIEWS)
ACCURACY = (EVALUATED + """
    SELECT count(*) AS n_evaluated, round(avg(drug_f1), 3) AS drug_extraction_f1, round(avg(reaction_f1), 3) AS reaction_extraction_f1,
           round(avg(same::INT), 3) AS severity_accuracy, round(sum(np)::DOUBLE / sum(nr), 3) AS meddra_mapping_accuracy,
           round(avg(baseline_f1), 3) AS baseline_drug_f1 FROM f1s""")
for name in ("eval_accuracy", "metrics_json"):
    oracle(name, ACCURACY, *EVAL_VIEWS)
oracle("label_file", """
    SELECT review_id, trim(drugs_gt) AS drugs_gt, reactions_gt, severity_gt,
           length(regexp_replace(review_text_preview, '\\s', '', 'g')) AS n_solid FROM label_rows WHERE drugs_gt <> ''""", "label_rows")
oracle("label_summary", """
    SELECT count(*) AS n_labels, count(*) FILTER (lower(severity_gt) = 'serious') AS n_serious,
           count(*) FILTER (lower(severity_gt) = 'non-serious') AS n_non_serious, count(*) FILTER (lower(severity_gt) = 'unknown') AS n_unknown,
           count(*) FILTER (coalesce(reactions_gt, '') <> '') AS with_reactions,
           count(*) FILTER (coalesce(reactions_gt, '') = '') AS without_reactions FROM label_rows""", "label_rows")
oracle("row_checks", """
    SELECT review_id, concat_ws('|', CASE WHEN rating NOT BETWEEN 1 AND 10 THEN 'rating' END,
                                CASE WHEN n_chars - 50 < 0 THEN 'word_count' END) AS broken FROM reviews""", "reviews")

# --- files and incremental jobs: the rows written are the rows read back ------------------

oracle("src_quarters", """
    SELECT '2024Q4 DEMO DEMO24Q4.txt' AS table_name, count(*) AS n FROM demo_raw WHERE coalesce(fda_dt < '1998', FALSE)
    UNION ALL SELECT '2025Q1 DEMO demo25q1.TXT', count(*) FROM demo_raw WHERE NOT coalesce(fda_dt < '1998', FALSE)
    UNION ALL SELECT '2024Q4 DRUG DRUG24Q4.txt', count(*) FROM drug_raw
    UNION ALL SELECT '2025Q1 REAC REAC25Q1.txt', count(*) FROM reac_raw
    UNION ALL SELECT '2024Q4 OUTC OUTC24Q4.txt', count(*) FROM outc_raw""", "demo_raw", "drug_raw", "reac_raw", "outc_raw")
oracle("src_dollar_csv", "SELECT caseid, age, sex, fda_dt FROM demo_raw", "demo_raw")
oracle("union_quarters", "SELECT caseid, caseversion, fda_dt, CASE WHEN fda_dt < '1998' THEN sex END AS sex FROM demo_raw", "demo_raw")
oracle("src_reviews", """
    SELECT source AS drugname, text AS review, CAST(doc_id AS VARCHAR) AS doc_id,
           CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS source FROM documents""")
oracle("src_vocab", f"WITH {LOOKUP} SELECT * FROM lookup", "terms_file")
oracle("snk_parquet", f"WITH {LOOKUP} SELECT * FROM lookup", "terms_file")
oracle("upsert", """WITH latest AS (SELECT l_orderkey AS id, max(l_extendedprice) AS amount FROM lineitem GROUP BY l_orderkey HAVING max(l_extendedprice) > 60000)
    SELECT o_orderkey AS id, coalesce(amount, o_totalprice) AS amount, CASE WHEN amount IS NULL THEN 'order' ELSE 'again' END AS origin
    FROM orders LEFT JOIN latest ON o_orderkey = id
    UNION ALL SELECT id, amount, 'again' FROM latest WHERE id NOT IN (SELECT o_orderkey FROM orders)""")
FLOW = f"""{CASES.replace("FROM (SELECT *, TRY_CAST(age AS DOUBLE) AS v FROM demo_raw)", "FROM (SELECT * REPLACE (CASE WHEN fda_dt < '1998' THEN sex END AS sex), TRY_CAST(age AS DOUBLE) AS v FROM demo_raw)")},
    new_drugs AS ({drugs_sql("built")}), new_reactions AS ({reactions_sql("built")})"""
FLOW_VIEWS = ("demo_raw", "drug_raw", "reac_raw")
oracle("ingest_flow", f"WITH {FLOW} " + coverage_sql("built", "new_drugs", "new_reactions"), *FLOW_VIEWS)
oracle("stage_status", f"""WITH {FLOW}
    SELECT 'cases' AS table_name, count(*) AS n, TRUE AS finished FROM built
    UNION ALL SELECT 'drugs', count(*), TRUE FROM new_drugs UNION ALL SELECT 'reactions', count(*), TRUE FROM new_reactions""", *FLOW_VIEWS)
