"""Quality rules over words, lines, and lines that many documents of a host share.

Lines are normalised (A-Z lower-cased, white space collapsed) and hashed. For every host and line
the distinct documents are counted; a line above the limit is boilerplate and is removed from the
documents of that host, and a document that loses too many of its words is rejected. Copies of one
document are no evidence of boilerplate: documents count as distinct by a key of all their normalised
lines, so copies of a text count once; texts that differ in a line are different documents.

All of it is DataFrame expressions; the join carries keys and counts only, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch.llm.common import free_prefix, row_key, stored

LIMIT = 20  # distinct documents of a host that may share a line
LEAST_LEFT = 0.5  # share of a document's words that must be left
BLANKS = "\t\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS + "\n", " " * 5), " "), "")


def line_words(line: Column) -> Column:
    """The words of a line, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(line, UPPER + BLANKS, LOWER + " " * 4), " "), "")


def line_hash(words: Column) -> Column:
    return F.xxhash64(F.md5(F.array_join(words, " ").cast("binary")))


def measured(docs: DataFrame) -> DataFrame:
    """The columns ``w`` (words) and ``lines`` (split lines with a word) become the base measures."""
    third = F.transform(
        "w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))
    )
    df = docs.withColumn("tri", F.when(F.size("w") > 2, F.slice(third, 1, F.greatest(F.size("w") - 2, F.lit(0)))))
    df = df.withColumn("sorted", F.when(
        F.size(F.array_distinct("tri")) < F.size("tri"),
        F.sort_array(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    near = lambda j: F.get("sorted", j)["h"]
    starts = F.transform(
        F.filter("sorted", lambda x, j: (x["h"] == near(j - 1)) | (x["h"] == near(j + 1))), lambda x: x["i"]
    )
    df = df.withColumn("starts", F.sort_array(starts))
    step = lambda s, i: F.struct(
        (s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n"), (i + 3).alias("end"))
    covered = F.aggregate("starts", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("tri", "sorted", "starts")


def rules(
    docs: DataFrame, host: str = "source", limit: int = LIMIT, least_left: float = LEAST_LEFT
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words,
    common (hashes of the lines above the limit that the document holds), k1, k2 (key of the row).

    A null text has no words and fails; a null host is a host of its own. Rows that repeat id, host and
    text are one document and share a verdict. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", F.col(host).alias("host"), text.alias("text")).select(
        "doc_id", "host", "text", row_key("doc_id", "host", "text").alias("k1"), F.hash("doc_id", "text", "host").alias("k2")
    )
    split = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANKS + " ", "")) > 0)
    base = docs.select("doc_id", "k1", "k2", "text", words_of(F.col("text")).alias("w"), split.alias("lines"))
    base = measured(base).select(
        "doc_id", "k1", "k2", F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS + "\n ", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
    )

    lines = docs.select("host", "k1", "k2", F.transform(F.split("text", "\n"), line_words).alias("all"))
    lines = lines.select("host", "k1", "k2", F.transform(
        F.filter("all", lambda x: F.size(x) > 0), lambda x: F.struct(line_hash(x).alias("line"), F.size(x).alias("n")),
    ).alias("all"))
    lines = lines.withColumn("text_id", F.xxhash64("all.line")).select("host", "k1", "k2", "text_id", F.explode("all").alias("l"))
    lines = lines.select(
        F.coalesce(F.xxhash64(F.col("host").isNull(), "host")).alias("host"), "k1", "k2",
        F.col("l.line").alias("line"), "text_id", F.col("l.n").alias("n"),
    )
    common = lines.groupBy("host", "line", "text_id").agg(F.lit(1)).groupBy("host", "line").agg(
        F.count("*").alias("documents")
    ).where(F.col("documents") > limit).select("host", "line")
    same = lines.groupBy("host", "line", "k1", "k2").agg(F.max("n").alias("n"), F.count("*").alias("times"))
    # a line that a document repeats is removed each time; the same row given twice is one document
    rows = base.groupBy("k1", "k2").agg(F.count("*").alias("rows")).where("rows > 1")
    removed = same.join(common, ["host", "line"]).join(rows, ["k1", "k2"], "left").groupBy("k1", "k2").agg(
        F.sum(F.col("n") * F.col("times") / F.coalesce("rows", F.lit(1))).cast("long").alias("n_removed_words"),
        F.collect_set("line").alias("common"),
    )
    n_removed = F.coalesce("n_removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base.join(removed, ["k1", "k2"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("n_words") - n_removed >= least_left * F.col("n_words"))).alias("kept"),
        n_removed.alias("n_removed_words"), "common", "k1", "k2",
    )


def kept_documents(docs: DataFrame, host: str = "source", **args) -> DataFrame:
    """The documents that pass, without the lines above the limit; their own columns, ``n_chars`` brought up to date.

    A line goes with its line break; blank lines stay. The verdicts are written before they are
    filtered: a filter on ``kept`` would otherwise be pushed into the base measures and compute their
    arrays anew for every element.
    """
    own = free_prefix(docs)
    text, home, k1, k2, common, new = (f"{own}{c}" for c in ("text", "host", "k1", "k2", "common", "new"))
    use = docs.withColumn(text, F.coalesce("text", F.lit(""))).withColumn(home, F.col(host))
    verdict = stored(rules(docs, host, **args).select("k1", "k2", "kept", "common"), "verdicts")
    verdict = verdict.where("kept").groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.first("common").alias(common))
    keys = use.withColumn(k1, row_key("doc_id", home, text)).withColumn(k2, F.hash("doc_id", text, home))
    stays = lambda x: ~F.array_contains(common, line_hash(line_words(x)))
    left = F.array_join(F.filter(F.split("text", "\n"), stays), "\n")
    out = keys.join(verdict, [k1, k2]).withColumn(new, F.when(F.col(common).isNotNull(), left).otherwise(F.col("text")))
    size = {"n_chars": F.when(F.col(common).isNotNull(), F.length(new).cast("long")).otherwise(F.col("n_chars"))}
    out = out.withColumns(size) if "n_chars" in docs.columns else out
    return out.withColumn("text", F.col(new)).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    return rules(docs).drop("common", "k1", "k2")


def oracle(table: str = "documents", host: str = "source", limit: int = LIMIT, least_left: float = LEAST_LEFT) -> str:
    """The same rules in SQL, for DuckDB, over rows with distinct ids."""
    blank = "chr(9) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH docs AS (SELECT doc_id, {host} AS host, coalesce(text, '') AS text FROM {table}),
w AS (SELECT doc_id, text, list_filter(string_split(translate(text, {blank} || chr(10), '     '), ' '), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: translate(x, {blank} || ' ', '') <> '') AS lines FROM docs),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
tris AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM tri),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tris) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM twice) GROUP BY doc_id),
base AS (SELECT doc_id, len(w) AS n_words, length(translate(text, {blank} || chr(10) || ' ', '')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w),
cut AS (SELECT doc_id, host, string_split(translate(text, '{UPPER}' || {blank}, '{LOWER}' || '    '), chr(10)) AS ls FROM docs),
l0 AS (SELECT doc_id, host, unnest(ls) AS l, unnest(range(len(ls))) AS pos FROM cut),
l1 AS (SELECT doc_id, host, pos, list_filter(string_split(l, ' '), lambda x: x <> '') AS x FROM l0),
l2 AS (SELECT doc_id, host, pos, md5(array_to_string(x, ' ')) AS line, len(x) AS n FROM l1 WHERE len(x) > 0),
ids AS (SELECT doc_id, md5(string_agg(line, ',' ORDER BY pos)) AS text_id FROM l2 GROUP BY doc_id),
l3 AS (SELECT l2.*, text_id FROM l2 JOIN ids USING (doc_id)),
common AS (SELECT host, line FROM l3 GROUP BY host, line HAVING count(DISTINCT text_id) > {limit}),
removed AS (SELECT doc_id, sum(n) AS n FROM l3 JOIN common ON l3.line = common.line AND l3.host IS NOT DISTINCT FROM common.host
    GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words)
        AND n_words - coalesce(removed.n, 0) >= {least_left} * n_words AS kept,
    CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_words
FROM base LEFT JOIN rep USING (doc_id) LEFT JOIN removed USING (doc_id)"""
