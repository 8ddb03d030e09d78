"""Reading drugs, reactions and severity out of raw model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch.functions.text import strip

OBJECTS = "array<struct<drugs: array<string>, reactions: array<string>, severity: string>>"
STRICT = {"allowSingleQuotes": "false"}


def _without_fence(text: Column) -> Column:
    """Stripped text without a code fence around it."""
    text = strip(text)
    opened = F.when(
        text.startswith("```"), F.regexp_replace(text, r"(?U)^```(?:json)?\s*", "")
    ).otherwise(text)
    return strip(F.when(
        opened.endswith("```"), F.regexp_replace(opened, r"(?U)\s*```$", "")
    ).otherwise(opened))


def _objects(text: Column) -> Column:
    """The text read as the inside of a JSON list: one element if it is exactly one object.

    Broken text gives null, and so does text after the object, which the reader would pass
    over without the brackets.
    """
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), OBJECTS, STRICT)


def _listed(raw: Column, field: str) -> Column:
    """Items of the first ``"field": [...]`` in the text, null where there is none."""
    body = F.get(F.regexp_extract_all(raw, F.lit(rf'"{field}"\s*:\s*\[([^\]]*)\]'), F.lit(1)), F.lit(0))
    items = F.transform(
        F.split(body, ","), lambda v: F.btrim(F.btrim(strip(v), F.lit('"')), F.lit("'"))
    )
    return F.filter(items, lambda v: v != "")


def parse_outputs(df: DataFrame, raw: str = "raw", out: str = "output") -> DataFrame:
    """Add a struct (drugs, reactions, severity, method), null where nothing can be read.

    Tried in turn: the text without a code fence as one JSON object; the stretch from the
    first to the last brace; the single fields by pattern. A field that is not a list
    counts as an empty list. ``severity`` stays null where an object does not give it.

    Each step is a column of its own, so that no text is parsed twice and the later steps
    run only on rows the earlier ones could not read. The result leaves through ``inline``
    of one entry: filters on it then stay above, instead of being pushed down with a copy
    of all the steps.
    """
    text = F.col(raw)
    steps = df.withColumn("_bare", _without_fence(text))
    steps = steps.withColumn("_direct", F.when(F.col("_bare").startswith("{"), _objects(F.col("_bare"))))
    direct = F.size("_direct") == 1
    block = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    steps = steps.withColumn("_block", F.when(F.coalesce(direct, F.lit(False)), None).otherwise(block))
    steps = steps.withColumn("_inner", F.when(F.col("_block") != "", _objects(F.col("_block"))))
    steps = steps.withColumn(
        "_object",
        F.when(direct, F.get("_direct", F.lit(0))).when(F.size("_inner") == 1, F.get("_inner", F.lit(0))),
    )
    unread = F.col("_object").isNull()
    severity = F.regexp_extract(text, r'"severity"\s*:\s*"(serious|non-serious|unknown)"', 1)
    steps = steps.withColumn(
        "_fields",
        F.when(unread, F.struct(
            _listed(text, "drugs").alias("drugs"), _listed(text, "reactions").alias("reactions"),
            F.coalesce(F.nullif(severity, F.lit("")), F.lit("unknown")).alias("severity"),
        )),
    )

    def result(source: str, method: str) -> Column:
        none = F.array().cast("array<string>")
        lists = [F.coalesce(f"{source}.{c}", none).alias(c) for c in ("drugs", "reactions")]
        return F.struct(*lists, F.col(f"{source}.severity"), F.lit(method).alias("method"))

    listed = F.col("_fields.drugs").isNotNull() | F.col("_fields.reactions").isNotNull()
    found = F.when(~unread, result("_object", "json")).when(listed, result("_fields", "regex_fallback"))
    return steps.select(*df.columns, F.inline(F.array(F.struct(found.alias(out)))))
