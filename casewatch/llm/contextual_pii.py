"""Personal data by fixed formats and by bootstrapped contexts.

Emails, addresses, card and phone numbers are found by their formats. These entities are the seeds,
each whole, with its blanks: the two words before a seed form a lexical pattern. Patterns and the identifier-like words that they
precede make a graph of distinct pairs. Rounds score it: a pattern is trusted by the share of its
instances that are known, and an instance becomes known once the trust of its patterns, combined as
independent evidence, is high enough. Identifier-like words in trusted contexts that no format
covers are added as spans of kind ``id``.

Only DataFrame expressions; what is shuffled are candidate words with a digit or an @, never texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch.llm.common import free_prefix, row_key, stored

KINDS = ["email", "ip", "card", "phone"]
# A run that no @ follows holds no email at any start within it, so starts inside a run are skipped;
# \G admits the place where the match before ended. Groups repeat possessively: Java tries a greedy group by recursion,
# and a stack that overflows on a long match ends the executor, not the task.
FORMATS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MAY_HOLD = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
ROUNDS = 3
SUPPORT = 3  # distinct known instances that a pattern must have
TRUST = 0.5
SHORTEST = 5
BLOCK = 256  # matches whose places are summed in one list


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    at = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int")))
    return F.aggregate(at, F.lit(0), lambda s, d: s + d) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = _digits(m)
    if kind == "ip":
        part = lambda x: F.concat(F.lit("0"), F.substring(F.ltrim(x, F.lit("0")), 1, 4)).cast("int") <= 255
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def matches(text: str, pattern: str) -> tuple[Column, Column]:
    """All leftmost matches of a pattern, and the pieces of text before, between and after them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not again for each element of a list in ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def placed(found: str, between: str) -> Column:
    """Structs (m, start) of matches: a start is the length of all pieces and matches before it.

    Lengths are summed within blocks of matches, then over blocks: a list that grows is copied at each step.
    """
    places, none = F.array().cast("array<int>"), F.array().cast("array<struct<m:string,start:int>>")

    def block(pairs: Column, first: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            start = s["at"] + F.length(F.get(pairs, i)["p"])
            m = F.get(pairs, i)["m"]
            return F.struct((start + F.length(m)).alias("at"), F.concat(s["out"], F.array(F.struct(m.alias("m"), start.alias("start")))).alias("out"))
        last = F.least(first + BLOCK, F.size(pairs)) - 1
        return F.aggregate(F.sequence(first, last), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def together(blocks: Column) -> Column:
        step = lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        offsets = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), places.alias("out")), step)["out"]
        return F.flatten(F.zip_with(blocks, offsets, lambda b, o: F.transform(
            b["out"], lambda x: F.struct(x["m"].alias("m"), (x["start"] + o).alias("start")))))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    every = let(pairs, lambda x: let(F.transform(
        F.sequence(F.lit(0), F.size(x) - 1, F.lit(BLOCK)), lambda first: block(x, first)), together))
    return F.when(F.size(found) > 0, every).otherwise(none)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with text) and ``base``: array of (kind, start, end, m) of valid matches, by kind and start."""
    none = F.array().cast("array<string>")
    for kind in KINDS:
        found, between = matches("text", FORMATS[kind])
        has = F.col("text").rlike(MAY_HOLD[kind])
        docs = docs.withColumns({f"m_{kind}": F.when(has, found).otherwise(none)})
        docs = docs.withColumns({f"p_{kind}": F.when(F.size(f"m_{kind}") > 0, between).otherwise(none)})
    def spans(kind: str) -> Column:
        valid = F.filter(placed(f"m_{kind}", f"p_{kind}"), lambda x: _valid(kind, x["m"]))
        return F.transform(valid, lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), x["m"].alias("m")))
    return docs.withColumn("base", F.concat(*map(spans, KINDS))).drop(*[f"{c}_{k}" for k in KINDS for c in "mp"])


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``words``: identifier-like words as (m, start, before), ``before`` the two words before."""
    found, between = matches("text", CANDIDATE)
    none = F.array().cast("array<string>")
    docs = docs.withColumn("m_word", F.when(F.col("text").rlike("[0-9@]"), found).otherwise(none))
    docs = docs.withColumn("p_word", F.when(F.size("m_word") > 0, between).otherwise(none))
    tail = lambda p: F.regexp_extract(p, r"([^\x20\x09-\x0D]*+[\x20\x09-\x0D]*+){0,2}\z", 0)
    context = lambda p: F.array_join(F.slice(F.concat(
        F.array(F.lit("#"), F.lit("#")),
        F.array_remove(F.split(F.lower(p), r"[\x20\x09-\x0D]+"), "")), -2, 2), " ")
    return docs.withColumn("words", F.zip_with(
        placed("m_word", "p_word"), F.slice("p_word", 1, F.size("m_word")),
        lambda x, p: F.struct(x["m"].alias("m"), x["start"].alias("start"), context(tail(p)).alias("before")),
    )).drop("m_word", "p_word")


def smaller(places: Column, starts: Column) -> Column:
    """For each of the ascending ``places``, how many of ``starts`` lie before it."""
    mark = lambda side: lambda x: F.struct(x.alias("at"), F.lit(side).alias("side"))
    marks = F.sort_array(F.concat(F.transform(places, mark(0)), F.transform(starts, mark(1))))
    own = F.filter(F.transform(marks, lambda x, i: F.struct(x["side"].alias("side"), i.alias("i"))), lambda x: x["side"] == 0)
    return F.transform(own, lambda x, j: x["i"] - j)


def within_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with base and words) with more of each word: ``whole``, the first span that begins in it, as (start, m),
    and ``reach``, the last end of the spans that begin before it.

    Spans of a kind are ascending and do not overlap, so each word needs two of them; the spans of a text are never
    copied or searched for each of its words.
    """
    def word(w: Column, whole: Column, reach: Column) -> Column:
        return F.struct(*[w[c].alias(c) for c in ("m", "start", "before")], whole.alias("whole"), reach.alias("reach"))

    def near(spans: Column) -> Column:
        """For each word, the first span that does not begin before it and the end of the one ahead of that."""
        starts = lambda xs: F.transform(xs, lambda x: x["start"])
        return F.transform(smaller(starts(F.col("words")), starts(spans)), lambda n: F.struct(
            F.get(spans, n)["start"].alias("start"), F.get(spans, n)["m"].alias("m"), F.get(spans, n - 1)["end"].alias("reach")))

    def add(w: Column, b: Column) -> Column:
        whole = F.when(b["start"] < w["start"] + F.length(w["m"]), F.struct(b["start"].alias("start"), b["m"].alias("m")))
        return word(w, F.least(w["whole"], whole), F.greatest(w["reach"], b["reach"]))

    none = F.lit(None).cast("struct<start:int,m:string>")
    out = F.transform("words", lambda w: word(w, none, F.lit(0)))
    for kind in KINDS:
        of_kind = F.filter("base", lambda b: b["kind"] == kind)  # noqa: B023 (called at once)
        out = F.zip_with(out, let(of_kind, near), add)
    return docs.withColumn("words", out)


def learn(words: DataFrame, rounds: int, support: int, trust: float) -> DataFrame:
    """Trusted (before, instance) pairs. ``words``: before, instance, seed (whether a format covers it)."""
    edges = stored(words.groupBy("before", "instance").agg(F.max("seed").alias("seed")), "edges")
    known = stored(edges.where("seed").select("instance").distinct(), "known")
    for _ in range(rounds):
        marked = edges.join(known.withColumn("known", F.lit(1)), "instance", "left")
        patterns = marked.groupBy("before").agg(F.count("*").alias("n"), F.count("known").alias("hits")).where(
            F.col("hits") >= support).select("before", (F.col("hits") / F.col("n")).alias("trust"))
        patterns = stored(patterns.where(F.col("trust") >= trust), "patterns")
        score = edges.join(patterns, "before").groupBy("instance").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("score"))
        known = stored(known.union(score.where(F.col("score") >= trust).select("instance")).distinct(), "known")
    return edges.join(patterns, "before").join(known, "instance").where("NOT seed").select("before", "instance")


def spans_of(
    docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST
) -> DataFrame:
    """doc_id, k1, k2 (key of the row), base and found: arrays of (kind, start, end).

    A null text is empty. Rows that repeat id and text share their spans and count alike; other columns
    are ignored, an empty table gives no rows. Contexts ignore case; a word at the start of a text has
    ``#`` for the words it lacks.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"k1": row_key("doc_id", "text"), "k2": F.hash("text", "doc_id")})
    read = stored(within_spans(candidates(base_spans(docs))).select("doc_id", "k1", "k2", "base", "words"), "spans")
    words = read.where(F.size("words") > 0).select("k1", "k2", F.explode("words").alias("w")).select(
        "k1", "k2", "w.before", F.col("w.whole.m").alias("whole"), "w.reach",
        F.regexp_replace("w.m", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("instance"),
        (F.col("w.start") + F.length(F.regexp_extract("w.m", r"^[^\p{L}\p{N}]*", 0))).alias("start"),
    ).withColumn("end", F.col("start") + F.length("instance"))
    # a span over a word in which none begins has begun before it
    words = words.withColumn("covered", F.col("reach") > F.col("start")).drop("reach")
    # SHORTEST is for words that no format covers; before no word at all, also for the first word of a seed
    long = F.length("instance") >= SHORTEST
    words = words.where(F.when(F.col("whole").isNull(), ~F.col("covered") & long).otherwise((F.col("before") != "# #") | long))
    words = words.withColumn("seed", F.col("whole").isNotNull()).withColumn("instance", F.coalesce("whole", "instance"))
    learned = learn(words, rounds, support, trust)
    found = words.where("NOT seed").join(learned, ["before", "instance"]).groupBy("k1", "k2").agg(
        F.sort_array(F.collect_set(F.struct(F.lit("id").alias("kind"), "start", "end"))).alias("found"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    plain = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    return read.drop("words").join(found, ["k1", "k2"], "left").withColumns({"base": plain, "found": F.coalesce("found", none)})


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **args) -> DataFrame:
    """doc_id, counts by format, base_sha256, spans (kind:start:end, comma-joined), n_id."""
    found = spans_of(docs, **args)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "found")).alias("spans"), F.size("found").cast("long").alias("n_id"),
    )


def redacted(docs: DataFrame, **args) -> DataFrame:
    """The documents with every span replaced by ``[KIND]``; their own columns, ``n_chars`` brought up to date.

    Overlapping spans become one, named after the first. A null text stays null; repeated rows stay as many; columns
    keep whatever names they have; an empty table gives none.
    """
    own = free_prefix(docs)
    k1, k2, every, new = (f"{own}{c}" for c in ("k1", "k2", "all", "new"))
    spans = spans_of(docs, **args).where((F.size("base") > 0) | (F.size("found") > 0)).select(
        "k1", "k2", F.concat("base", "found").alias("all")).groupBy("k1", "k2").agg(F.first("all").alias("all"))
    order = F.array_sort(F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({k1: row_key_of(docs), k2: F.hash(text, "doc_id")})
    spans = spans.select(F.col("k1").alias(k1), F.col("k2").alias(k2), order.alias(every))
    step = lambda s, x: F.struct(
        F.when(x["start"] < s["at"], s["out"]).otherwise(
            F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        ).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))
    cut = F.aggregate(every, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step,
                      lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    out = keyed.join(spans, [k1, k2], "left").withColumn(new, F.when(F.col(every).isNotNull(), cut).otherwise(F.col("text")))
    size = {"n_chars": F.when(F.col(every).isNotNull(), F.length(new).cast("long")).otherwise(F.col("n_chars"))}
    out = out.withColumns(size) if "n_chars" in docs.columns else out
    return out.withColumn("text", F.col(new)).select(*[F.col(f"`{c}`") for c in docs.columns])


def row_key_of(docs: DataFrame) -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), text.isNull(), text)
