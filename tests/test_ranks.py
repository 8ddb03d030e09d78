from conftest import rows
from pyspark.sql import functions as F

from casewatch.operators.dedupe import number_within
from casewatch.operators.ranks import placed, ranked, running_sums, runs

GROUPS = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 101 = 0 THEN NULL ELSE concat('g', id % 50) END"


def test_rank_equals_row_number(spark):
    df = spark.range(4000).select(F.expr(GROUPS).alias("g"), ((F.col("id") * 7919) % 4001).alias("v"), F.col("id").alias("x"))
    got = rows(ranked(df, "g", [F.col("v").desc()], "x", "v"))
    want = {}
    for r in df.collect():
        want.setdefault(r.g, []).append((-r.v, r.x))
    assert got == sorted(((g, x, -v, i) for g, vs in want.items() for i, (v, x) in enumerate(sorted(vs), 1)), key=lambda r: tuple(map(str, r)))
    assert ranked(df.limit(0), "g", [F.col("v")]).count() == 0


def test_a_hot_group_spreads_over_partitions(spark):
    df = spark.range(40_000).select(F.when(F.col("id") > 100, 1).otherwise(F.col("id")).alias("g"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows become one partition
    try:
        held = runs(placed(df, "g", [F.col("v")], "v"), "g").where("g = 1").collect()
        got = sorted((r.v, r.rank) for r in ranked(df, "g", [F.col("v")], "v").where("g = 1").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(held) > 1 and max(r._before for r in held) > 0
    assert got == [(v, i) for i, v in enumerate([1, *range(101, 40_000)], 1)]


def test_running_sums_over_levels_of_blocks(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("a"), F.lit(1).cast("long").alias("b"))
    got = {r.id: (r.a, r.b) for r in running_sums(df, "id", 1000, ["a", "b"], block=5).collect()}
    assert got == {i: (sum(j % 7 for j in range(i + 1)), i + 1) for i in range(1000)}


def test_small_and_large_keys_are_numbered_alike(spark):
    df = spark.range(4000).select(F.expr(GROUPS).alias("g"), (F.col("id") * 7919 % 4001).cast("string").alias("t"), F.lit("x").alias("kept"))
    df = df.unionByName(spark.createDataFrame([("g1", None, "x"), (None, None, "x")], df.schema))
    want = []
    terms = {}
    for r in df.collect():
        terms.setdefault(r.g, []).append(r.t)
    for g, ts in terms.items():
        want += [(g, t, "x", i) for i, t in enumerate(sorted(ts, key=lambda t: (t is not None, t)), 1)]
    want.sort(key=lambda r: tuple(map(str, r)))
    for most in (10_000, 100, 30, 0):  # all whole, one key spread, some, all
        got = number_within(df, "g", "t", "n", most)
        assert got.schema["n"].dataType.simpleString() == "int"
        assert rows(got) == want
    plan = number_within(df, "g", "t", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 0  # small keys meet in one shuffle
    assert number_within(df.limit(0), "g", "t", "n").count() == 0
