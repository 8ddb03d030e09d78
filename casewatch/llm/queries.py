"""The registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casewatch.llm import (
    contextual_pii,
    decontaminate,
    direct_codes,
    exact_dedup,
    filter_audit,
    hidden_markov,
    line_rules,
    main_text,
    pieces,
    prefix_tree,
    recompression,
    signature_join,
    suffix_dedup,
)
from casewatch.llm.common import table
from casewatch.session import tune

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        LLM_QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        return fn
    return register


@query("op1_sentencepiece")
def op1(spark, sf_dir):
    return pieces.digest(table(spark, sf_dir, "documents"))


@query("op2_line_rules")
def op2(spark, sf_dir):
    return line_rules.report(table(spark, sf_dir, "documents"))


@query("op3_recompression")
def op3(spark, sf_dir):
    return recompression.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op4_direct_codes")
def op4(spark, sf_dir):
    return direct_codes.write_and_read(table(spark, sf_dir, "documents"))


@query("op5_contextual_pii")
def op5(spark, sf_dir):
    return contextual_pii.report(table(spark, sf_dir, "documents"))


@query("op6_hidden_markov")
def op6(spark, sf_dir):
    return hidden_markov.score(table(spark, sf_dir, "documents"))


@query("op7_signature_join")
def op7(spark, sf_dir):
    return signature_join.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query("op8_suffix_dedup")
def op8(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op9_decontaminate")
def op9(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_main_text")
def op10(spark, sf_dir):
    return main_text.extract(table(spark, sf_dir, "pages"))


@query("op11_fuse_dedup")
def op11(spark, sf_dir):
    return exact_dedup.report(table(spark, sf_dir, "documents"))


@query("op12_prefix_tree")
def op12(spark, sf_dir):
    return prefix_tree.report(table(spark, sf_dir, "conversations"))


@query("op13_filter_audit")
def op13(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


LLM_ORACLE: dict[str, str] = {
    "op2_line_rules": line_rules.oracle(), "op11_fuse_dedup": exact_dedup.oracle(),
    "op12_prefix_tree": prefix_tree.oracle(), "op13_filter_audit": filter_audit.oracle(),
}
