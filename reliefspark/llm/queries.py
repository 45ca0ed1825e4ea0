"""Queries and SQL of the corpus operators, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .bitpack import op2_bit_packed_ids
from .decontaminate import op4_decontamination
from .hmm import op10_hidden_markov, score_documents
from .minhash import op9_minhash_odd_sketch
from .packing import op5_packed_sequences
from .permutation import op1_permutation_index
from .quality import op6_quality_rules
from .substrings import op8_suffix_dedup
from .toxicity import op7_toxicity_weak
from .urls import op3_url_trees

_ALL = (op1_permutation_index, op2_bit_packed_ids, op3_url_trees, op4_decontamination, op5_packed_sequences, op6_quality_rules, op7_toxicity_weak, op8_suffix_dedup, op9_minhash_odd_sketch, op10_hidden_markov)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3 that SQL can express: page_id, host, path, rule and the verdict that a rule gives."""
    from . import urls

    rule, given = urls.rule_columns(urls.RULES)
    return urls.parsed(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", rule.alias("rule"), given.alias("given"))


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10 that SQL can express: all columns but the model's score."""
    out = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), rounds=1)
    return out.drop("score").withColumn("base_score", F.round("base_score", 4))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*_ALL, url_rules, base_scores)}


def oracle_sql() -> dict[str, str]:
    """op8 and op9 as a whole, op3 and op10 in part.

    The others have none: op1 is approximate, op2 and op5 need a tokenizer, op4 an alignment,
    op6 and op7 a trained model. Their tests in tests/llm are recall, round trips, brute
    force and held-out labels.
    """
    return {"op8_suffix_dedup": oracles.suffix_dedup(), "op9_minhash_odd_sketch": oracles.near_duplicates(), "url_rules": oracles.url_rules(), "base_scores": oracles.base_scores()}
