"""The registered queries of this folder: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from updatelens.llm import (
    decontamination, lines, manifest, mixing, negatives, pages, passages, quality, rules, sharding, simhash, substrings, tokens,
)
from updatelens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality(spark, sf):
    return quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op2_decontamination(spark, sf):
    return decontamination.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op3_line_rules(spark, sf):
    return rules.clean_lines(table(spark, sf, "documents"), with_text=False)


@query
def op4_mixing(spark, sf):
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op5_sharding(spark, sf):
    return sharding.shard(table(spark, sf, "documents"))


@query
def op6_substrings(spark, sf):
    found = substrings.remove_repeated_bytes(table(spark, sf, "documents"))
    return substrings.digest_rows(found, "n_bytes")


@query
def op7_simhash(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.as_hex(found["fp"]).alias("fingerprint"), "component_id")


@query
def op8_main_text(spark, sf):
    return pages.main_text(table(spark, sf, "pages"))


@query
def op9_token_counts(spark, sf):
    return tokens.count_tokens(table(spark, sf, "documents"), public_tokenizers.path(tokens.VOCABULARY))


@query
def op10_passages(spark, sf):
    found = passages.remove_earlier_passages(table(spark, sf, "documents"))
    return substrings.digest_rows(found, "n_words").drop("n_spans")


@query
def op11_lines(spark, sf):
    found = lines.remove_common_lines(table(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op12_manifest(spark, sf):
    leaves = manifest.document_leaves(table(spark, sf, "documents"))
    return manifest.prove(leaves)


@query
def op13_negatives(spark, sf):
    return negatives.mine(negatives.contract_rows(table(spark, sf, "embeddings")))
