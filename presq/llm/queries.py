"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presq.functions.text import norm
from presq.llm.bpe import encode_corpus
from presq.llm.components import components, group_sizes
from presq.llm.leakage import leaked_items, leaks, without_leaks
from presq.llm.lineages import clusters, described
from presq.llm.neighbours import nearest
from presq.llm.overlap import linked, similar_pairs
from presq.llm.sets import token_sets
from presq.llm.spans import shared_share, shared_spans
from presq.llm.termcount import marked_terms
from presq.plans.tables import cells, table

MATCH_DISTANCE = 12


def _vocabulary() -> Path:
    """The public byte-level vocabulary; PRESQ_TOKENIZERS names another folder."""
    folder = os.environ.get("PRESQ_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = Path(spec.origin).parent if spec else "/opt/tokenizers"
    return Path(folder) / "byte_bpe_50k.tiktoken"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return token_sets(cells(table(spark, d, "presence")).select(F.col("guid").alias("rec"), F.col("allele").alias("term")))


def _records(spark: SparkSession, d: str) -> DataFrame:
    strains = table(spark, d, "strains").select(F.col("strain_id").alias("rec"), F.explode("alleles").alias("a")).select("rec", norm("a").alias("term"))
    return _samples(spark, d).union(token_sets(strains, kind=1))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(_records(spark, d), "7/10")


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    return linked(_records(spark, d), "7/10").select("id", "class_id", "n_links")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "match_results").where((F.col("distance") <= MATCH_DISTANCE) & F.col("guid_a").isNotNull() & F.col("guid_b").isNotNull())
    links = m.select(norm("guid_a").alias("a"), norm("guid_b").alias("b"))
    return components(links, table(spark, d, "guids").select(norm("guid").alias("id")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).select(F.col("id").alias("guid"), "group_id")


def p2_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return group_sizes(_groups(spark, d))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "profiles").select(norm("guid").alias("id"), F.col("profile").alias("vec"))
    return nearest(vectors, width=64, k=5, min_similarity=0.9).select(F.col("id").alias("guid"), F.col("other").alias("neighbour"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = p3_neighbours(spark, d)
    return near.select(F.least("guid", "neighbour").alias("guid_a"), F.greatest("guid", "neighbour").alias("guid_b")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters(_samples(spark, d), "15/100", affinity=False)[0].select(F.col("id").alias("guid"), "cluster_id")


def p4_described(spark: SparkSession, d: str) -> DataFrame:
    return described(clusters(_samples(spark, d), "15/100")[0])


def _terms(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(table(spark, d, "presence")).select(F.col("allele").alias("term"), F.col("guid").alias("rec"))
    return marked_terms(rows, table(spark, d, "alleles").select(norm("allele").alias("term")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where(F.col("mark").isNotNull()).select(F.col("term").alias("allele"), "mark")


def p5_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select(F.col("term").alias("allele"), "n_rows", F.col("n_records").alias("n_samples"), "mark")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), _vocabulary())


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(_leaks(spark, d))


def p7_clean_corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return without_leaks(docs, leaks(docs, table(spark, d, "eval_items"))).select("doc_id", "lang", "source")


def _cleaned(spark: SparkSession, d: str, mode: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return without_leaks(docs, leaks(docs, table(spark, d, "eval_items")), mode).select("doc_id", "text", "lang", "source")


def p7_clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d, "document")


def p7_cut_texts(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d, "span")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "documents"))


def p8_shared_share(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return shared_share(docs, shared_spans(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_links": p1_links,
    "p2_found": p2_found,
    "p2_group_sizes": p2_group_sizes,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p4_found": p4_found,
    "p4_described": p4_described,
    "p5_found": p5_found,
    "p5_term_counts": p5_term_counts,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_leaked_items": p7_leaked_items,
    "p7_clean_corpus": p7_clean_corpus,
    "p7_clean_texts": p7_clean_texts,
    "p7_cut_texts": p7_cut_texts,
    "p8_found": p8_found,
    "p8_shared_share": p8_shared_share,
}
