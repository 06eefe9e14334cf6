"""The registered queries of this package. None has SQL: each is tested against brute force or a round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricelattice.llm.leakage import leaked_items
from pricelattice.llm.product_match import matched_listings, matched_pairs
from pricelattice.llm.ref_mapping import entries_in_reach, map_values
from pricelattice.llm.stuffing import stuffed_pages
from pricelattice.llm.tokens import encode_corpus
from pricelattice.session import read_table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = ["supplier", "sku", "product_id", "updated_at", "name", "brand", "product_type", "variant", "size", "size_value", "size_unit"]
    return matched_pairs(read_table(spark, folder, "products", *texts), read_table(spark, folder, "ref_values"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each listing with the group of its article: what the pairs of p2_found say, without expanding them."""
    texts = ["supplier", "sku", "product_id", "updated_at", "name", "brand", "product_type", "variant", "size", "size_value", "size_unit"]
    return matched_listings(read_table(spark, folder, "products", *texts), read_table(spark, folder, "ref_values"))


def p5_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry within reach of each distinct value."""
    products = read_table(spark, folder, "products", "brand", "product_type", "category")
    return entries_in_reach(products, read_table(spark, folder, "ref_values"), read_table(spark, folder, "category_codes"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    products = read_table(spark, folder, "products", "supplier", "sku", "updated_at", "brand", "product_type", "category")
    return map_values(products, read_table(spark, folder, "ref_values"), read_table(spark, folder, "category_codes"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(read_table(spark, folder, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(read_table(spark, folder, "documents", "doc_id", "text"), read_table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed_pages(read_table(spark, folder, "documents"))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups, "p5_found": p5_found, "p5_reach": p5_reach, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found}
SQL: dict[str, str] = {}
