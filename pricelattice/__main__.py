"""Commands: create tables, export or show a registered query, merge landed records, classify, compare, discover, run due batches."""

from __future__ import annotations

import argparse
import importlib
import importlib.util

from pyspark.sql import functions as F

from pricelattice import schemas
from pricelattice.operators import brands, compare, name_readers, relational
from pricelattice.operators.merge import overwrite_where, upsert
from pricelattice.session import build_session, read_table
from pricelattice.sources import payloads, writers
from pricelattice.streaming.periods import VersionedTable, merge_stream

FEATURES = ["brand", "product_type", "variant", "size_value", "size_unit", "classification_status", "classification_confidence"]
SCRAPED = ["price_unit", "price_bulk", "stock", "last_scraped_at"]


def known_queries() -> dict:
    """All queries that the entry beside the package registers; without an entry those of the catalogue."""
    if importlib.util.find_spec("__spark_entry__") is not None:
        return importlib.import_module("__spark_entry__").queries()
    from pricelattice.plans import catalogue_queries, problem_queries, reference_queries

    return problem_queries.QUERIES | reference_queries.QUERIES | catalogue_queries.QUERIES


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="pricelattice")
    parser.add_argument("--master")
    parser.add_argument("--folder", required=True, help="folder of <table>.parquet")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *positional: str):
        sub = commands.add_parser(name, help=about)
        for p in positional:
            sub.add_argument(p)
        return sub

    command("init", "create the tables that are missing")
    command("list", "names of the registered queries")
    command("export", "write a query's rows as CSV or XLSX", "query", "out")
    command("show", "print a query's first rows", "query").add_argument("--rows", type=int, default=20)
    command("update", "merge landed records into products and classify what is new, into a new folder", "records", "out")
    command("discover", "category links of landed pages", "pages").add_argument("--pattern", default=r"\.html$")
    command("schedule", "merge the records that have landed since the last run, then stop; for an external scheduler", "landed", "table", "marks")
    pipeline = command("pipeline", "read names into features")
    pipeline.add_argument("--supplier")
    pipeline.add_argument("--out", help="folder of the classified products")
    pipeline.add_argument("--sample", type=int, default=20, help="rows of a dry run")
    for flag in ("force", "reclassify", "list-unmapped", "dry-run"):
        pipeline.add_argument(f"--{flag}", action="store_true")
    unify = command("unify", "products of several suppliers beside each other")
    unify.add_argument("--suppliers", help="separated by commas")
    unify.add_argument("--top", type=int, default=20)
    unify.add_argument("--min-spread", type=float, default=0.0)
    unify.add_argument("--csv")
    return parser.parse_args(argv)


def with_features(products, refs, chosen):
    """``products`` with features, status and confidence of the rows that ``chosen`` selects and that have no status."""
    known = name_readers.dictionaries_of(refs)
    todo = products.filter(chosen)
    read = name_readers.classified(todo, known, name_readers.learned_layouts(products, known)).select("supplier", "sku", *FEATURES).dropDuplicates(["supplier", "sku"])
    return overwrite_where(products, read, ["supplier", "sku"], FEATURES, "classification_status is null")


def classify(spark, args) -> None:
    products, refs = read_table(spark, args.folder, "products"), read_table(spark, args.folder, "ref_values")
    if args.list_unmapped:
        known = refs.filter("field = 'product_type'").select(F.col("value").alias("product_type"))
        counts = products.filter("product_type is not null").groupBy("product_type").agg(F.count("*").alias("n")).join(known, "product_type", "left_anti")
        return counts.orderBy(F.desc("n"), "product_type").show(args.sample, truncate=40)
    mine = F.col("supplier") == args.supplier if args.supplier else F.lit(True)
    if args.force or args.reclassify:  # force reads rows that wait for a review again, reclassify also those reviewed
        again = mine if args.reclassify else mine & (F.col("classification_status") == "pending")
        products = products.withColumn("classification_status", F.when(~F.coalesce(again, F.lit(False)), F.col("classification_status")))
    if args.dry_run:
        known = name_readers.dictionaries_of(refs)
        return name_readers.read_names(products.filter(mine), known, name_readers.learned_layouts(products, known)).show(args.sample, truncate=30)
    if not args.out:
        raise SystemExit("--out or --dry-run is needed")
    print(writers.copy_verified(with_features(products, refs, mine), args.out))


def compare_suppliers(spark, args) -> None:
    offers = read_table(spark, args.folder, "products").select(F.coalesce("canonical_key", F.concat_ws("|", *[brands.brand_core(F.col(c)) for c in ("brand", "product_type", "variant")])).alias("k"), "supplier", F.col("price_unit").alias("price"))
    chosen = relational.among(offers, "supplier", args.suppliers.split(",") if args.suppliers else [])
    groups = compare.spread(compare.representative(chosen, "k"), "k").filter(F.coalesce("diff_pct", F.lit(0.0)) >= args.min_spread).orderBy(F.desc_nulls_last("diff_pct"), "k")
    if args.csv:
        writers.export_csv(groups, args.csv)
    groups.show(args.top, truncate=60)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    if args.command == "list":
        print("\n".join(known_queries()))
        return
    spark = build_session(master=args.master)
    if args.command == "init":
        print("\n".join(writers.create_tables(spark, args.folder, schemas.ALL)))
    elif args.command == "show":
        known_queries()[args.query](spark, args.folder).show(args.rows, truncate=40)
    elif args.command == "export":
        frame = known_queries()[args.query](spark, args.folder)
        if args.out.endswith(".xlsx"):
            writers.export_xlsx(frame, args.out, "cheapest" if "cheapest" in frame.columns else None)
        else:
            writers.export_csv(frame, args.out)
    elif args.command == "update":
        merged = upsert(read_table(spark, args.folder, "products"), spark.read.parquet(args.records), ["supplier", "sku"], SCRAPED)
        print(writers.copy_verified(with_features(merged, read_table(spark, args.folder, "ref_values"), F.lit(True)), args.out))
    elif args.command == "discover":
        for row in payloads.category_links(spark.read.parquet(args.pages), args.pattern).toLocalIterator():
            print(row.href)
    elif args.command == "schedule":
        stream = spark.readStream.schema(spark.read.parquet(args.landed).schema).parquet(args.landed)
        merge_stream(stream, VersionedTable(spark, args.table), ["supplier", "sku"], SCRAPED, args.marks).awaitTermination()
    elif args.command == "pipeline":
        classify(spark, args)
    elif args.command == "unify":
        compare_suppliers(spark, args)


if __name__ == "__main__":
    main()
