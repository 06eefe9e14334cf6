"""Sinks: CSV exports, spreadsheets, fixed-width tables, verified copies, table creation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelattice.functions.fmt import fixed_width
from pricelattice.session import exists

MAX_SHEET_ROWS = 1_000_000  # rows a spreadsheet holds


def export_csv(frame: DataFrame, path: str, *order: str, single: bool | None = None) -> None:
    """CSV with a header; one file for what a sheet holds, many for bulk, unless ``single`` says which."""
    ordered = frame.orderBy(*order) if order else frame
    if single is None:
        single = frame.limit(MAX_SHEET_ROWS + 1).count() <= MAX_SHEET_ROWS
    (ordered.coalesce(1) if single else ordered).write.mode("overwrite").option("header", True).csv(path)


def export_xlsx(frame: DataFrame, path: str, best: str | None = None) -> None:
    """A spreadsheet with a bold header; the column named in each row's ``best`` is marked. Needs openpyxl."""
    try:
        from openpyxl import Workbook
        from openpyxl.styles import Font, PatternFill
    except ImportError as error:
        raise RuntimeError("openpyxl is not installed; use export_csv") from error
    rows = frame.limit(MAX_SHEET_ROWS + 1).collect()
    if len(rows) > MAX_SHEET_ROWS:
        raise ValueError(f"a sheet holds {MAX_SHEET_ROWS} rows")
    book = Workbook()
    sheet = book.active
    sheet.append(frame.columns)
    for cell in sheet[1]:
        cell.font = Font(bold=True)
    for n, row in enumerate(rows, 2):
        sheet.append([row[c] for c in frame.columns])
        if best and row[best] in frame.columns:
            sheet.cell(n, frame.columns.index(row[best]) + 1).fill = PatternFill("solid", fgColor="C6EFCE")
    book.save(path)


def column_widths(frame: DataFrame) -> dict[str, int]:
    """The longest text of each column, its name included."""
    row = frame.agg(*[F.max(F.length(F.col(c).cast("string"))).alias(c) for c in frame.columns]).first()
    return {c: max(len(c), row[c] or 0) for c in frame.columns}


def fixed_width_lines(frame: DataFrame, widths: dict[str, int] | None = None) -> DataFrame:
    """(line): each row as a bordered line of a fixed-width table."""
    return frame.select(fixed_width(widths or column_widths(frame)).alias("line"))


def write_text(lines: DataFrame, path: str) -> None:
    """Lines as text; one file for what a sheet holds, many for bulk."""
    few = lines.limit(MAX_SHEET_ROWS + 1).count() <= MAX_SHEET_ROWS
    (lines.coalesce(1) if few else lines).write.mode("overwrite").text(path)


def copy_verified(source: DataFrame, path: str) -> int:
    """Copies a table and raises unless the copy has as many rows; returns their number."""
    spark = source.sparkSession
    source.write.mode("overwrite").parquet(path)
    rows, copied = source.count(), spark.read.parquet(path).count()
    if rows != copied:
        raise RuntimeError(f"{copied} of {rows} rows copied to {path}")
    return copied


def create_tables(spark: SparkSession, folder: str, schemas: dict[str, T.StructType]) -> list[str]:
    """Writes an empty table for each schema whose folder does not exist yet; returns the created names."""
    made = []
    for name, schema in schemas.items():
        path = f"{folder}/{name}.parquet"
        if not exists(spark, path):
            spark.createDataFrame([], schema).write.parquet(path)
            made.append(name)
    return made


def with_schema(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in its order, missing ones as null: additive evolution of older files."""
    return frame.select(*[(F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def write_brand_report(report: DataFrame, folder: str) -> None:
    """A brand report (section, name, members, suppliers, listings) as one text folder a section, a line a group."""
    line = F.concat(F.col("name"), F.lit(" ("), F.array_join("suppliers", ", "), F.lit(", "), F.col("listings").cast("string"), F.lit(")"), F.when(F.size("members") > 1, F.concat(F.lit(": "), F.array_join("members", ", "))).otherwise(""))
    report.select("section", line.alias("value")).orderBy("section", "value").write.mode("overwrite").partitionBy("section").text(folder)
