"""Frames from plain Python rows, whatever numbers stand in decimal columns."""

from decimal import Decimal


def frame(spark, rows, ddl):
    kinds = [c.strip().split(" ", 1)[1] for c in ddl.replace("(12,", "(12;").split(",")]
    fixed = [tuple(Decimal(str(v)) if v is not None and k.startswith("decimal") else v for v, k in zip(r, kinds)) for r in rows]
    return spark.createDataFrame(fixed, ddl)
