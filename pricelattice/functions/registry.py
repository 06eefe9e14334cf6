"""SQL names of the engine's scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelattice.functions.text import ACCENTED, PLAIN
from pricelattice.operators.brands import token_sort_ratio


def register_functions(spark: SparkSession) -> list[str]:
    """Registers ascii_fold, normalize_brand, canonical_key, parse_ar_price and token_sort_ratio for ``spark.sql``; returns their names."""
    bare = f"regexp_replace(translate(x, '{ACCENTED}', '{PLAIN}'), '\\\\p{{Mn}}+', '')"
    core = f"nullif(trim(regexp_replace(regexp_replace(upper({bare}), '[^A-Z0-9 ]', ' '), ' +', ' ')), '')"
    bodies = {
        "ascii_fold(x STRING)": f"regexp_replace({bare}, '[^\\\\x00-\\\\x7F]', '')",
        "normalize_brand(x STRING)": core,
        "canonical_key(brand STRING, kind STRING, variant STRING, measure STRING)": "concat_ws('|', coalesce(normalize_brand(brand), '?'), coalesce(normalize_brand(kind), '?'), "
        "array_join(array_sort(split(coalesce(normalize_brand(variant), ''), ' ')), ' '), coalesce(measure, '?'))",
        "parse_ar_price(x STRING)": "try_cast(replace(translate(trim(x), '$.  ', ''), ',', '.') AS DOUBLE)",
    }
    for head, body in bodies.items():
        kind = "DOUBLE" if head.startswith("parse") else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else token_sort_ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    spark.udf.register("token_sort_ratio", ratio)
    return [*(h.partition("(")[0] for h in bodies), "token_sort_ratio"]
