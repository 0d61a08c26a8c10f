"""Functions that SQL can call once a session has them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import structure as S
from siltstone.functions.features import nested_udf, with_fingerprint
from siltstone.functions.layouts import extract_timestamp
from siltstone.operators.parse import parse_log


@F.pandas_udf(T.StringType())
def detect_value_type(values: pd.Series) -> pd.Series:
    return pd.Series([S.value_type(v) if v is not None else None for v in values], dtype=object)


FUNCTIONS = {"log_features": nested_udf, "parse_log": parse_log, "detect_value_type": detect_value_type, "extract_timestamp": extract_timestamp}


def register(spark: SparkSession) -> None:
    """log_features(text, is_syslog), parse_log(raw, pattern, mapping, transformations), detect_value_type and
    extract_timestamp for SQL. Templates, vendors, fingerprints and records are Column expressions: see features_view."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)


def features_view(spark: SparkSession, table: str, raw_col: str = "raw_log") -> str:
    """A temporary view <table>_features: the table with format, vendor, product, template, canonical, fingerprint and the
    feature record of its logs, all as SQL columns; gives its name."""
    name = f"{table}_features"
    with_fingerprint(spark.table(table), raw_col, record=True).createOrReplaceTempView(name)
    return name
