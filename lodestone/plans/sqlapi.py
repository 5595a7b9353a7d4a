"""Ad-hoc SQL over the code graph's tables, read-only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_READS = re.compile(r"^\s*(?:--[^\n]*\n|/\*.*?\*/|\s|\()*(select|with|values|table|from|explain|describe|show)\b", re.IGNORECASE | re.DOTALL)


def register_views(spark: SparkSession, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def query(spark: SparkSession, text: str) -> DataFrame:
    """The result of a reading statement; others are refused. The parser tells which they are, not the words in them."""
    bare = text.strip().rstrip(";")
    if not _READS.match(bare) or _writes(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(bare)):
        raise ValueError("only a single reading statement is taken")
    return spark.sql(bare)


def _writes(spark: SparkSession, plan) -> bool:
    """Whether a parsed statement or a part of it is a command, other than to describe, explain or show."""
    name = plan.getClass().getSimpleName()
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    if name.startswith(("Explain", "Describe", "Show")):
        return False
    if name.startswith("Insert") or command.isInstance(plan):
        return True
    children = plan.children()
    return any(_writes(spark, children.apply(i)) for i in range(children.size()))


def as_text(df: DataFrame, limit: int = 1000) -> str:
    """Rows as `a | b` lines with NULL for nulls, and their number."""
    rows = df.limit(limit).collect()
    head = " | ".join(df.columns)
    body = [" | ".join("NULL" if v is None else str(v) for v in r) for r in rows]
    return "\n".join([head, *body, f"({len(rows)} rows)"])


def from_json(df: DataFrame, schema: StructType, column: str = "json") -> DataFrame:
    """Columns of a schema from a column of JSON objects; what doesn't fit is null."""
    return df.select(F.from_json(column, schema).alias("row")).select("row.*")


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))
