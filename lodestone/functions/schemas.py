"""Fixed schemas of the code graph, closed vocabularies and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def _schema(columns: str) -> StructType:
    kinds = {"string": StringType(), "long": LongType()}
    return StructType([StructField(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


NODES = _schema(
    "id string, kind string, name string, qualified_name string, file_path string, language string, start_line long, end_line long, "
    "start_column long, end_column long, signature string, docstring string, visibility string, return_type string, is_exported long, updated_at long"
)
EDGES = _schema("id long, source string, target string, kind string, provenance string, line long, col long, metadata string")
FILES = _schema("path string, content_hash string, language string, size long, modified_at long, indexed_at long, node_count long, errors string")
VERDICTS = _schema("id long, symbol_id string, has_active_defect long, stage string, decision string, rule_id string, description string, suggestion string, operator string, updated_at long")

#: Fixed values.
NODE_KINDS = ("function", "method", "class", "struct", "interface", "macro", "variable", "local", "external", "route")
EDGE_KINDS = ("contains", "calls", "imports", "implements", "route")
#: In order of priority.
PROVENANCES = ("scip", "tree-sitter", "heuristic")
LANGUAGES = ("go", "python", "typescript", "c", "cpp", "java", "http", "cxx")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of a schema, in order and type; missing ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(*((df[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows that break a rule: rule, key. Required columns, vocabularies, keys."""
    bad_node = F.col("id").isNull() | F.col("name").isNull() | F.col("file_path").isNull() | F.col("start_line").isNull()
    found = nodes.where(bad_node).select(F.lit("node: required column is null").alias("rule"), F.col("id").alias("key"))
    found = found.unionByName(nodes.where(~F.col("kind").isin(*NODE_KINDS)).select(F.lit("node: unknown kind").alias("rule"), F.col("id").alias("key")))
    found = found.unionByName(nodes.groupBy("id").count().where("count > 1").select(F.lit("node: repeated id").alias("rule"), F.col("id").alias("key")))
    found = found.unionByName(edges.where(~F.col("kind").isin(*EDGE_KINDS)).select(F.lit("edge: unknown kind").alias("rule"), F.col("id").cast("string").alias("key")))
    return found.unionByName(edges.where(~F.col("provenance").isin(*PROVENANCES)).select(F.lit("edge: unknown provenance").alias("rule"), F.col("id").cast("string").alias("key")))
