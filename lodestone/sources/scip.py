"""Nodes and edges from a symbol index: occurrences and symbol information as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.predicates import dir_of, exported, imported_language, index_kind, qualified_of_symbol, symbol_id, symbol_name, visibility
from lodestone.operators.joins import enclosing, prioritized, with_lead_end

DEFINITION = 1
OCCURRENCES = "relative_path string, symbol string, symbol_roles int, range array<int>, language string"
SYMBOLS = "symbol string, display_name string, kind string, documentation array<string>, signature string"


def definitions(occurrences: DataFrame, symbols: DataFrame, keep_locals: bool = False) -> DataFrame:
    """Nodes: one for each definition; ranges have three numbers (one line) or four."""
    own = occurrences.where((F.col("symbol_roles").bitwiseAND(F.lit(DEFINITION)) != 0) & (F.size("range") >= 3))
    own = own if keep_locals else own.where(~F.startswith(F.col("symbol"), F.lit("local ")))
    placed = own.select(
        "symbol", F.col("relative_path").alias("file_path"), (F.element_at("range", 1) + 1).cast("long").alias("start_line"), (F.element_at("range", 2) + 1).cast("long").alias("start_column"),
        (F.element_at("range", -1) + 1).cast("long").alias("end_column"), F.when(F.size("range") > 3, F.element_at("range", 3) + 1).cast("long").alias("own_end"),
    )
    named = placed.join(symbols, "symbol", "left")
    qualified = qualified_of_symbol("symbol")
    language = imported_language("file_path")
    name = F.coalesce(F.when(F.col("display_name") != "", F.col("display_name")), symbol_name("symbol"))
    nodes = named.select(
        symbol_id(F.lit("scip"), "file_path", qualified, F.col("symbol")).alias("id"), index_kind("kind", "symbol").alias("kind"), name.alias("name"), qualified.alias("qualified_name"),
        "file_path", language.alias("language"), "start_line", "start_column", "end_column", "own_end", F.coalesce("signature", F.lit("")).alias("signature"),
        F.array_join(F.coalesce("documentation", F.array().cast("array<string>")), "\n").alias("docstring"), visibility("signature").alias("visibility"), exported(language, name).alias("is_exported"), "symbol",
    )
    return with_lead_end(nodes).withColumn("end_line", F.greatest("end_line", F.coalesce("own_end", F.lit(0)))).drop("own_end")


def calls(occurrences: DataFrame, nodes: DataFrame) -> DataFrame:
    """Call edges: from the first function that holds a reference to the symbol's node, of its own file, any, or external."""
    uses = occurrences.where((F.col("symbol_roles").bitwiseAND(F.lit(DEFINITION)) == 0) & (F.size("range") >= 3))
    points = uses.select(F.monotonically_increasing_id().alias("point_id"), F.col("relative_path").alias("file_path"), "symbol", (F.element_at("range", 1) + 1).cast("long").alias("line"), (F.element_at("range", 2) + 1).cast("long").alias("col"))
    own = nodes.groupBy("file_path", "symbol").agg(F.min("id").alias("id"))
    everywhere = nodes.groupBy("symbol").agg(F.min("id").alias("id"))
    found = prioritized(enclosing(points, nodes, "outermost"), own, everywhere)
    return found.where("node_id != target").select(F.col("node_id").alias("source"), "target", F.lit("calls").alias("kind"), F.lit("scip").alias("provenance"), "line", "col").distinct()


def layers(nodes: DataFrame) -> DataFrame:
    """language and directories of an import, for its report."""
    return nodes.groupBy("language").agg(F.count("*").alias("symbols"), F.count_distinct(dir_of("file_path")).alias("directories"))
