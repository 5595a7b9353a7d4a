"""Relational look-ups over the code graph. Every limit has a total order in front of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.predicates import holds, like, module_of, non_synthetic

VISIBLE_KINDS = ("function", "method", "class", "struct", "interface", "route", "external")
LINK_KINDS = ("contains", "calls", "imports", "implements")


def search(nodes: DataFrame, text: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    found = nodes.where((holds("name", text) | holds("qualified_name", text)) & non_synthetic())
    found = found.where(F.col("kind") == kind) if kind else found
    return found.orderBy("file_path", "start_line", "id").limit(limit if limit > 0 else 20)


def resolve(nodes: DataFrame, symbol: str, limit: int = 20) -> DataFrame:
    """Ids of a symbol: the node of that id, or else nodes of that name or with it in their qualified name."""
    tier = F.when(F.col("id") == symbol, 0).when(((F.col("name") == symbol) | holds("qualified_name", symbol)) & non_synthetic(), 1)
    tiered = nodes.select("id", tier.alias("tier")).where("tier is not null")
    best = tiered.agg(F.min("tier").alias("tier"))
    return tiered.join(F.broadcast(best), "tier").select("id").orderBy("id").limit(limit if limit > 0 else 20)


def by_symbol(nodes: DataFrame, symbol: str) -> DataFrame:
    return nodes.where(((F.col("id") == symbol) | (F.col("name") == symbol) | holds("qualified_name", symbol)) & non_synthetic())


def by_file(nodes: DataFrame, path: str, limit: int = 10) -> DataFrame:
    return nodes.where((F.col("file_path") == path) & non_synthetic()).orderBy("start_line", "id").limit(limit if limit > 0 else 10)


def locate(nodes: DataFrame, symbol: str) -> DataFrame:
    return nodes.where(holds("qualified_name", symbol) | (F.col("name") == symbol)).select("file_path", "start_line", "kind")


def callers(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Call edges into any of ids (id), once for each of them."""
    return edges.where("kind = 'calls'").join(ids.select(F.col("id").alias("target")), "target").select(*edges.columns)


def callees(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.where("kind = 'calls'").join(ids.select(F.col("id").alias("source")), "source").select(*edges.columns)


def file_list(files: DataFrame, prefix: str = "", glob: str = "", limit: int = 100) -> DataFrame:
    found = files
    if prefix:
        found = found.where(like("path", prefix.strip().lstrip("./") + "%"))
    if glob:
        found = found.where(like("path", "%" + glob.replace("*", "%")))
    return found.orderBy("path").limit(limit if limit > 0 else 100)


def functions(nodes: DataFrame) -> DataFrame:
    found = nodes.where(F.col("kind").isin("function", "method") & non_synthetic())
    return found.select("id", "name", "kind", F.col("file_path").alias("file"), F.col("start_line").alias("line"), module_of("file_path").alias("module")).orderBy("file", "line", "name", "id")


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def module_nodes(nodes: DataFrame, module: str) -> DataFrame:
    inside = ~F.col("file_path").contains("/") if module == "(root)" else like("file_path", f"{module}/%")
    return nodes.where(inside & F.col("kind").isin(*VISIBLE_KINDS) & non_synthetic())


def module_graph(nodes: DataFrame, edges: DataFrame, module: str) -> tuple[DataFrame, DataFrame]:
    """A module's nodes, and the edges inside it."""
    own = module_nodes(nodes, module)
    return own, between(edges.where(F.col("kind").isin(*LINK_KINDS)), own)


def degrees(edges: DataFrame) -> DataFrame:
    """id and degree: call edges at either end, a call of itself twice."""
    calls = edges.where("kind = 'calls'")
    return calls.select(F.col("source").alias("id")).unionByName(calls.select(F.col("target").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))


def aliases(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and canonical: of functions and methods with one kind, file and name, the one with most calls, then by line and id."""
    own = nodes.where("kind in ('function', 'method')").join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    group = Window.partitionBy("kind", "file_path", "name").orderBy(F.desc("degree"), "start_line", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return own.select("id", F.first("id").over(group).alias("canonical"))


def canonicalize(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without duplicates, and edges between what stands for them: loops that only arise so go, then repeats."""
    named = aliases(nodes, edges)
    kept = nodes.join(named.where("id != canonical").select("id"), "id", "left_anti").select(*nodes.columns)
    ends = edges
    for end in ("source", "target"):
        ends = ends.join(named.select(F.col("id").alias(end), F.col("canonical").alias(f"new_{end}")), end, "left")
    moved = ends.withColumn("s", F.coalesce("new_source", "source")).withColumn("t", F.coalesce("new_target", "target"))
    moved = moved.where((F.col("s") != F.col("t")) | (F.col("source") == F.col("target")))
    moved = moved.select(*(F.col({"source": "s", "target": "t"}.get(c, c)).alias(c) for c in edges.columns))
    once = Window.partitionBy("source", "target", "kind").orderBy("id")
    return kept, moved.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")


def graph_data(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All visible nodes, canonical, and the edges among them."""
    own = nodes.where(F.col("kind").isin(*VISIBLE_KINDS) & non_synthetic())
    kept, moved = canonicalize(own, edges.where(F.col("kind").isin(*LINK_KINDS)))
    return kept, between(moved, kept)


def neighbours(nodes: DataFrame, edges: DataFrame, id: str) -> DataFrame:
    """direction, and the node at the other end of each call edge of a node; edges without one are left out."""
    calls = edges.where("kind = 'calls'")
    ends = calls.where(F.col("target") == id).select(F.lit("caller").alias("direction"), F.col("source").alias("id"), "line").unionByName(calls.where(F.col("source") == id).select(F.lit("callee").alias("direction"), F.col("target").alias("id"), "line"))
    return ends.join(nodes.select("id", "name", "file_path"), "id")


def function_tree(nodes: DataFrame, text: str, limit: int = 500) -> DataFrame:
    """directory, file and functions of the first functions that a text filter leaves."""
    found = functions(nodes)
    if text:
        low = text.lower()
        parts = (F.lower(F.col(c)) for c in ("name", "file"))
        found = found.where(reduce(lambda a, b: a | b, (p.contains(low) for p in parts)))
    return found.orderBy("file", "line", "id").limit(limit).groupBy("module", "file").agg(F.count("*").alias("functions"))


def drill_down(nodes: DataFrame, directory: str | None = None, file: str | None = None, text: str = "") -> DataFrame:
    """option: directories, files of a directory, or functions of a file, with a text in them."""
    from lodestone.functions.predicates import dir_of

    own = nodes.where(F.col("kind") == "function")
    if file is not None:
        found = own.where(F.col("file_path") == file).select(F.col("name").alias("option"))
    elif directory is not None:
        found = own.where(dir_of("file_path") == directory).select(F.col("file_path").alias("option"))
    else:
        found = own.select(dir_of("file_path").alias("option"))
    return found.where(F.lower("option").contains(text.lower())).distinct().orderBy("option")
