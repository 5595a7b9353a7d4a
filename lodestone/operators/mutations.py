"""Upserts, deletes and repairs as DataFrame rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.globs import PathFilter
from lodestone.functions.schemas import PROVENANCES

#: Columns that an import updates on a node that is there.
UPDATED = ("kind", "name", "qualified_name", "start_line", "end_line", "signature", "docstring", "updated_at")


def upsert(old: DataFrame, new: DataFrame, key: str, updated: list[str] | tuple[str, ...]) -> DataFrame:
    """old with new's rows: those with a new key are added whole, others take the updated columns. One row a key on each side."""
    a, b = old.alias("a"), new.alias("b")
    fresh = F.col(f"b.{key}").isNotNull()
    known = F.col(f"a.{key}").isNotNull()

    def merged(c: str):
        if c == key:
            return F.coalesce(f"a.{c}", f"b.{c}").alias(c)
        if c not in new.columns:
            return F.col(f"a.{c}").alias(c)
        take = fresh if c in updated else ~known
        return F.when(take, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)

    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*(merged(c) for c in old.columns))


def provenance_rank(c: str = "provenance"):
    rank = F
    for k, p in enumerate(PROVENANCES):
        rank = rank.when(F.col(c) == p, k)
    return rank.otherwise(len(PROVENANCES))


def insert_or_ignore(edges: DataFrame, null_lines_apart: bool = True) -> DataFrame:
    """One edge for each source, target, kind and line: the best provenance, then the least id; rows without a line never clash."""
    order = Window.partitionBy("source", "target", "kind", "line").orderBy(provenance_rank(), "id")
    ranked = edges.withColumn("n", F.row_number().over(order))
    keep = (F.col("n") == 1) | F.col("line").isNull() if null_lines_apart else F.col("n") == 1
    return ranked.where(keep).drop("n")


def purge_duplicates(edges: DataFrame) -> DataFrame:
    """The edge with the least id for each source, target, kind and line, no line counting as 0."""
    order = Window.partitionBy("source", "target", "kind", F.coalesce("line", F.lit(0))).orderBy("id")
    return edges.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def keep_first(nodes: DataFrame) -> DataFrame:
    """The first definition of each id by line."""
    order = Window.partitionBy("id").orderBy("start_line", "end_line")
    return nodes.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def reload_source(table: DataFrame, new: DataFrame, provenance: str, languages: list[str] | None = None) -> DataFrame:
    """table without the rows of a provenance (and languages), and new in their place."""
    gone = F.col("provenance") == provenance
    if languages is not None and "language" in table.columns:
        gone &= F.col("language").isin(*languages)
    return table.where(~gone).unionByName(new.select(*table.columns))


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, paths: DataFrame, keep_imported: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without the paths (path): nodes in them, edges that start there, their rows."""
    gone = nodes.join(paths.select(F.col("path").alias("file_path")).hint("merge"), "file_path", "left_semi")
    if keep_imported:
        gone = gone.where(~(F.startswith(F.col("id"), F.lit("scip")) | F.startswith(F.col("id"), F.lit("external"))))
    return (
        nodes.join(gone.select("id").hint("merge"), "id", "left_anti").select(*nodes.columns),
        edges.join(gone.select(F.col("id").alias("source")).hint("merge"), "source", "left_anti").select(*edges.columns),
        files.join(paths.select("path").hint("merge"), "path", "left_anti").select(*files.columns),
    )


def prune(nodes: DataFrame, edges: DataFrame, files: DataFrame, rule: PathFilter) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without what no stage of a filter allows."""
    p = F.col("path")
    gone = files.where(~(rule.allows(p, "scip") | rule.allows(p, "tree-sitter"))).select("path")
    lost = nodes.join(gone.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    return (
        nodes.join(lost, "id", "left_anti").select(*nodes.columns),
        edges.join(lost.select(F.col("id").alias("source")), "source", "left_anti").join(lost.select(F.col("id").alias("target")), "target", "left_anti").select(*edges.columns),
        files.join(gone, "path", "left_anti").select(*files.columns),
    )


def load_verdicts(found: DataFrame) -> DataFrame:
    """Verdict rows with has_active_defect and stage, in place of all before."""
    return found.withColumn("has_active_defect", (F.col("decision") == "REJECT").cast("long")).withColumn("stage", F.lit("final_verdict"))


def external_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, kind, name of a placeholder for each external: target without a node."""
    ids = edges.where(F.startswith(F.col("target"), F.lit("external:"))).select(F.col("target").alias("id")).distinct().join(nodes.select("id").hint("merge"), "id", "left_anti")
    return ids.select("id", F.lit("external").alias("kind"), F.substring("id", F.lit(len("external:") + 1), F.length("id")).alias("name"))


def fill_metadata(edges: DataFrame) -> DataFrame:
    return edges.withColumn("metadata", F.coalesce("metadata", F.lit("")))


def sync(files: DataFrame, now: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """What a sync does: path and action (add, change, delete) for now (path, content_hash) against files; unchanged paths have none."""
    both = files.select("path", F.col("content_hash").alias("old")).join(now.select("path", F.col("content_hash").alias("new")), "path", "full")
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "change")
    out = both.select("path", action.alias("action")).where("action is not null")
    return out if removed is None else out.where("action != 'delete'").unionByName(removed.select("path", F.lit("delete").alias("action")))
