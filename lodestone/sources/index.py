"""The whole index of a project: files found, parsed and linked into the four tables; and tables kept in versions.

A run reads the tree, parses each file on its own, then links over files: calls by name, interfaces, routes, placeholders for
what lies outside. An update parses only files whose hash has changed. Tables are written beside the ones in use and taken
into use by one rename, so that a reader sees all of a batch or nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.globs import PathFilter
from lodestone.functions.schemas import EDGES, FILES, NODES, VERDICTS, conform
from lodestone.operators import joins, mutations
from lodestone.session import Stages
from lodestone.sources import files, parse


@dataclass
class Tables:
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    verdicts: DataFrame

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(k, getattr(self, k)) for k in ("nodes", "edges", "files", "verdicts")]


def numbered(edges: DataFrame) -> DataFrame:
    """Edges with ids that follow from what is unique of an edge, so that another run gives the same."""
    return edges.withColumn("id", F.xxhash64("source", "target", "kind", F.coalesce("line", F.lit(0))))


def linked(nodes: DataFrame, sources: DataFrame, own: DataFrame) -> DataFrame:
    """Edges over files (source, target, kind, provenance, line), for sources (path, text), with own, the edges within files."""
    calls = joins.cross_file_calls(sources, nodes).select("source", "target", F.lit("calls").alias("kind"), F.lit("heuristic").alias("provenance"), "line")
    meets = joins.implements(nodes, own.where("kind = 'contains'"), same_language=True)
    meets = meets.select(F.col("struct").alias("source"), F.col("interface").alias("target"), F.lit("implements").alias("kind"), F.lit("heuristic").alias("provenance"), F.lit(0).cast("long").alias("line"))
    routes = joins.routes(sources, nodes).select(F.col("route").alias("source"), F.col("handler").alias("target"), F.lit("route").alias("kind"), F.lit("heuristic").alias("provenance"), F.lit(0).cast("long").alias("line"))
    return calls.unionByName(meets).unionByName(routes)


def placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes for routes and for external targets."""
    routes = edges.where("kind = 'route'").select(F.col("source").alias("id"), F.lit("route").alias("kind"), F.substring("source", F.lit(len("route:") + 1), F.length("source")).alias("name"), F.lit("http").alias("language")).distinct()
    return routes.unionByName(mutations.external_nodes(nodes, edges).withColumn("language", F.lit("unknown"))).withColumn("qualified_name", F.col("name")).withColumn("file_path", F.lit("")).withColumn("start_line", F.lit(0)).withColumn("end_line", F.lit(0))


def without(known: Tables, paths: DataFrame) -> Tables:
    """known without files (path): their nodes, the edges that start in them or at them, their rows."""
    nodes, edges, kept = mutations.delete_files(known.nodes, known.edges, known.files, paths, keep_imported=True)
    edges = edges.join(paths.select(F.concat(F.lit("file:"), "path").alias("source")).hint("merge"), "source", "left_anti").select(*known.edges.columns)
    return replace(known, nodes=nodes, edges=edges, files=kept)


def build(sources: DataFrame, verdicts: DataFrame | None = None, known: Tables | None = None) -> Tables:
    """The tables of sources (path, text, language, content_hash, size, modified_at); with known, all of its files that sources
    don't have stay as they are, but for links to what is no more. A file that stays is not searched for calls of new names."""
    spark = sources.sparkSession
    stages = Stages(spark)
    parsed = stages.write(parse.parse_files(sources), "parsed")
    nodes = conform(parse.nodes_of(parsed), NODES)
    own = parse.edges_of(parsed)
    if known is not None:
        rest = without(known, sources.select("path"))
        nodes = conform(rest.nodes.where("kind not in ('route', 'external')"), NODES).unionByName(nodes)
    nodes = stages.write(mutations.keep_first(nodes), "nodes")
    if known is not None:
        there = nodes.select(F.col("id").alias("target"))
        made = F.col("target").rlike("^(external|import):")
        kept = rest.edges.where("kind != 'implements'").select("source", "target", "kind", "provenance", "line")
        own = own.unionByName(kept.where(made).unionByName(kept.where(~made).join(there.hint("merge"), "target", "left_semi").select(*kept.columns)))
    own = stages.write(own, "own")
    edges = stages.write(conform(mutations.insert_or_ignore(numbered(own.unionByName(linked(nodes, sources, own))), null_lines_apart=False), EDGES), "edges")
    every = nodes.unionByName(conform(placeholders(nodes, edges), NODES))
    counts = nodes.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("node_count"))
    notes = parsed.where("row = 'file'").select("path", "errors")
    now = sources.select("path", "content_hash", "language", "size", "modified_at").join(counts.hint("merge"), "path", "left").join(notes.hint("merge"), "path", "left")
    now = conform(now.withColumn("node_count", F.coalesce("node_count", F.lit(0))), FILES)
    if known is not None:
        now = conform(rest.files, FILES).unionByName(now)
    found = mutations.load_verdicts(verdicts) if verdicts is not None else None
    if found is not None:
        found = conform(found.withColumn("id", F.xxhash64("symbol_id", "rule_id")), VERDICTS)
    elif known is not None:
        found = known.verdicts
    else:
        found = spark.createDataFrame([], VERDICTS)
    return Tables(every, edges, now, found)


def index(spark: SparkSession, root: str, rule: PathFilter | None = None, verdicts: DataFrame | None = None) -> Tables:
    """The tables of all source files below a folder."""
    return build(files.tree(spark, root, rule, "tree-sitter"), verdicts)


def update(spark: SparkSession, root: str, known: Tables, rule: PathFilter | None = None) -> Tables:
    """known after another look at the folder: files with another hash are parsed again, those that are gone go, others stay."""
    now = files.tree(spark, root, rule, "tree-sitter")
    actions = Stages(spark).write(mutations.sync(known.files.select("path", "content_hash"), now.select("path", "content_hash")), "actions")
    if actions.isEmpty():
        return known
    gone = actions.where("action = 'delete'").select("path")
    return build(now.join(actions.where("action != 'delete'").hint("merge"), "path", "left_semi"), None, without(known, gone))


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def commit(tables: Tables, root: str) -> str:
    """Writes all tables as a new version below root, and takes them into use by renaming one file; the version's name."""
    spark = tables.nodes.sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{root}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("error").text(f"{root}/{version}/pointer")
    here, fs = _fs(spark, f"{root}/{version}/pointer")
    part = next(s.getPath() for s in fs.listStatus(here) if s.getPath().getName().startswith("part-"))
    current, _ = _fs(spark, f"{root}/CURRENT")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(here.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, current, options)
    return version


def opened(spark: SparkSession, root: str) -> Tables:
    """The version of the tables that is in use."""
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    return Tables(*(spark.read.schema(s).parquet(f"{root}/{version}/{name}") for name, s in (("nodes", NODES), ("edges", EDGES), ("files", FILES), ("verdicts", VERDICTS))))
