"""Documents on files, directories and a whole project, as rows: section, at (place in the section), name and value.

Each is a composition of the metrics for all files or directories at once; a reader puts the rows of one into words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.predicates import dir_of, language_name, module_of
from lodestone.operators import graph, metrics

#: Most rows of a section.
INTERFACES, STRUCTURES, RISKS, CHAINS, CYCLES, CALLERS = 15, 8, 10, 5, 10, 5
FUNCTIONS = "kind in ('function', 'method')"
DATA = "kind in ('struct', 'class', 'interface')"


def _rows(df: DataFrame, of: Column | None, section: str, at: Column, name: Column, value: Column) -> DataFrame:
    keys = [] if of is None else [of.alias("of")]
    return df.select(*keys, F.lit(section).alias("section"), at.cast("long").alias("at"), name.cast("string").alias("name"), value.cast("string").alias("value"))


def _first(df: DataFrame, n: int, *order: Column, by: str | None = "of") -> DataFrame:
    """The first n rows of each `by`, numbered at from 1."""
    if by is None:
        return df.orderBy(*order).limit(n).withColumn("at", F.row_number().over(Window.orderBy(*order)))  # n rows
    return df.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("at") <= n)


def _table(df: DataFrame, of: str | None, section: str, names: dict[str, Column]) -> DataFrame:
    """One row for each of several figures of each row of df."""
    listed = F.array(*(F.struct(F.lit(k).alias("at"), F.lit(n).alias("name"), v.cast("string").alias("value")) for k, (n, v) in enumerate(names.items(), 1)))
    spread = df.select(*([F.col(of).alias("of")] if of else []), F.explode(listed).alias("r"))
    return _rows(spread, F.col("of") if of else None, section, F.col("r.at"), F.col("r.name"), F.col("r.value"))


def interfaces(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """of (file), at, id, name, signature, fan_in and callers' first names: a file's exported functions, most called first."""
    calls = edges.where("kind = 'calls'").join(nodes.select(F.col("id").alias("source"), F.col("name").alias("caller")), "source", "left")
    called = calls.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("fan_in"), F.array_sort(F.collect_set("caller")).alias("callers"))
    own = nodes.where(f"{FUNCTIONS} and is_exported != 0").join(called, "id", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
    signature = F.coalesce(F.when(F.col("signature") != "", F.col("signature")), F.concat("name", F.lit("()"))) if "signature" in nodes.columns else F.concat("name", F.lit("()"))
    found = own.select(F.col("file_path").alias("of"), "id", "name", signature.alias("signature"), "fan_in", F.coalesce(F.array_join(F.slice("callers", 1, CALLERS), ", "), F.lit("")).alias("callers"))
    return _first(found, INTERFACES, F.desc("fan_in"), F.col("name"), F.col("id"))


def structures(nodes: DataFrame) -> DataFrame:
    """of (file), at, name and kind of a file's first structures."""
    return _first(nodes.where(DATA).select(F.col("file_path").alias("of"), "name", "kind", "start_line", "id"), STRUCTURES, F.col("start_line"), F.col("id"))


def file_documents(nodes: DataFrame, edges: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """of (file), section, at, name, value: role, overview, risks, interfaces, structures, inner functions, needs and a way to read.

    figures (id, branches, loc, depth, returns) of functions, for the risks.
    """
    of = F.col("of")
    needs = metrics.file_dependencies(nodes, edges)
    sizes = nodes.groupBy(F.col("file_path").alias("of")).agg(
        F.count("*").alias("symbols"), F.count_if(F.expr(f"{FUNCTIONS} and is_exported != 0")).alias("public"), F.count_if(F.expr(f"{FUNCTIONS} and is_exported = 0")).alias("inner"),
        F.count_if(F.expr(DATA)).alias("data"), F.min_by("language", F.struct("start_line", "id")).alias("language"),
    )
    outs = needs.groupBy(F.col("file").alias("of")).agg(F.count("*").alias("outs"))
    ins = needs.groupBy(F.col("needs").alias("of")).agg(F.count("*").alias("ins"))
    overview = sizes.join(outs, "of", "left").join(ins, "of", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    figures_of = {"language": language_name("language"), "symbols": F.col("symbols"), "public functions": F.col("public"), "inner functions": F.col("inner"), "structures": F.col("data"), "files needed": zero("outs"), "files that need it": zero("ins")}
    faces, data = interfaces(nodes, edges), structures(nodes)
    roles = metrics.roles(nodes, F.col("file_path"))
    inner = nodes.where(f"{FUNCTIONS} and is_exported = 0").select(F.col("file_path").alias("of"), "name", "start_line", "id")
    inner = inner.withColumn("at", F.row_number().over(Window.partitionBy("of").orderBy("start_line", "id")))
    ranked = needs.withColumn("at", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("calls"), "needs")))
    parts = [
        _rows(roles, of, "role", F.lit(1), F.lit("role"), F.col("role")),
        _table(overview, "of", "overview", figures_of),
        _rows(faces, of, "interfaces", F.col("at"), F.col("name"), F.concat("signature", F.lit(", called "), "fan_in", F.when(F.col("callers") != "", F.concat(F.lit(" by "), "callers")).otherwise(""))),
        _rows(data, of, "structures", F.col("at"), F.col("name"), F.col("kind")),
        _rows(inner, of, "inner functions", F.col("at"), F.col("name"), F.concat(F.lit("line "), "start_line")),
        _rows(ranked, F.col("file"), "needs", F.col("at"), F.col("needs"), F.concat("calls", F.lit(" calls, by "), "callers")),
        _rows(faces.where("at <= 2"), of, "reading", F.col("at"), F.col("name"), F.concat(F.lit("called "), "fan_in")),
        _rows(data.where("at = 1"), of, "reading", F.lit(3), F.col("name"), F.col("kind")),
    ]
    if figures is not None:
        risks = metrics.risk(nodes, edges, figures).join(nodes.select("id", "name", F.col("file_path").alias("of")), "id")
        risks = _first(risks.select("of", "id", "name", "risk", "cyclomatic", "reasons"), RISKS, F.desc("risk"), F.desc("cyclomatic"), F.col("id"))
        parts.append(_rows(risks, of, "risks", F.col("at"), F.col("name"), F.concat(F.format_number("risk", 1), F.lit(": "), F.array_join("reasons", "; "))))
    return reduce(DataFrame.unionByName, parts)


def module_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """of (directory), section, at, name, value: role, overview, files, needs of other directories and the ones most coupled."""
    of, d = F.col("of"), dir_of("file_path")
    stats = metrics.directory_stats(nodes, edges).withColumnRenamed("dir", "of")
    files = metrics.file_stats(nodes, edges).join(metrics.roles(nodes, F.col("file_path")).withColumnRenamed("of", "file"), "file").withColumn("of", dir_of("file"))
    counted = files.groupBy("of").agg(F.count("*").alias("files"))
    files = files.withColumn("at", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("callers"), "file")))
    links = metrics.directory_links(nodes, edges)
    outs = _first(links.select(F.col("source").alias("of"), F.col("target").alias("other"), "n"), 10_000, F.desc("n"), F.col("other"))
    both = links.select(F.col("source").alias("of"), F.col("target").alias("other"), "n").unionByName(links.select(F.col("target").alias("of"), F.col("source").alias("other"), "n"))
    coupled = _first(both.groupBy("of", "other").agg(F.sum("n").alias("n")), 10, F.desc("n"), F.col("other"))
    parts = [
        _rows(metrics.roles(nodes, d), of, "role", F.lit(1), F.lit("role"), F.col("role")),
        _table(stats.join(counted, "of"), "of", "overview", {"files": F.col("files"), "symbols": F.col("symbols"), "exported": F.col("exported"), "calls in": F.col("fan_in"), "calls out": F.col("fan_out")}),
        _rows(files, of, "files", F.col("at"), F.col("file"), F.concat("role", F.lit(", "), "symbols", F.lit(" symbols, "), "callers", F.lit(" calls in"))),
        _rows(outs, of, "needs", F.col("at"), F.col("other"), F.concat("n", F.lit(" calls"))),
        _rows(coupled, of, "coupled", F.col("at"), F.col("other"), F.concat("n", F.lit(" calls"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def project_document(nodes: DataFrame, edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """section, at, name, value: overview, languages, modules, layers, calls past a layer, verbs without a counterpart, call chains from entries and cycles."""
    numbers = nodes.agg(F.count("*").alias("symbols"), F.count_distinct("file_path").alias("files"), F.count_distinct(module_of("file_path")).alias("modules"), F.count_if(F.col("is_exported") != 0).alias("exported"))
    numbers = numbers.crossJoin(edges.agg(F.count("*").alias("links")))  # of one row each
    languages = _first(nodes.groupBy(F.col("language").alias("name")).agg(F.count("*").alias("n")), 50, F.desc("n"), F.col("name"), by=None)
    modules = _first(metrics.module_sizes(nodes), 50, F.desc("n"), F.col("module"), by=None)
    layers = nodes.select(dir_of("file_path").alias("dir")).distinct().withColumn("rank", metrics.layer_rank(F.col("dir")))
    layers = layers.groupBy("rank").agg(F.array_join(F.slice(F.array_sort(F.collect_set("dir")), 1, 10), ", ").alias("dirs"), F.count("*").alias("n"))
    past = _first(metrics.boundary_violations(nodes, edges), 12, F.desc("n"), F.col("source"), F.col("target"), by=None)
    alone = _first(metrics.symmetry_risks(nodes), 12, F.col("present"), F.col("missing"), by=None)
    starts = nodes.where("name = 'main' or kind = 'route'").select("id") if entries is None else entries
    chains = _first(graph.call_chains(nodes, edges, starts.orderBy("id").limit(CHAINS), 2, CHAINS), CHAINS, F.col("chain"), by=None)
    ids = nodes.select("id", dir_of("file_path").alias("dir"))
    ended = edges.where("kind = 'imports'").join(ids.select(F.col("id").alias("source"), F.col("dir").alias("a")), "source").join(ids.select(F.col("id").alias("target"), F.col("dir").alias("b")), "target")
    between = ended.where("a != b").select(F.col("a").alias("source"), F.col("b").alias("target")).distinct()
    cycles = graph.cyclic(between).groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("id")), ", ").alias("members"))
    cycles = _first(cycles, CYCLES, F.col("component"), by=None)
    parts = [
        _table(numbers, None, "overview", {"symbols": F.col("symbols"), "links": F.col("links"), "files": F.col("files"), "modules": F.col("modules"), "exported": F.col("exported")}),
        _rows(languages, None, "languages", F.col("at"), language_name("name"), F.col("n")),
        _rows(modules, None, "modules", F.col("at"), F.col("module"), F.col("n")),
        _rows(layers, None, "layers", F.col("rank"), F.element_at(F.array(F.lit("upper"), F.lit("middle"), F.lit("lower")), F.col("rank")), F.concat("n", F.lit(": "), "dirs")),
        _rows(past, None, "calls past a layer", F.col("at"), F.concat("source", F.lit(" → "), "target"), F.concat("n", F.lit(" calls, "), "direction")),
        _rows(alone, None, "verbs without a counterpart", F.col("at"), F.concat("present", F.lit(" without "), "missing"), F.col("example")),
        _rows(chains, None, "chains", F.col("at"), F.col("chain"), F.lit("")),
        _rows(cycles, None, "cycles", F.col("at"), F.col("component"), F.col("members")),
    ]
    return reduce(DataFrame.unionByName, parts)
