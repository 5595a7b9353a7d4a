"""Counts, shares, roll-ups and risk figures over the code graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.predicates import dir_of, like, module_of, non_synthetic
from lodestone.operators.graph import fans

#: Words that tell of a layer's role, in order of preference where counts are equal.
ROLE_WORDS = {
    "handler": ("handler", "controller", "router", "route", "serve", "endpoint", "action"),
    "service": ("service", "query", "process", "execute", "compute", "analyze", "transform"),
    "data access": ("repo", "store", "db", "sql", "dal", "database", "persist", "cache", "dao"),
    "data model": ("model", "entity", "dto", "vo", "schema", "struct", "type", "message"),
    "utility": ("util", "helper", "common", "shared", "format", "convert", "parse", "marshal"),
    "configuration": ("config", "setting", "option", "flag", "env", "init", "setup"),
    "middleware": ("middleware", "interceptor", "filter", "guard", "auth", "logging"),
    "testing": ("test", "mock", "stub", "fake", "fixture"),
}
#: Verbs that come in pairs.
VERB_PAIRS = (
    ("init", "deinit"), ("initialize", "shutdown"), ("start", "stop"), ("open", "close"), ("lock", "unlock"), ("alloc", "free"),
    ("malloc", "free"), ("create", "destroy"), ("new", "delete"), ("enable", "disable"), ("register", "unregister"), ("add", "remove"),
    ("push", "pop"), ("enter", "exit"), ("connect", "disconnect"), ("subscribe", "unsubscribe"),
)
#: Words of directories and roles by layer.
UPPER_LAYER = ("handler", "controller", "route", "cmd")
LOWER_LAYER = ("driver", "adapter", "infra", "storage", "db", "repo", "data access")


def ratio(a: Column, b: Column) -> Column:
    """a / b rounded to six places, 0 where b is 0."""
    return F.when(b > 0, F.round(a.cast("double") / b.cast("double"), 6)).otherwise(F.lit(0.0))


def status(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    counts = [df.agg(F.count("*").alias(name)) for name, df in (("nodes", nodes), ("edges", edges), ("files", files))]
    row = counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # of one row each
    return row.withColumn("status", F.when(F.col("nodes") == 0, "indexing").otherwise("ready"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def coupling(edges: DataFrame, prefix: str = "", kind: str = "imports") -> DataFrame:
    """ca, ce and instability: distinct sources from outside a prefix into it, and distinct targets the other way."""
    own = edges.where(F.col("kind") == kind)
    if prefix:
        s, t = like("source", prefix + "%"), like("target", prefix + "%")
        counts = own.agg(F.count_distinct(F.when(t & ~s, F.col("source"))).alias("ca"), F.count_distinct(F.when(s & ~t, F.col("target"))).alias("ce"))
    else:
        counts = own.agg(F.count_distinct("source").alias("ca"), F.count_distinct("target").alias("ce"))
    return counts.withColumn("instability", ratio(F.col("ce"), F.col("ca") + F.col("ce")))


def ended(nodes: DataFrame, edges: DataFrame, of: Column) -> DataFrame:
    """Edges with what `of` says of both ends' nodes, as from and to."""
    named = nodes.select("id", of.alias("of"))
    return edges.join(named.select(F.col("id").alias("source"), F.col("of").alias("from")), "source").join(named.select(F.col("id").alias("target"), F.col("of").alias("to")), "target")


def module_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.where(non_synthetic()).groupBy(module_of("file_path").alias("module")).agg(F.count("*").alias("n"))


def module_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target and n: edges from one module to another, both ends visible."""
    both = ended(nodes.where(non_synthetic()), edges, module_of("file_path")).where(F.col("from") != F.col("to"))
    return both.groupBy(F.col("from").alias("source"), F.col("to").alias("target")).agg(F.count("*").alias("n"))


def roll_up(nodes: DataFrame, edges: DataFrame, by: Column) -> DataFrame:
    """source, target, calls between two places (files or directories), and the target's and source's sums over all links."""
    links = ended(nodes, edges.where("kind = 'calls'"), by).where(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.count("*").alias("calls"))
    outs = links.groupBy("from").agg(F.sum("calls").alias("out_calls"))
    ins = links.groupBy("to").agg(F.sum("calls").alias("in_calls"))
    return links.join(outs, "from").join(ins, "to").select(F.col("from").alias("source"), F.col("to").alias("target"), "calls", "out_calls", "in_calls")


def module_file_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """file, ins and outs: distinct files of one's module that call it and that it calls."""
    links = ended(nodes, edges.where("kind = 'calls'"), F.col("file_path")).where((F.col("from") != F.col("to")) & (module_of("from") == module_of("to"))).select("from", "to").distinct()
    ends = links.select(F.col("from").alias("file"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(links.select(F.col("to").alias("file"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("file").agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"))


def owners(commits: DataFrame, path: str | None = None) -> DataFrame:
    """author, n and percent of the commits (of a path); Unknown, 1 and 100 without any."""
    own = commits.where(F.col("path") == path) if path is not None else commits
    counts = own.groupBy("author").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    shares = counts.crossJoin(F.broadcast(total)).select("author", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 6).alias("percent"))
    nobody = total.where("total is null").select(F.lit("Unknown").alias("author"), F.lit(1).cast("long").alias("n"), F.lit(100.0).alias("percent"))
    return shares.unionByName(nobody)


def hotspots(commits: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """path, commits and functions of the files with most commits."""
    busy = commits.groupBy("path").agg(F.count("*").alias("commits"))
    inside = nodes.where("kind in ('function', 'method')").groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("functions"))
    return busy.join(inside, "path", "left").select("path", "commits", F.coalesce("functions", F.lit(0)).cast("long").alias("functions")).orderBy(F.desc("commits"), "path").limit(limit)


def commit_counts(commits: DataFrame, files: DataFrame) -> DataFrame:
    """path and commits; where a file has none, the day of its last change."""
    counts = commits.groupBy("path").agg(F.count("*").alias("commits"))
    return files.join(counts, "path", "left").select("path", F.coalesce("commits", F.floor(F.col("modified_at") / 86400)).cast("long").alias("commits"))


def directory_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """dir, symbols, exported, fan_in and fan_out: calls of exported symbols over directories."""
    d = dir_of("file_path")
    sizes = nodes.groupBy(d.alias("dir")).agg(F.count("*").alias("symbols"), F.count_if(F.col("is_exported") != 0).alias("exported"))
    links = directory_links(nodes, edges)
    outs = links.groupBy(F.col("source").alias("dir")).agg(F.sum("n").alias("fan_out"))
    incoming = _exported_calls(nodes, edges, "target").where((F.col("from") != F.col("to")) & (F.col("from") != ".")).groupBy(F.col("to").alias("dir")).agg(F.count("*").alias("fan_in"))
    return sizes.join(outs, "dir", "left").join(incoming, "dir", "left").select("dir", "symbols", "exported", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fan_in", "fan_out")))


def _exported_calls(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    public = nodes.where("is_exported != 0").select(F.col("id").alias(end))
    return ended(nodes, edges.where("kind = 'calls'").join(public, end, "left_semi"), dir_of("file_path"))


def directory_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target and n: calls of exported symbols into other directories, . left out."""
    calls = _exported_calls(nodes, edges, "source").where((F.col("from") != F.col("to")) & (F.col("to") != "."))
    return calls.groupBy(F.col("from").alias("source"), F.col("to").alias("target")).agg(F.count("*").alias("n"))


def strongest_couplings(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """dir, ins and outs of the directories with most calls over their border."""
    links = ended(nodes, edges.where("kind = 'calls'"), dir_of("file_path")).where(F.col("from") != F.col("to"))
    outs = links.groupBy(F.col("from").alias("dir")).agg(F.count("*").alias("outs"))
    ins = links.groupBy(F.col("to").alias("dir")).agg(F.count("*").alias("ins"))
    both = ins.join(outs, "dir", "full").select("dir", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("ins", "outs")))
    return both.orderBy(F.desc(F.col("ins") + F.col("outs")), "dir").limit(limit)


def file_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """file, symbols, exported, callers: calls into a file's symbols."""
    sizes = nodes.groupBy(F.col("file_path").alias("file")).agg(F.count("*").alias("symbols"), F.count_if(F.col("is_exported") != 0).alias("exported"))
    calls = edges.where("kind = 'calls'").join(nodes.select(F.col("id").alias("target"), F.col("file_path").alias("file")), "target").groupBy("file").agg(F.count("*").alias("callers"))
    return sizes.join(calls, "file", "left").withColumn("callers", F.coalesce("callers", F.lit(0)).cast("long"))


def file_dependencies(nodes: DataFrame, edges: DataFrame, names: int = 3) -> DataFrame:
    """file, needs, calls and the first callers' names of each pair of files."""
    calls = edges.where("kind = 'calls'").join(nodes.select(F.col("id").alias("source"), F.col("file_path").alias("file"), "name"), "source").join(nodes.select(F.col("id").alias("target"), F.col("file_path").alias("needs")), "target")
    found = calls.where("file != needs").groupBy("file", "needs").agg(F.count("*").alias("calls"), F.array_sort(F.collect_set("name")).alias("names"))
    return found.select("file", "needs", "calls", F.array_join(F.slice("names", 1, names), ", ").alias("callers"))


def language_mix(files: DataFrame) -> DataFrame:
    """language, n and the first three paths, joined."""
    counts = files.groupBy("language").agg(F.count("*").alias("n"))
    ranked = files.withColumn("k", F.row_number().over(Window.partitionBy("language").orderBy("path"))).where("k <= 3")
    return counts.join(ranked.groupBy("language").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("first_paths")), "language")


def audit(verdicts: DataFrame) -> DataFrame:
    """defects, and whether the gate is passed."""
    return verdicts.agg(F.count_if(F.col("has_active_defect") == 1).alias("defects")).withColumn("passed", (F.col("defects") == 0).cast("long"))


def roles(nodes: DataFrame, by: Column) -> DataFrame:
    """of and role: the role with most words found in names, qualified names and documentation; without any the share of
    exported symbols tells: interface above 0.7, internal below 0.3, else mixed."""
    text = F.lower(F.concat_ws("\n", "name", "qualified_name", *(["docstring"] if "docstring" in nodes.columns else [])))
    hits = [F.sum(reduce(lambda a, b: a + b, (text.contains(w).cast("int") for w in ws))).alias(f"r{k}") for k, ws in enumerate(ROLE_WORDS.values())]
    sums = nodes.groupBy(by.alias("of")).agg(*hits, F.avg((F.col("is_exported") != 0).cast("int")).alias("share"))
    most = F.greatest(*(F.col(f"r{k}") for k in range(len(ROLE_WORDS))))
    role = F
    for k, name in enumerate(ROLE_WORDS):
        role = role.when((most > 0) & (F.col(f"r{k}") == most), name)
    return sums.select("of", role.when(F.col("share") > 0.7, "interface").when(F.col("share") < 0.3, "internal").otherwise("mixed").alias("role"))


def layer_rank(text: Column) -> Column:
    low = F.lower(text)
    any_of = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    return F.when(any_of(UPPER_LAYER), 1).when(any_of(LOWER_LAYER), 3).otherwise(2)


def boundary_violations(nodes: DataFrame, edges: DataFrame, limit: int = 12) -> DataFrame:
    """source, target, n and direction where an upper layer calls a lower one past the middle, or the other way."""
    ranked = roles(nodes, dir_of("file_path")).select("of", layer_rank(F.concat_ws(" ", "of", "role")).alias("rank"))
    links = directory_links(nodes, edges).join(ranked.select(F.col("of").alias("source"), F.col("rank").alias("s")), "source").join(ranked.select(F.col("of").alias("target"), F.col("rank").alias("t")), "target")
    found = links.where("(s = 1 and t = 3) or (s = 3 and t = 1)").withColumn("direction", F.when(F.col("s") == 1, "down").otherwise("up"))
    return found.select("source", "target", "n", "direction").orderBy(F.desc("n"), "source", "target").limit(limit)


def symmetry_risks(nodes: DataFrame, limit: int = 12) -> DataFrame:
    """present, missing and example where only one of two verbs that belong together is found in names."""
    own = nodes.where("kind in ('function', 'method')").select(F.lower("name").alias("low"), "name")
    verbs = sorted({v for p in VERB_PAIRS for v in p})
    seen = own.agg(*(F.min(F.when(F.col("low").contains(v), F.col("name"))).alias(v) for v in verbs))
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in VERB_PAIRS]
    pairs = seen.select(F.inline(F.array(*rows)))
    one = pairs.where("(x is null) != (y is null)")
    return one.select(F.when(F.col("x").isNotNull(), F.col("a")).otherwise(F.col("b")).alias("present"), F.when(F.col("x").isNull(), F.col("a")).otherwise(F.col("b")).alias("missing"), F.coalesce("x", "y").alias("example")).orderBy("present", "missing").limit(limit)


def layer_buckets(stats: DataFrame) -> DataFrame:
    """directory_stats with bucket: entry, infrastructure or business."""
    return stats.withColumn("bucket", F.when((F.col("fan_in") == 0) & (F.col("exported") > 0), "entry").when(F.col("fan_out") > 5, "infrastructure").otherwise("business"))


def brief(nodes: DataFrame, by: Column) -> DataFrame:
    """of and summary: the first three exported functions with documentation."""
    own = nodes.where("is_exported != 0 and kind in ('function', 'method') and docstring is not null and docstring != ''")
    ranked = own.select(by.alias("of"), "name", "docstring", "start_line", "id").withColumn("k", F.row_number().over(Window.partitionBy("of").orderBy("start_line", "id"))).where("k <= 3")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat("name", F.lit(": "), F.substring("docstring", 1, 60)).alias("t")))), lambda s: s["t"])
    return ranked.groupBy("of").agg(F.array_join(parts, "; ").alias("summary"))


def project_languages(files: DataFrame) -> DataFrame:
    """language and files, most first, by extension."""
    from lodestone.functions.predicates import LANGUAGE_EXTENSIONS, by_extension

    pairs = {e: lang for lang, exts in LANGUAGE_EXTENSIONS.items() for e in exts}
    named = files.select(by_extension("path", pairs, None).alias("language")).where("language is not null")
    return named.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


def rollup_counts(nodes: DataFrame) -> DataFrame:
    """module, file and n at each grain: files, modules, all."""
    return nodes.select(module_of("file_path").alias("module"), F.col("file_path").alias("file")).rollup("module", "file").agg(F.count("*").alias("n"))


def risk(nodes: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """texts (id, branches, loc, depth, returns) with fan_in, fan_out, cross, cyclomatic, risk and reasons; highest risk first."""
    from lodestone.functions.text import complexity_reasons

    public = ((F.col("is_exported") != 0) | (F.col("visibility") == "public")) if "visibility" in nodes.columns else F.col("is_exported") != 0
    joined = texts.join(nodes.select("id", F.coalesce(public, F.lit(False)).alias("public")), "id").join(fans(nodes, edges), "id")
    scored = joined.withColumn("cyclomatic", F.col("branches") + 1).withColumn("risk", 2 * (1 + F.col("branches")) + F.col("loc") / 10 + 3 * F.col("depth") + 2 * F.col("fan_in") + F.col("fan_out") + 2 * F.col("cross") + F.when(F.col("public"), 5).otherwise(0))
    return scored.withColumn("reasons", complexity_reasons()).orderBy(F.desc("risk"), F.desc("cyclomatic"), "id")


def diagram(nodes: DataFrame, edges: DataFrame, limit: int = 15) -> DataFrame:
    """line: a flowchart of the calls among the limit nodes with most of them."""
    from lodestone.functions.predicates import diagram_id
    from lodestone.operators.lookup import between, degrees

    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(limit)
    named = nodes.join(F.broadcast(top.select("id")), "id", "left_semi").select("id", "name")
    links = between(edges.where("kind = 'calls'"), named).select("source", "target").distinct()
    head = nodes.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("graph LR").alias("line"))
    boxes = named.select(F.lit(1).alias("part"), F.format_string('  %s["%s"]', diagram_id("id"), "name").alias("line"))
    arrows = links.select(F.lit(2).alias("part"), F.format_string("  %s --> %s", diagram_id("source"), diagram_id("target")).alias("line"))
    return head.unionByName(boxes).unionByName(arrows).orderBy("part", "line").select("line")

