"""Registered queries: whole index runs, versions of tables, documents, files that are written and read again, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.globs import PathFilter
from lodestone.operators import documents, graph, lookup
from lodestone.plans.q_ingest import FILE, sources
from lodestone.plans.q_lookup import DIR, MOST_CALLED, P0, most_called
from lodestone.plans.registry import query
from lodestone.plans.sqlapi import as_json, from_json
from lodestone.session import Stages
from lodestone.sources import files, index
from lodestone.streaming import changes


def found(g):
    """Sources as a walk of a tree gives them."""
    made = sources(g)
    return made.select("path", "text", "language", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size"), F.lit(1).cast("long").alias("modified_at"))


@query("I01_index_nodes", f"select 'go:' || {FILE} || '::F' || p_partkey as id, 'function' as kind, 'F' || p_partkey as name from part union all select 'go:' || {FILE} || '::g' || p_partkey, 'function', 'g' || p_partkey from part union all select 'go:' || {FILE} || '::i' || p_partkey, 'function', 'i' || p_partkey from part union all select 'route:/a' || p_partkey, 'route', '/a' || p_partkey from part")
def index_nodes(g):
    return index.build(found(g)).nodes.select("id", "kind", "name")


LINKED = f"""select 'contains' as kind, 'file:' || {FILE} as source, 'go:' || {FILE} || '::F' || p_partkey as target, 'tree-sitter' as provenance, 6 as line from part
union all select 'contains', 'file:' || {FILE}, 'go:' || {FILE} || '::g' || p_partkey, 'tree-sitter', 10 from part
union all select 'contains', 'file:' || {FILE}, 'go:' || {FILE} || '::i' || p_partkey, 'tree-sitter', 16 from part
union all select 'imports', 'file:' || {FILE}, 'import:fmt', 'tree-sitter', 3 from part
union all select 'calls', 'go:' || {FILE} || '::g' || p_partkey, 'go:' || {FILE} || '::F' || p_partkey, 'tree-sitter', 12 from part
union all select 'calls', 'go:' || {FILE} || '::F' || p_partkey, 'go:gen/f' || (p_partkey + 1) || '.go::F' || (p_partkey + 1), 'heuristic', 7 from part where p_partkey + 1 in (select p_partkey from part)
union all select 'route', 'route:/a' || p_partkey, 'go:' || {FILE} || '::g' || p_partkey, 'heuristic', 0 from part"""


@query("I02_index_edges", LINKED)
def index_edges(g):
    return index.build(found(g)).edges.select("kind", "source", "target", "provenance", "line")


@query("I03_update", f"with x as ({LINKED}) select kind, source, target, provenance, line from x")
def update(g):
    """The same tables, from an index of all files of which some are parsed again."""
    stages = Stages(g.spark)
    known = index.build(found(g).withColumn("content_hash", F.lit("old")))
    again = found(g).where("length(path) % 2 = 0")
    out = index.build(stages.write(again, "again"), None, known)
    return out.edges.select("kind", "source", "target", "provenance", "line")


@query("K13_commit", "select 'nodes' as name, count(*) as n from nodes union all select 'edges', count(*) from edges union all select 'files', count(*) from files union all select 'verdicts', count(*) from verdicts")
def commit(g):
    root = Stages(g.spark).path("tables")
    for nodes in (g.nodes.limit(0), g.nodes):  # the second version takes the first one's place
        tables = index.Tables(*(index.conform(df, s) for df, s in ((nodes, index.NODES), (g.edges, index.EDGES), (g.files, index.FILES), (g.verdicts, index.VERDICTS))))
        index.commit(tables, root)
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in index.opened(g.spark, root).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("K14_update_tokens", "with n as (select id, case when end_line % 3 = 0 then 'changed ' || name else name end as name from nodes where end_line % 4 <> 0) select id as node_id, token, count(*) as n from (select id, unnest(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+')) as token from n) where token <> '' group by id, token")
def update_tokens(g):
    index_ = text.tokens(g.nodes.select("id", "name"), ("name",))
    changed = g.nodes.where("end_line % 3 = 0 and end_line % 4 != 0").select("id", F.concat(F.lit("changed "), "name").alias("name"))
    return text.update_tokens(index_, changed, g.nodes.where("end_line % 4 = 0").select("id"), ("name",)).groupBy("node_id", "token").agg(F.count("*").alias("n"))


FACES = "with c as (select target as id, count(*) as fan_in from edges where kind = 'calls' group by target), r as (select file_path, n.id, name, coalesce(fan_in, 0) as fan_in, row_number() over (partition by file_path order by coalesce(fan_in, 0) desc, name, n.id) as place from nodes n left join c on c.id = n.id where kind in ('function', 'method') and is_exported <> 0)"


@query("T04_interfaces", f"{FACES} select file_path as file, place, id, fan_in from r where place <= 15")
def interfaces(g):
    return documents.interfaces(g.nodes, g.edges).select(F.col("of").alias("file"), F.col("at").cast("long").alias("place"), "id", "fan_in")


@query("T04_structures", "select file_path as file, place, name, kind from (select *, row_number() over (partition by file_path order by start_line, id) as place from nodes where kind in ('struct', 'class', 'interface')) where place <= 8")
def structures(g):
    return documents.structures(g.nodes).select(F.col("of").alias("file"), F.col("at").cast("long").alias("place"), "name", "kind")


NEEDS = "with c as (select a.file_path as f, b.file_path as t from edges e join nodes a on a.id = e.source join nodes b on b.id = e.target where e.kind = 'calls' and a.file_path <> b.file_path), o as (select f, count(distinct t) as n from c group by f), i as (select t, count(distinct f) as n from c group by t), s as (select file_path, count(*) as symbols, count(*) filter (where kind in ('function', 'method') and is_exported <> 0) as public, count(*) filter (where kind in ('function', 'method') and is_exported = 0) as internal, count(*) filter (where kind in ('struct', 'interface')) as data, min_by(language, (start_line, id)) as language from nodes group by 1), w as (select s.*, coalesce(o.n, 0) as outs, coalesce(i.n, 0) as ins from s left join o on o.f = s.file_path left join i on i.t = s.file_path)"
FIGURES = (("language", "case language when 'go' then 'Go' else 'Python' end"), ("symbols", "symbols"), ("public functions", "public"), ("inner functions", "internal"), ("structures", "data"), ("files needed", "outs"), ("files that need it", "ins"))


@query("D01_file_overviews", NEEDS + " union all ".join(f" select file_path as of, cast({k} as bigint) as at, '{name}' as name, cast({v} as varchar) as value from w" for k, (name, v) in enumerate(FIGURES, 1)))
def file_overviews(g):
    return documents.file_documents(g.nodes, g.edges).where("section = 'overview'").select("of", "at", "name", "value")


@query("D01_file_documents")
def file_documents(g):
    return documents.file_documents(g.nodes, g.edges)


@query("D02_module_documents")
def module_documents(g):
    return documents.module_documents(g.nodes, g.edges)


@query("D02_module_files", f"with c as (select n.file_path as file, count(*) as callers from edges e join nodes n on n.id = e.target where e.kind = 'calls' group by 1), s as (select file_path as file, {DIR} as of, count(*) as symbols from nodes group by 1, 2) select of, s.file as name, row_number() over (partition by of order by coalesce(callers, 0) desc, s.file) as at from s left join c on c.file = s.file")
def module_files(g):
    return documents.module_documents(g.nodes, g.edges).where("section = 'files'").select("of", "name", "at")


@query("D03_project_document")
def project_document(g):
    return documents.project_document(g.nodes, g.edges)


# --- written and read again ---


@query("S11_verdict_files", "select 'doc:' || doc_id as symbol_id, case when toxic = 1 then 'REJECT' else 'PASS' end as decision, 'r' || quality as rule_id from labels")
def verdict_files(g):
    path = Stages(g.spark).path("verdicts")
    rows = g.table("labels").select(F.concat(F.lit("doc:"), "doc_id").alias("symbol_id"), F.when(F.col("toxic") == 1, "REJECT").otherwise("PASS").alias("decision"), F.concat(F.lit("r"), "quality").alias("rule_id"), "doc_id")
    listed = rows.where("doc_id % 2 = 0").groupBy((F.col("doc_id") % 16).alias("k")).agg(F.to_json(F.collect_list(F.struct("symbol_id", "decision", "rule_id"))).alias("value"))
    mapped = rows.where("doc_id % 2 != 0").groupBy((F.col("doc_id") % 16).alias("k")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("symbol_id", F.struct("decision", "rule_id"))))).alias("value"))
    listed.unionByName(mapped).repartition("k").select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.verdicts(g.spark, path).select("symbol_id", "decision", "rule_id")


@query("S16_stored_documents", "select source as type, 'd' || doc_id as key, lang as content, 't' || doc_id as timestamp from documents")
def stored_documents(g):
    path = Stages(g.spark).path("stored")
    rows = g.table("documents").select(F.col("source").alias("type"), F.concat(F.lit("d"), "doc_id").alias("key"), F.col("lang").alias("content"), F.concat(F.lit("t"), "doc_id").alias("timestamp"))
    rows.write.json(path)
    return files.stored_documents(g.spark, path)


@query("S17_compile_commands", "select '/src' as directory, 'f' || p_partkey || '.c' as file, 'cc -c f' || p_partkey || '.c' as command from part where p_size <> 3 and p_partkey % 10 <> 7")
def compile_commands(g):
    path = Stages(g.spark).path("commands")
    rows = g.table("part").select(F.when(F.col("p_size") != 3, "/src").alias("directory"), F.concat(F.lit("f"), "p_partkey", F.lit(".c")).alias("file"), F.array(F.lit("cc"), F.lit("-c"), F.concat(F.lit("f"), "p_partkey", F.lit(".c"))).alias("arguments"))
    rows.write.json(path)
    files.rewrite_compile_commands(g.spark, path, path + "-kept", PathFilter(exclude=["*7.c"]), lines=True)
    return files.compile_commands(g.spark, path + "-kept", lines=True)


@query("X34_json", "select id, name, start_line from nodes")
def json_round_trip(g):
    own = g.nodes.select("id", "name", "start_line")
    return from_json(as_json(own), own.schema)


@query("W02_block_end", f"select {FILE} as path, 8 as f, 14 as g, 19 as init from part")
def block_end(g):
    end = lambda line: text.block_end("text", F.lit(line))
    return sources(g).select("path", end(6).alias("f"), end(10).alias("g"), end(16).alias("init"))


# --- defaults, streams ---


@query("F23_search_default", f"select id from nodes where (name ilike '%n%' or qualified_name ilike '%n%') and {P0} order by file_path, start_line, id limit 20")
def search_default(g):
    return lookup.search(g.nodes, "n", limit=0).select("id")


@query("F23_impact_default", f"with recursive up(id, d) as (select {MOST_CALLED}, 0 union select e.source, d + 1 from up join edges e on e.target = up.id and e.kind = 'calls' where d < 3) select id, cast(min(d) as bigint) as depth from up group by id having min(d) > 0")
def impact_default(g):
    return graph.impact(g.edges, most_called(g), 0).select("id", "depth")


@query("R05_stream", "with m as (select *, case when ts < lag(ts) over (partition by path order by ts) + interval 6 hour then 0 else 1 end as fresh from changes), s as (select *, sum(fresh) over (partition by path order by ts rows unbounded preceding) as burst from m) select path, cast(floor(epoch(min(ts))) as bigint) as first_ts, count(*) as n from s group by path, burst")
def stream(g):
    """A folder of change logs read as a stream to its end; a last event of another path closes all bursts before."""
    stages = Stages(g.spark)
    log, out = stages.path("log"), stages.path("bursts")
    events = g.changes.select("path", "op", "ts")
    events.unionByName(events.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts")).select(F.lit("the end").alias("path"), F.lit("write").alias("op"), "ts")).write.json(log)
    query_ = changes.stream(changes.source(g.spark, log), lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}"), stages.path("state"), late="1 hour", gap="6 hours")
    query_.awaitTermination()
    return g.spark.read.parquet(out).where("path != 'the end'").select("path", F.unix_timestamp("first_ts").alias("first_ts"), "n")
