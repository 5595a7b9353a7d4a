"""Registered queries: sources, mutations and incremental sync."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import predicates as p
from lodestone.functions.globs import PathFilter
from lodestone.operators import joins, mutations
from lodestone.plans.registry import query
from lodestone.session import Stages
from lodestone.sources import parse, scip
from lodestone.streaming import changes

EXTS = "(values ('go','.go'),('typescript','.ts'),('typescript','.tsx'),('typescript','.js'),('typescript','.jsx'),('typescript','.mjs'),('typescript','.cjs'),('python','.py'),('java','.java'),('c','.c'),('cpp','.cc'),('cpp','.cpp'),('cpp','.cxx'),('cpp','.hpp'),('cpp','.hxx')) as x(lang, ext)"
#: Paths with all kinds of extensions, and directories to skip.
PATHS = "paths as (select (case when p_partkey % 11 = 0 then 'node_modules/' when p_partkey % 13 = 0 then '.trash1/' else 'src/' end) || 'f' || p_partkey || (case p_partkey % 9 when 0 then '.go' when 1 then '.py' when 2 then '.tsx' when 3 then '.h' when 4 then '.cpp' when 5 then '.java' when 6 then '.mjs' when 7 then '' else '.txt' end) as path from part)"


def paths(g):
    return g.sql(f"with {PATHS} select path from paths")


@query("S02_extensions", f"with {PATHS} select path from paths where regexp_extract(path, '(\\.[^./]*)$', 1) in ('.go','.py','.ts','.tsx','.js','.jsx','.c','.cpp','.cc','.cxx','.h','.hpp','.hxx','.java')")
def extensions(g):
    return paths(g).where(p.extension_of("path").isin(*p.INDEX_EXTENSIONS))


@query("S03_skip_list", f"with {PATHS} select path from paths where not (path like 'node_modules/%' or path like '.trash%')")
def skip_list(g):
    return paths(g).where(~p.skipped_directory("path"))


LANG = f"with {PATHS}, e as (select path, regexp_extract(path, '(\\.[^./]*)$', 1) as ext from paths)"


@query("S06_language", f"{LANG} select path, case when e.ext = '.h' then 'cpp' else coalesce(lang, 'unknown') end as language from e left join {EXTS} on x.ext = e.ext")
def language(g):
    own = paths(g)
    cpp = own.agg(F.max(p.extension_of("path").isin(".cpp", ".cc")).alias("cpp"))
    return own.crossJoin(F.broadcast(cpp)).select("path", p.language_of("path", F.col("cpp")).alias("language"))


@query("S07_imported_language", f"{LANG} select path, case when e.ext = '.h' then 'c' when e.ext in ('.mjs', '.cjs') then 'cxx' else coalesce(lang, 'cxx') end as language from e left join {EXTS} on x.ext = e.ext")
def imported_language(g):
    return paths(g).select("path", p.imported_language("path").alias("language"))


@query("S12_authors", "select author, path from commits")
def authors(g):
    return g.commits.select("author", "path")


@query("S14_changed_files", "select distinct path from commits where ts >= (select max(ts) - interval 30 day from commits)")
def changed_files(g):
    last = g.commits.agg((F.max("ts") - F.expr("interval 30 days")).alias("since"))
    return g.commits.join(F.broadcast(last), g.commits["ts"] >= F.col("since")).select("path").distinct()


#: A file of code for each part: F<k> calls the next part's function, G<k> calls F<k> and itself, and i<k> makes that a route's handler.
MADE = """select concat('gen/f', p_partkey, '.go') as path, 'go' as language, concat('package gen\n\nimport "fmt"\n\n// F', p_partkey, ' starts it.\nfunc F', p_partkey, '(x int) int {\n\treturn F', p_partkey + 1, '(x) // F', p_partkey, '(2)\n}\n\nfunc g', p_partkey, '() {\n\tfmt.Println("F7(")\n\tF', p_partkey, '(1)\n\tg', p_partkey, '()\n}\n\nfunc i', p_partkey, '() {\n\tr.GET("/a', p_partkey, '", g', p_partkey, ')\n\tr.POST("/b", other)\n}\n') as text from part"""
FILE = "'gen/f' || p_partkey || '.go'"


def sources(g):
    return g.sql(MADE)


@query("S05_parse", f"""select 'node' as row, {FILE} as path, 'go:' || {FILE} || '::F' || p_partkey as id, 'function' as kind, 'F' || p_partkey as name, 6 as start_line, 8 as end_line, null as source, null as target, null as line from part
union all select 'node', {FILE}, 'go:' || {FILE} || '::g' || p_partkey, 'function', 'g' || p_partkey, 10, 14, null, null, null from part
union all select 'node', {FILE}, 'go:' || {FILE} || '::i' || p_partkey, 'function', 'i' || p_partkey, 16, 19, null, null, null from part
union all select 'contains', {FILE}, null, null, null, null, null, 'file:' || {FILE}, 'go:' || {FILE} || '::' || n, l from part, (values ('F', 6), ('g', 10)) as x(n0, l), (select 1) y, lateral (select n0 || p_partkey as n) z
union all select 'contains', {FILE}, null, null, null, null, null, 'file:' || {FILE}, 'go:' || {FILE} || '::i' || p_partkey, 16 from part
union all select 'imports', {FILE}, null, null, null, null, null, 'file:' || {FILE}, 'import:fmt', 3 from part
union all select 'calls', {FILE}, null, null, null, null, null, 'go:' || {FILE} || '::g' || p_partkey, 'go:' || {FILE} || '::F' || p_partkey, 12 from part
union all select 'file', {FILE}, null, null, null, null, null, null, null, null from part""")
def parsed(g):
    return parse.parse_files(sources(g)).select("row", "path", "id", "kind", "name", "start_line", "end_line", "source", "target", "line")


@query("J16_cross_file_calls", f"""select 'go:' || {FILE} || '::F' || p_partkey as source, 'go:gen/f' || (p_partkey + 1) || '.go::F' || (p_partkey + 1) as target, 7 as line from part where p_partkey + 1 in (select p_partkey from part)
union all select 'go:' || {FILE} || '::g' || p_partkey, 'go:' || {FILE} || '::F' || p_partkey, 12 from part""")
def cross_file_calls(g):
    return joins.cross_file_calls(sources(g), Stages(g.spark).write(parse.nodes_of(parse.parse_files(sources(g))), "nodes"))


@query("J15_routes", f"select 'route:/a' || p_partkey as route, 'go:' || {FILE} || '::g' || p_partkey as handler from part")
def routes(g):
    return joins.routes(sources(g), parse.nodes_of(parse.parse_files(sources(g))))


@query("S04_scip_nodes", "select 'scip-go x ' || o_orderkey || '/f().' as id, 'f' as name, 'function' as kind, cast(o_orderkey % 50 + 1 as bigint) as start_line from orders")
def scip_nodes(g):
    occ = g.sql("select concat('d', o_custkey, '/x.go') as relative_path, concat('scip-go x ', o_orderkey, '/f().') as symbol, 1 as symbol_roles, array(cast(o_orderkey % 50 as int), 0, 3) as range, 'go' as language from orders")
    symbols = g.spark.createDataFrame([], scip.SYMBOLS)
    return scip.definitions(occ, symbols).select("id", "name", "kind", "start_line")


# --- mutations ---


@query("K01_upsert_nodes", "select n.id, case when p_partkey % 5 = 0 then 'new' else name end as name, start_line, is_exported from nodes n join part on n.id = 'part:' || p_partkey union all select 'part:x' || p_partkey, 'new', 1, null from part where p_partkey % 7 = 0")
def upsert_nodes(g):
    new = g.sql("select concat('part:', p_partkey) as id, 'new' as name from part where p_partkey % 5 = 0 union all select concat('part:x', p_partkey), 'new' from part where p_partkey % 7 = 0")
    lines = g.nodes.select("id", "name", "start_line", "is_exported")
    added = new.join(lines.select("id", "start_line"), "id", "left").select("id", "name", F.coalesce("start_line", F.lit(1)).cast("long").alias("start_line"))
    return mutations.upsert(lines, added, "id", ["name", "start_line"])


REPEATED = "select id, source, target, kind, line, provenance from edges union all select id + 1000000, source, target, kind, line, 'heuristic' from edges where id % 3 = 0 union all select id + 2000000, source, target, kind, cast(null as bigint), 'scip' from edges where id % 5 = 0"


def repeated(g):
    return g.sql(REPEATED)


@query("K02_keep_first", "select id, min(start_line) as start_line from (select id, start_line from nodes union all select id, start_line + 1 from nodes) group by id")
def keep_first(g):
    own = g.nodes.select("id", "start_line", "end_line")
    return mutations.keep_first(own.unionByName(own.withColumn("start_line", F.col("start_line") + 1))).select("id", "start_line")


@query("K03_insert_or_ignore", f"with r as ({REPEATED}) select id from (select *, row_number() over (partition by source, target, kind, line order by case provenance when 'scip' then 0 when 'tree-sitter' then 1 else 2 end, id) as n from r) where n = 1 or line is null")
def insert_or_ignore(g):
    return mutations.insert_or_ignore(repeated(g)).select("id")


@query("K04_upsert_files", "select path, case when doc_id % 5 = 0 then 'changed' else content_hash end as content_hash from files")
def upsert_files(g):
    old = g.files.where("doc_id % 3 != 0").select("path", "content_hash")
    new = g.files.select("path", F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("content_hash")).alias("content_hash"))
    return mutations.upsert(old, new, "path", ["content_hash"])


@query("K05_reload_source", "select id, provenance from edges where provenance <> 'scip' union all select id, 'scip' from edges where id % 2 = 0")
def reload_source(g):
    own = g.edges.select("id", "provenance")
    return mutations.reload_source(own, own.where("id % 2 = 0").withColumn("provenance", F.lit("scip")), "scip")


@query("K06_delete_file_nodes", "select id from nodes where file_path <> (select min(file_path) from nodes)")
def delete_file_nodes(g):
    gone = g.nodes.agg(F.min("file_path").alias("path"))
    return mutations.delete_files(g.nodes, g.edges, g.files, gone, keep_imported=True)[0].select("id")


@query("K07_delete_file_edges", "select id from edges where source not in (select id from nodes where file_path = (select min(file_path) from nodes))")
def delete_file_edges(g):
    return mutations.delete_files(g.nodes, g.edges, g.files, g.nodes.agg(F.min("file_path").alias("path")))[1].select("id")


@query("K08_prune", "with gone as (select id from nodes where file_path like 'economy/%') select id from edges where source not in (select id from gone) and target not in (select id from gone)")
def prune(g):
    files = g.nodes.select(F.col("file_path").alias("path")).distinct()
    return mutations.prune(g.nodes, g.edges, files, PathFilter(exclude=["economy/**"]))[1].select("id")


@query("K09_verdicts", "select symbol_id, has_active_defect, 'final_verdict' as stage from verdicts")
def verdicts(g):
    return mutations.load_verdicts(g.verdicts.select("symbol_id", "decision")).select("symbol_id", "has_active_defect", "stage")


@query("K10_external_nodes", "select distinct 'external:' || target as id, 'external' as kind, target as name from edges")
def external_nodes(g):
    return mutations.external_nodes(g.nodes, g.edges.withColumn("target", F.concat(F.lit("external:"), "target")))


@query("K11_purge", f"with r as ({REPEATED}) select id from (select *, row_number() over (partition by source, target, kind, coalesce(line, 0) order by id) as n from r) where n = 1")
def purge(g):
    return mutations.purge_duplicates(repeated(g)).select("id")


@query("K12_fill_metadata", "select id, case provenance when 'scip' then '' when 'tree-sitter' then '' else kind end as metadata from edges")
def fill_metadata(g):
    known = F.when(F.col("provenance") == "scip", "").when(F.col("provenance") == "heuristic", F.col("kind"))
    return mutations.fill_metadata(g.edges.withColumn("metadata", known)).select("id", "metadata")


@query("K16_json", "select count(*) as n from nodes")
def json(g):
    from lodestone.plans.sqlapi import as_json

    return as_json(g.nodes).where("get_json_object(json, '$.id') is not null").agg(F.count("*").alias("n"))


# --- incremental ---


@query("R02_debounce", "with m as (select *, case when ts < lag(ts) over (partition by path order by ts) + interval 6 hour then 0 else 1 end as fresh from changes), s as (select *, sum(fresh) over (partition by path order by ts rows unbounded preceding) as burst from m) select path, cast(floor(epoch(min(ts))) as bigint) as first_ts, count(*) as n from s group by path, burst")
def debounce(g):
    return changes.debounce(g.changes, "6 hours").select("path", F.unix_timestamp("first_ts").alias("first_ts"), "n")


@query("R03_sync", "select path, case when doc_id % 3 = 0 then 'add' else 'change' end as action from files where doc_id % 3 = 0 or doc_id % 5 = 0")
def sync(g):
    old = g.files.where("doc_id % 3 != 0").select("path", "content_hash")
    new = g.files.select("path", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("content_hash", F.lit("x")), 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    return mutations.sync(old, new)


@query("R04_rescan", "select path, content_hash from files where doc_id % 4 <> 0")
def rescan(g):
    old = g.files.where("doc_id % 3 != 0").select("path", F.lit("old").alias("content_hash"))
    content = g.files.where("doc_id % 4 != 0").select("path", "content_hash")
    return changes.apply(old, g.files.select("path"), content)


@query("R06_watched", f"with {PATHS} select path from paths where regexp_extract(path, '(\\.[^./]*)$', 1) in ('.go','.py','.tsx','.cpp','.h','.java') and not path like 'node_modules/%'")
def watched(g):
    return changes.watched(paths(g))


@query("R07_windows", "select cast(floor(epoch(time_bucket(interval 1 day, ts))) as bigint) as start, op, count(*) as n from changes group by 1, 2")
def windows(g):
    return changes.windowed(g.changes, "1 day").select(F.unix_timestamp("start").alias("start"), "op", "n")
