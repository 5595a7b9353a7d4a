"""Registered queries: look-ups, filters, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import predicates as p
from lodestone.functions import text
from lodestone.functions.globs import PathFilter
from lodestone.operators import joins, lookup
from lodestone.plans.fixtures import CodeGraph
from lodestone.plans.registry import query

P0 = "not (name ilike '$anonymous_type_%' or qualified_name ilike '%$anonymous_type_%' or id ilike '%$anonymous_type_%')"
#: Constants of a query: the most called node, the node with most calls.
MOST_CALLED = "(select target from edges where kind = 'calls' group by target order by count(*) desc, target limit 1)"
MOST_CALLING = "(select source from edges where kind = 'calls' group by source order by count(*) desc, source limit 1)"
FIRST_FILE = "(select min(file_path) from nodes)"


def most_called(g: CodeGraph) -> DataFrame:
    return g.calls.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


def most_calling(g: CodeGraph) -> DataFrame:
    return g.calls.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


def first_file(g: CodeGraph) -> str:
    return g.nodes.agg(F.min("file_path")).first()[0]


@query("F07_search", f"select id, kind, name, file_path, start_line from nodes where (name ilike '%ANVIL%' or qualified_name ilike '%ANVIL%') and {P0} order by file_path, start_line, id limit 20")
def search(g):
    return lookup.search(g.nodes, "ANVIL").select("id", "kind", "name", "file_path", "start_line")


@query("F07_search_kind", f"select id, kind, name from nodes where (name ilike '%d_g%' or qualified_name ilike '%d_g%') and kind = 'function' and {P0} order by file_path, start_line, id limit 50")
def search_kind(g):
    return lookup.search(g.nodes, "d_g", "function", 50).select("id", "kind", "name")


@query("F08_resolve", f"with t as (select id, case when id = 'main' then 0 when (name = 'main' or qualified_name ilike '%main%') and {P0} then 1 end as tier from nodes) select id from t where tier = (select min(tier) from t) order by id limit 20")
def resolve(g):
    return lookup.resolve(g.nodes, "main")


@query("F09_node_by_symbol", f"select id, kind, file_path from nodes where (id = 'main' or name = 'main' or qualified_name ilike '%main%') and {P0}")
def node_by_symbol(g):
    return lookup.by_symbol(g.nodes, "main").select("id", "kind", "file_path")


@query("F09_node_by_file", f"select id, name, start_line from nodes where file_path = {FIRST_FILE} and {P0} order by start_line, id limit 10")
def node_by_file(g):
    return lookup.by_file(g.nodes, first_file(g)).select("id", "name", "start_line")


@query("F10_locate", "select file_path, start_line, kind from nodes where qualified_name ilike '%anvil%' or name = 'anvil'")
def locate(g):
    return lookup.locate(g.nodes, "anvil")


@query("F11_point", "select id, name, kind from nodes where id = 'part:7'")
def point(g):
    return g.nodes.where("id = 'part:7'").select("id", "name", "kind")


@query("F12_callers", f"select id, source, line from edges where kind = 'calls' and target = {MOST_CALLED}")
def callers(g):
    return lookup.callers(g.edges, most_called(g)).select("id", "source", "line")


@query("F13_callees", f"select id, target, line from edges where kind = 'calls' and source = {MOST_CALLING}")
def callees(g):
    return lookup.callees(g.edges, most_calling(g)).select("id", "target", "line")


@query("F14_callers_of_all", "select e.id, e.source, e.target from edges e join nodes n on n.id = e.target where n.name = 'main' and e.kind = 'calls'")
def callers_of_all(g):
    return lookup.callers(g.edges, g.nodes.where("name = 'main'").select("id")).select("id", "source", "target")


@query("F14_callees_of_all", "select e.id, e.source, e.target from edges e join nodes n on n.id = e.source where n.name = 'main' and e.kind = 'calls'")
def callees_of_all(g):
    return lookup.callees(g.edges, g.nodes.where("name = 'main'").select("id")).select("id", "source", "target")


@query("F15_files", "select path, language, size from files where path ilike 'src1%' and path ilike '%en/%1.txt' order by path limit 100")
def files(g):
    return lookup.file_list(g.files, "src1", "en/*1.txt").select("path", "language", "size")


@query("F16_verdicts", "select symbol_id, decision, has_active_defect from verdicts where symbol_id = (select min(symbol_id) from verdicts where decision = 'REJECT')")
def verdicts(g):
    first = g.verdicts.where("decision = 'REJECT'").agg(F.min("symbol_id").alias("symbol_id"))
    return g.verdicts.join(F.broadcast(first), "symbol_id", "left_semi").select("symbol_id", "decision", "has_active_defect")


MODULE = "case when contains(trim(file_path, '/'), '/') then split_part(trim(file_path, '/'), '/', 1) else '(root)' end"


@query("F17_functions", f"select id, name, kind, file_path as file, start_line as line, {MODULE} as module from nodes where kind in ('function','method') and {P0}")
def functions(g):
    return lookup.functions(g.nodes)


VISIBLE = "kind in ('function','method','class','struct','interface','route','external')"
CANONICAL = f"""own as (select * from nodes where {VISIBLE} and {P0}),
deg as (select id, count(*) as degree from (select source as id from links where kind = 'calls' union all select target from links where kind = 'calls') group by id),
links as (select * from edges where kind in ('contains','calls','imports','implements')),
named as (select o.id, first_value(o.id) over (partition by kind, file_path, name order by coalesce(degree, 0) desc, start_line, o.id) as canonical from own o left join deg d on d.id = o.id where kind in ('function','method')),
kept as (select o.* from own o left join named n on n.id = o.id where n.id is null or n.id = n.canonical),
moved as (select e.id, coalesce(a.canonical, e.source) as source, coalesce(b.canonical, e.target) as target, e.kind, e.source = e.target as loop from links e left join named a on a.id = e.source left join named b on b.id = e.target),
once as (select * from (select *, row_number() over (partition by source, target, kind order by id) as rn from moved where source <> target or loop) where rn = 1),
seen as (select id, source, target, kind from once where source in (select id from kept) and target in (select id from kept))"""
CANONICAL = CANONICAL.replace("own as (", "links as (select * from edges where kind in ('contains','calls','imports','implements')),\nown as (", 1).replace("links as (select * from edges where kind in ('contains','calls','imports','implements')),\nnamed", "named")


@query("F18_graph_nodes", f"with {CANONICAL} select id, kind, name from kept")
def graph_nodes(g):
    return lookup.graph_data(g.nodes, g.edges)[0].select("id", "kind", "name")


@query("F18_graph_edges", f"with {CANONICAL} select id, source, target, kind from seen")
def graph_edges(g):
    return lookup.graph_data(g.nodes, g.edges)[1].select("id", "source", "target", "kind")


@query("J06_aliases", f"with {CANONICAL} select id, canonical from named where id <> canonical")
def aliases(g):
    own = g.nodes.where(F.col("kind").isin(*lookup.VISIBLE_KINDS) & p.non_synthetic())
    return lookup.aliases(own, g.edges.where(F.col("kind").isin(*lookup.LINK_KINDS))).where("id != canonical")


FIRST_MODULE = f"(select min({MODULE}) from nodes)"
OWN_MODULE = f"own as (select * from nodes where file_path ilike {FIRST_MODULE} || '/%' and {VISIBLE} and {P0})"


@query("F19_module_nodes", f"with {OWN_MODULE} select id, name from own")
def module_nodes(g):
    return lookup.module_nodes(g.nodes, g.nodes.agg(F.min(p.module_of("file_path"))).first()[0]).select("id", "name")


@query("F19_module_edges", f"with {OWN_MODULE} select id, source, target, kind from edges where kind in ('contains','calls','imports','implements') and source in (select id from own) and target in (select id from own)")
def module_edges(g):
    return lookup.module_graph(g.nodes, g.edges, g.nodes.agg(F.min(p.module_of("file_path"))).first()[0])[1].select("id", "source", "target", "kind")


TOKENS = "lower(strip_accents(name))"


#: A name of several words, as those of a code base have it.
WORDY = "(select min(name) from nodes where name like '%!_%' escape '!')"


@query("F21_phrase", f"select id as node_id from nodes where contains(' ' || regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ', ' ' || replace({WORDY}, '_', ' ') || ' ') or contains(' ' || regexp_replace(lower(qualified_name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ', ' ' || replace({WORDY}, '_', ' ') || ' ')")
def phrase(g):
    term = g.nodes.where("name like '%!_%' escape '!'").agg(F.min("name")).first()[0]
    return text.match(text.tokens(g.nodes, ("name", "qualified_name")), [term.upper() if term else "none"])


@query("F21_match", "with t as (select id as node_id, unnest(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+')) as token from nodes union all select id, unnest(regexp_split_to_array(lower(qualified_name), '[^\\p{L}\\p{N}]+')) from nodes union all select id, unnest(regexp_split_to_array(lower(id), '[^\\p{L}\\p{N}]+')) from nodes) select distinct node_id from t where token in ('main', '17')")
def match(g):
    return text.match(text.tokens(g.nodes), ["main", "17"])


@query("F20_explore", """with t as (select id as node_id, unnest(regexp_split_to_array(lower(name || ' ' || qualified_name || ' ' || id), '[^\\p{L}\\p{N}]+')) as token from nodes),
chosen as (select * from nodes where id in (select node_id from t where token in ('main', '17')) order by file_path, start_line, id limit 10),
rel as (select file_path, string_agg(distinct source || ' → ' || target, ', ' order by source || ' → ' || target) as callers from edges e join chosen c on c.id = e.target where e.kind = 'calls' group by file_path),
f as (select file_path, string_agg(id, ', ' order by id) as symbols from chosen group by file_path)
select f.file_path as file, symbols, coalesce(callers, '') as callers from f left join rel on rel.file_path = f.file_path""")
def explore(g):
    return text.explore(g.nodes, g.edges, "main 17")


@query("Z23_ranked_match", "with t as (select doc_id, unnest(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+')) as token from documents), tf as (select doc_id, token, count(*) as tf from t where token in ('idiot', 'token') group by 1, 2), df as (select token, count(*) as df from tf group by 1) select cast(doc_id as varchar) as node_id, round(sum(tf * ln((select count(*) from documents)::double / df)), 6) as score from tf join df using (token) group by doc_id")
def ranked_match(g):
    docs = g.table("documents")
    index = text.tokens(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("docstring")), ("docstring",))
    return text.ranked_match(index, ["idiot", "token"], docs.count())


@query("F22_edge_order", "select id, source, target from edges order by provenance = 'scip' desc, line, id limit 25")
def edge_order(g):
    return g.edges.orderBy(F.desc(F.col("provenance") == "scip"), "line", "id").limit(25).select("id", "source", "target")


@query("F24_function_tree", f"with f as (select id, name, file_path as file, start_line as line, {MODULE} as module from nodes where kind in ('function','method') and {P0} and (contains(lower(name), 'st') or contains(lower(file_path), 'st'))), k as (select * from f order by file, line, id limit 500) select module, file, count(*) as functions from k group by module, file")
def function_tree(g):
    return lookup.function_tree(g.nodes, "st")


@query("F25_visible_links", f"with {OWN_MODULE} select id from edges where source in (select id from own) and target in (select id from own)")
def visible_links(g):
    own = lookup.module_nodes(g.nodes, g.nodes.agg(F.min(p.module_of("file_path"))).first()[0])
    return lookup.between(g.edges, own).select("id")


DIR = "case when contains(file_path, '/') then regexp_extract(file_path, '^(.*)/[^/]*$', 1) else '.' end"


@query("F26_directories", f"select distinct {DIR} as option from nodes where kind = 'function'")
def directories(g):
    return lookup.drill_down(g.nodes)


@query("F26_files", f"select distinct file_path as option from nodes where kind = 'function' and {DIR} = (select min({DIR}) from nodes) and contains(lower(file_path), '1')")
def files_of(g):
    return lookup.drill_down(g.nodes, directory=g.nodes.agg(F.min(p.dir_of("file_path"))).first()[0], text="1")


@query("F26_functions", f"select distinct name as option from nodes where kind = 'function' and file_path = {FIRST_FILE}")
def functions_of(g):
    return lookup.drill_down(g.nodes, file=first_file(g))


RULE = PathFilter(include=["src*/**"], exclude=["src1/**", "**/*9.txt"], scip_exclude=["src2/"], tree_sitter_exclude=["*/fr/*"])


@query("F01_path_filter", "select path from files where regexp_full_match(path, 'src[^/]*(/.*)?') and not regexp_full_match(path, 'src1(/.*)?') and not regexp_full_match(path, '(.*/)?[^/]*9\\.txt') and not regexp_full_match(path, 'src2(/.*)?')")
def path_filter(g):
    return g.files.where(RULE.allows(F.col("path"), "scip")).select("path")


@query("F02_directory_filter", f"select distinct {DIR.replace('file_path', 'path')} as dir from files where not regexp_full_match({DIR.replace('file_path', 'path')}, 'src1(/.*)?')")
def directory_filter(g):
    return g.files.select(p.dir_of("path").alias("dir")).distinct().where(RULE.allows_dir(F.col("dir")))


@query("F03_globs", "select path, regexp_full_match(path, 'src[0-3](/.*)?') as in_few, regexp_full_match(path, '[^/]*/fr/[^/]*') as french, regexp_full_match(path, '(.*/)?[^/]*7\\.txt(/.*)?') as seven from files")
def globs(g):
    m = lambda *ps: PathFilter.matches(F.col("path"), ps)
    return g.files.select("path", m("src[0-3]/**").alias("in_few"), m("*/fr/*").alias("french"), m("*7.txt").alias("seven"))


@query("F04_normalize", "select path, path as clean from files")
def normalize(g):
    return g.files.select("path", p.clean_path(F.concat(F.lit(" ./zz/..//"), F.regexp_replace("path", "/", "/y/.//..//./"))).alias("clean"))


@query("F06_filter_report", "select distinct 'exclude' as rule, 'src1/' as path from files where path like 'src1/%' union all select distinct 'scipExclude', 'src2/' from files where path like 'src2/%' union all select distinct 'treeSitterExclude', regexp_extract(path, '^([^/]*/fr/)', 1) from files where path like '%/fr/%'")
def filter_report(g):
    return PathFilter(exclude=["src1/**"], scip_exclude=["src2/"], tree_sitter_exclude=["*/fr/*"]).report(g.files)


# --- sorts, limits, sets ---


@query("T01_node_order", "select id from nodes order by file_path, start_line, name, id limit 30")
def node_order(g):
    return g.nodes.orderBy("file_path", "start_line", "name", "id").limit(30).select("id")


@query("T02_link_order", "select source, target, line, id from edges order by source, target, line, id limit 30")
def link_order(g):
    return g.edges.orderBy("source", "target", "line", "id").limit(30).select("source", "target", "line", "id")


@query("T05_fan_in_order", "select n.id, count(*) as fan_in from nodes n join edges e on e.target = n.id and e.kind = 'calls' where n.is_exported <> 0 group by n.id order by fan_in desc, n.id limit 15")
def fan_in_order(g):
    own = g.nodes.where("is_exported != 0").select(F.col("id").alias("target"))
    return g.calls.join(own, "target").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("fan_in")).orderBy(F.desc("fan_in"), "id").limit(15)


@query("T07_path_order", "select path from files order by path limit 100")
def path_order(g):
    return g.files.select("path").orderBy("path").limit(100)


@query("U01_union_all", "select source as id from edges where kind = 'calls' union all select target from edges where kind = 'calls'")
def union_all(g):
    return g.calls.select(F.col("source").alias("id")).unionByName(g.calls.select(F.col("target").alias("id")))


@query("U02_union", "select source as id from edges union select target from edges")
def union(g):
    return g.edges.select(F.col("source").alias("id")).union(g.edges.select("target")).distinct()


@query("U03_distinct", "select distinct source, target from edges where kind = 'calls'")
def distinct(g):
    return g.calls.select("source", "target").dropDuplicates()


@query("U04_except", "select id from nodes where kind in ('function','method') except select target from edges where kind = 'calls'")
def except_(g):
    return g.nodes.where("kind in ('function','method')").select("id").join(g.calls.select(F.col("target").alias("id")), "id", "left_anti").distinct()


@query("U05_intersect", "select source as id from edges where kind = 'calls' intersect select target from edges where kind = 'calls'")
def intersect(g):
    return g.calls.select(F.col("source").alias("id")).intersect(g.calls.select("target"))


@query("U06_full_outer", f"with i as (select {DIR} as dir, count(*) as ins from edges e join nodes n on n.id = e.target group by 1), o as (select {DIR} as dir, count(*) as outs from edges e join nodes n on n.id = e.source group by 1) select coalesce(i.dir, o.dir) as dir, coalesce(ins, 0) as ins, coalesce(outs, 0) as outs from i full join o on i.dir = o.dir")
def full_outer(g):
    dirs = g.nodes.select("id", p.dir_of("file_path").alias("dir"))
    side = lambda end, name: g.edges.join(dirs, g.edges[end] == dirs["id"]).groupBy("dir").agg(F.count("*").alias(name))
    return side("target", "ins").join(side("source", "outs"), "dir", "full").select("dir", F.coalesce("ins", F.lit(0)).alias("ins"), F.coalesce("outs", F.lit(0)).alias("outs"))


# --- scalar functions ---


@query("X04_module", f"select id, {MODULE} as module from nodes")
def module(g):
    return g.nodes.select("id", p.module_of("file_path").alias("module"))


@query("X05_path_parts", f"select distinct {DIR} as dir, regexp_extract(file_path, '([^/]*)$', 1) as base, lower(regexp_extract(file_path, '(\\.[^./]*)$', 1)) as ext from nodes")
def path_parts(g):
    return g.nodes.select(p.dir_of("file_path").alias("dir"), p.base_of("file_path").alias("base"), p.extension_of("file_path").alias("ext")).distinct()


@query("X06_hash", "select doc_id, sha256(text) as content_hash from documents")
def content_hash(g):
    return g.table("documents").select("doc_id", p.content_hash("text").alias("content_hash"))


@query("X07_symbol_id", "select id, 'go:' || file_path || '::' || qualified_name as made from nodes")
def symbol_id(g):
    return g.nodes.select("id", p.symbol_id(F.lit("go"), "file_path", "qualified_name").alias("made"))


@query("X08_symbol_parts", "select id, translate(regexp_replace(qualified_name || '#run().', '\\.$', ''), '/#:', '...') as qualified, 'run' as name, 'function' as kind from (select id, replace(qualified_name, ' ', '_') as qualified_name from nodes)")
def symbol_parts(g):
    s = F.concat(F.lit("scip-go gomod x "), F.regexp_replace("qualified_name", " ", "_"), F.lit("#run()."))
    named = g.nodes.select("id", s.alias("s"))
    return named.select("id", p.qualified_of_symbol("s").alias("qualified"), F.substring_index(p.symbol_name("s"), "#", -1).alias("name"), p.symbol_kind("s").alias("kind"))


@query("X10_exported", "select id, cast(language = 'go' and regexp_matches(upper(name[1]) || name[2:], '^\\p{Lu}') as bigint) as exported from nodes")
def exported(g):
    return g.nodes.select("id", p.exported("language", F.concat(F.upper(F.substring("name", 1, 1)), F.substring("name", 2, 1000))).alias("exported"))


@query("X12_calls", "select doc_id, array_to_string(regexp_extract_all(replace(text, '.', '('), '([a-zA-Z_][a-zA-Z0-9_]*)\\s*\\(', 1), ' ') as calls from documents")
def calls(g):
    return g.table("documents").select("doc_id", F.array_join(F.regexp_extract_all(F.replace("text", F.lit("."), F.lit("(")), F.lit(joins.CALL), 1), " ").alias("calls"))


@query("X13_keywords", f"select id, name in ({', '.join(repr(k) for k in joins.KEYWORDS)}) as keyword from (select id, case when end_line % 3 = 0 then 'sizeof' when end_line % 3 = 1 then 'this' else name end as name from nodes)")
def keywords(g):
    name = F.when(F.col("end_line") % 3 == 0, "sizeof").when(F.col("end_line") % 3 == 1, "this").otherwise(F.col("name"))
    return g.nodes.select("id", name.isin(*joins.KEYWORDS).alias("keyword"))


@query("X09_index_kinds", "select id, case p_size % 9 when 0 then 'interface' when 1 then 'struct' when 2 then 'struct' when 3 then 'function' when 4 then 'variable' when 5 then 'method' when 6 then 'macro' when 7 then 'variable' else 'function' end as kind from part join nodes on id = 'part:' || p_partkey")
def index_kinds(g):
    kinds = g.sql("select concat('part:', p_partkey) as id, elt(p_size % 9 + 1, 'Interface', 'Class', 'Struct', 'Constructor', 'Field', 'Method', 'Macro', 'Namespace', 'UnspecifiedKind') as kind, 'scip-go x a/run().' as symbol from part")
    return kinds.select("id", p.index_kind("kind", "symbol").alias("kind"))


@query("X11_visibility", "select id, case when end_line % 3 = 0 then 'private' when end_line % 3 = 1 then 'protected' else 'public' end as visibility from nodes")
def visibility(g):
    signature = F.when(F.col("end_line") % 3 == 0, F.concat(F.lit("Private int "), "name")).when(F.col("end_line") % 3 == 1, F.concat(F.lit("protected "), "name")).otherwise(F.lit(None).cast("string"))
    return g.nodes.select("id", p.visibility(signature).alias("visibility"))


@query("X28_language_names", "select distinct language, case language when 'go' then 'Go' when 'python' then 'Python' end as shown, case language when 'go' then 'go' when 'python' then 'py' end as prefix from nodes")
def language_names(g):
    return g.nodes.select("language", p.language_name("language").alias("shown"), p.id_prefix("language").alias("prefix")).distinct()


@query("X26_import_text", "select source, replace(target, 'import:', '') as needs from page_imports")
def import_text(g):
    return g.page_imports.select("source", p.import_text(F.concat(F.lit(' #include "'), F.regexp_replace("target", "^import:", ""), F.lit('" '))).alias("needs"))


@query("X29_safe_path", "select path, regexp_replace(path, '[^A-Za-z0-9._-]', '_', 'g') as safe from files")
def safe_path(g):
    return g.files.select("path", p.safe_path_part("path").alias("safe"))


#: The wrapped sum with a sign, without the sign behind the remainder.
HASH = "list_reduce(list_prepend(0::hugeint, list_transform(string_split(file_path || '/' || qualified_name, ''), lambda c: ord(c)::hugeint)), lambda h, c: (h * 31 + c) % 18446744073709551616::hugeint)"


@query("X30_short_hash", f"with h as (select id, file_path || '/' || qualified_name as s, {HASH} as h from nodes) select id, substr(regexp_replace(regexp_extract(s, '([^/]*)$', 1), '[^A-Za-z0-9]', '_', 'g'), 1, 20) || '_' || cast(case when h < 9223372036854775808::hugeint then h % 1000 else (18446744073709551616::hugeint - h) % 1000 end as varchar) as diagram_id from h")
def short_hash(g):
    return g.nodes.select("id", p.diagram_id(F.concat("file_path", F.lit("/"), "qualified_name")).alias("diagram_id"))


@query("X32_epoch_day", "select event_id, cast(floor(epoch(ts) / 86400) as bigint) as day from events")
def epoch_day(g):
    return g.table("events").select("event_id", F.floor(F.unix_timestamp("ts") / 86400).alias("day"))


@query("X33_time_text", "select event_id, strftime(ts, '%Y%m%dT%H%M%S') as stamp from events")
def time_text(g):
    return g.table("events").select("event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss").alias("stamp"))
