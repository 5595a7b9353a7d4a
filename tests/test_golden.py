"""A hand-computed small graph."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import predicates
from lodestone.functions.schemas import violations
from lodestone.operators import graph, joins, lookup, metrics, mutations

N = {
    "n1": ("go:cmd/main.go::main", "function", "main", "main", "cmd/main.go", 1, 10, 0),
    "n2": ("go:svc/a.go::Run", "function", "Run", "Run", "svc/a.go", 1, 8, 1),
    "n3": ("go:svc/a.go::helper", "function", "helper", "helper", "svc/a.go", 10, 14, 0),
    "n4": ("go:db/store.go::Store.Get", "method", "Get", "Store.Get", "db/store.go", 5, 9, 1),
    "n5": ("go:db/store.go::Store", "struct", "Store", "Store", "db/store.go", 1, 4, 1),
    "n6": ("go:svc/i.go::Getter", "interface", "Getter", "Getter", "svc/i.go", 1, 3, 1),
    "n7": ("go:svc/i.go::Getter.Get", "method", "Get", "Getter.Get", "svc/i.go", 2, 2, 1),
    "n8": ("go:svc/a.go::Orphan", "function", "Orphan", "Orphan", "svc/a.go", 16, 18, 1),
    "n9": ("scip-go x svc/helper().", "function", "helper", "helper()", "svc/a.go", 10, 14, 0),
    "n10": ("go:svc/a.go::$anonymous_type_1", "struct", "$anonymous_type_1", "$anonymous_type_1", "svc/a.go", 20, 21, 0),
}
ALIAS = {v[0]: k for k, v in N.items()}
E = [
    (1, "n1", "n2", "calls", "scip", 3), (2, "n2", "n3", "calls", "tree-sitter", 4), (3, "n2", "n4", "calls", "scip", 5), (4, "n4", "n2", "calls", "heuristic", 7),
    (5, "n2", "n3", "calls", "scip", 6), (6, "n5", "n4", "contains", "tree-sitter", 0), (7, "n6", "n7", "contains", "tree-sitter", 0),
    (8, "file:svc/a.go", "file:db/store.go", "imports", "tree-sitter", 0), (9, "file:db/store.go", "file:svc/a.go", "imports", "tree-sitter", 0), (10, "n1", "n9", "calls", "heuristic", 4),
    (11, "n3", "n3", "calls", "tree-sitter", 12), (12, "n1", "external:fmt.Println", "calls", "scip", 5), (13, "n1", "n2", "calls", "heuristic", 3),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(*v[:5], "go", *v[5:]) for v in N.values()], "id string, kind string, name string, qualified_name string, file_path string, language string, start_line long, end_line long, is_exported long").cache()


@pytest.fixture(scope="module")
def edges(spark):
    real = lambda x: N[x][0] if x in N else x
    raw = spark.createDataFrame([(i, real(s), real(t), k, p, line) for i, s, t, k, p, line in E], "id long, source string, target string, kind string, provenance string, line long")
    return mutations.insert_or_ignore(raw).cache()


def ids(df, column="id"):
    return {ALIAS.get(r[column], r[column]) for r in df.collect()}


def one(spark, alias):
    return spark.createDataFrame([(N[alias][0],)], "id string")


def test_insert_or_ignore(edges):
    assert edges.count() == 12 and edges.where("id = 13").isEmpty()


def test_status(spark, nodes, edges):
    r = metrics.status(nodes, edges, spark.createDataFrame([], "path string")).first()
    assert (r["nodes"], r["edges"], r["files"], r["status"]) == (10, 12, 0, "ready")


def test_search_and_resolve(nodes):
    assert ids(lookup.search(nodes, "HELP")) == {"n3", "n9"}
    assert ids(lookup.resolve(nodes, "Get")) == {"n4", "n6", "n7"}
    assert ids(lookup.resolve(nodes, N["n2"][0])) == {"n2"}
    assert lookup.search(nodes, "anonymous").isEmpty()


def test_impact(spark, nodes, edges):
    got = {ALIAS[r["id"]]: r["level"] for r in graph.impact(edges, one(spark, "n3")).collect()}
    assert got == {"n2": "HIGH", "n1": "MEDIUM", "n4": "MEDIUM"}


def test_impact_grows_with_depth(spark, edges):
    before = set()
    for depth in range(1, 6):
        now = ids(graph.impact(edges, one(spark, "n4"), depth))
        assert before <= now
        before = now


def test_shortest_path(edges):
    path = lambda a, b: [[ALIAS[x] for x in r["path"]] for r in graph.shortest_path(edges, N[a][0], N[b][0]).collect()]
    assert path("n1", "n4") == [["n1", "n2", "n4"]]
    assert path("n8", "n1") == [] and path("n1", "n1") == [["n1"]]


def test_dead_code(nodes, edges):
    dead = ids(graph.dead_code(nodes, edges))
    assert dead == {"n7", "n8"}
    alive = ids(graph.reach(edges, nodes.where("name = 'main'").select("id")))
    assert dead | alive >= ids(nodes.where("kind in ('function', 'method')"))


def test_cycles(edges):
    files = graph.lifted(edges, "imports")
    assert [r["cycle"] for r in graph.simple_cycles(files).collect()] == [["file:db/store.go", "file:svc/a.go"]]
    assert ids(graph.cyclic(files)) == {"file:db/store.go", "file:svc/a.go"}
    assert [r["cycle"] for r in graph.simple_cycles(graph.lifted(edges, "imports", "package")).collect()] == [["file:db", "file:svc"]]


def test_file_layers_have_no_depth_limit(spark):
    chain = [(f"f{k:02d}", f"f{k + 1:02d}") for k in range(11)]
    # A short cut, a cycle behind the root with a file below it, and two files that no root reaches.
    links = spark.createDataFrame([*chain, ("f00", "f09"), ("f00", "c1"), ("c1", "c2"), ("c2", "c1"), ("c2", "d"), ("u1", "u2"), ("u2", "u1")], "source string, target string")
    got = {r["id"]: r["layer"] for r in graph.file_layers(links).collect()}
    assert got == {**{f"f{k:02d}": k for k in range(12)}, "c1": 1, "c2": 1, "d": 2, "u1": 12, "u2": 12}


def test_coupling(edges):
    r = metrics.coupling(edges, "file:svc").first()
    assert (r["ca"], r["ce"], r["instability"]) == (1, 1, 0.5)


def test_canonical(spark, nodes, edges):
    assert ids(graph.canonical_start(nodes, edges, one(spark, "n9"))) == {"n3"}
    kept, moved = lookup.graph_data(nodes, edges)
    assert ids(kept) == {f"n{i}" for i in range(1, 9)}
    pairs = {(ALIAS[r["source"]], ALIAS[r["target"]]) for r in moved.where("kind = 'calls'").collect()}
    assert pairs == {("n1", "n2"), ("n2", "n3"), ("n2", "n4"), ("n4", "n2"), ("n1", "n3"), ("n3", "n3")}
    again = lookup.canonicalize(kept, moved)
    assert ids(again[0]) == ids(kept) and again[1].count() == moved.count()


def test_implements(nodes, edges):
    got = joins.implements(nodes, edges.where("kind = 'contains'")).collect()
    assert [(ALIAS[r["struct"]], ALIAS[r["interface"]]) for r in got] == [("n5", "n6")]


def test_projection(nodes, edges):
    assert {(r["module"], r["n"]) for r in metrics.module_sizes(nodes).collect()} == {("cmd", 1), ("db", 2), ("svc", 6)}
    links = {(r["source"], r["target"], r["n"]) for r in metrics.module_links(nodes, edges).collect()}
    assert links == {("cmd", "svc", 2), ("db", "svc", 1), ("svc", "db", 1)}


def test_fans(nodes, edges):
    r = graph.fans(nodes, edges).where(F.col("id") == N["n2"][0]).first()
    assert (r["fan_in"], r["fan_out"], r["cross"]) == (2, 3, 3)


def test_neighbourhood(spark, edges):
    assert [r["id"] for r in graph.neighbourhood(edges, one(spark, "n3"), 1).collect()] == [3, 5]


def test_blast_radius(nodes, edges):
    got = {ALIAS[r["id"]]: r["callers"] for r in graph.blast_radius(edges, nodes.select("id")).collect()}
    assert [got[k] for k in ("n3", "n4", "n2", "n9", "n1")] == [3, 2, 2, 1, 0]


def test_enclosing_policies(spark):
    spans = [("a", "function", "f", 1, 20), ("b", "function", "f", 5, 15), ("c", "function", "f", 8, 18)]
    nodes = spark.createDataFrame(spans, "id string, kind string, file_path string, start_line long, end_line long")
    point = spark.createDataFrame([(1, "f", 10), (2, "f", 99)], "point_id long, file_path string, line long")
    got = {p: [r["node_id"] for r in joins.enclosing(point, nodes, p).collect()] for p in joins.POLICIES}
    assert got == {"outermost": ["a"], "innermost": ["b"], "last": ["c"]}


def test_call_tree_marks_repeats(spark, edges):
    rows = graph.call_tree(edges, one(spark, "n1")).orderBy("path").collect()
    assert sum(r["repeated"] for r in rows) >= 2 and rows[0]["depth"] == 0
    chains = [r["chain"] for r in graph.call_chains(spark.createDataFrame([(v[0], v[2]) for v in N.values()], "id string, name string"), edges, one(spark, "n1")).collect()]
    assert "main → Run → Get" in chains


def test_external_nodes_and_checks(nodes, edges):
    assert [r["name"] for r in mutations.external_nodes(nodes, edges).collect()] == ["fmt.Println"]
    assert violations(nodes, edges).isEmpty()
    assert {r["rule"] for r in violations(nodes.unionByName(nodes.limit(1)), edges).collect()} == {"node: repeated id"}


def test_synthetic(spark):
    df = spark.createDataFrame([("a", "$anonXtype", "q"), ("$anonymous_type_1", "n", "q"), ("a", "$anonymousXtype_1", "q"), ("a", "n", "q")], "id string, name string, qualified_name string")
    assert [r[0] for r in df.select(predicates.non_synthetic()).collect()] == [True, False, False, True]
    assert [r[0] for r in df.select(predicates.strictly_non_synthetic()).collect()] == [False, False, False, True]
