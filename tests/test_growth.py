"""Steps whose work or memory would grow faster than their input."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone import session
from lodestone.operators import graph, joins, mutations
from lodestone.plans.fixtures import load
from lodestone.sources import parse

NODE = "id string, kind string, name string, file_path string, language string, start_line long, end_line long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("policy", ["outermost", "innermost", "last"])
def test_enclosing_is_the_best_span_of_all(spark, policy):
    rng = random.Random(7)
    spans = [(f"n{k:03}", "function", "f", f"p{k % 3}", "go", a := rng.randrange(70), a + rng.randrange(-1, 40)) for k in range(200)]
    spans += [("long", "method", "f", "p0", "go", 3, 2**40)]
    points = [(k, f"p{k % 4}", rng.randrange(120)) for k in range(300)]
    key = {"outermost": lambda s: (s[5], s[0]), "innermost": lambda s: (s[6] - s[5], s[5], s[0]), "last": lambda s: (s[5], s[0])}[policy]
    want = {}
    for k, path, line in points:
        over = [s for s in spans if s[3] == path and s[5] <= line <= s[6]]
        if over:
            want[k] = (max if policy == "last" else min)(over, key=key)[0]
    found = joins.enclosing(spark.createDataFrame(points, "point_id long, file_path string, line long"), spark.createDataFrame(spans, NODE), policy)
    assert {r["point_id"]: r["node_id"] for r in found.collect()} == want


def test_enclosing_does_not_pair_points_with_all_spans_of_a_file(spark):
    spans = spark.range(20000).selectExpr("concat('n', id) as id", "'function' as kind", "'f' as name", "'p' as file_path", "'go' as language", "id as start_line", "id + 30000 as end_line")
    points = spark.range(20000).selectExpr("id as point_id", "'p' as file_path", "id as line")
    found = joins.enclosing(points, spans, "last")
    assert not any("Join" in x and "start_line" in x for x in plan(found).splitlines()) and found.where("node_id = concat('n', line)").count() == 20000


def test_one_file_of_sources_is_parsed_in_several_tasks(spark):
    sources = spark.range(400).coalesce(1).selectExpr("concat(id, '.go') as path", "concat('func F', id, '() {\n}\n') as text", "'go' as language")
    rows = parse.parse_files(sources)
    assert rows.groupBy(F.spark_partition_id()).count().count() > 1 and rows.where("row = 'node'").count() == 400


def test_methods_of_groups_are_those_of_members(spark):
    nodes = spark.createDataFrame([("m1", "method", "Get"), ("m2", "method", "Put"), ("m3", "method", "Get"), ("f", "function", "Get"), ("m4", "method", None)], "id string, kind string, name string")
    owners = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("a", 2), ("d", 3), ("e", None)], "source string, group long")
    groups = spark.createDataFrame([(1, "m1"), (1, "m2"), (2, "m3"), (2, "m4"), (3, "f"), (None, "m1")], "group long, target string")
    found = {r["owner"]: (r["methods"], r["nameless"]) for r in joins.method_sets(nodes, owners, groups).collect()}
    assert found == {"a": (["Get", "Put"], True), "b": (["Get", "Put"], False), "c": (["Get"], True)}
    plain = joins.method_sets(nodes, owners.join(groups, "group").select("source", "target"))
    assert {r["owner"]: (r["methods"], r["nameless"]) for r in plain.collect()} == found


def test_placeholders_never_gather_all_nodes_on_the_driver(spark):
    nodes, edges = spark.createDataFrame([("external:a",)], "id string"), spark.createDataFrame([("external:a",), ("external:b",)], "target string")
    found = mutations.external_nodes(nodes, edges)
    assert "BroadcastHashJoin" not in plan(found) and [r["name"] for r in found.collect()] == ["b"]


def test_owners_of_equal_methods_are_compared_once(spark):
    nodes = spark.createDataFrame([("m1", "method", "Get", "go"), ("m2", "method", "Put", "go"), ("s1", "struct", "S", "go"), ("s2", "struct", "S", "go"), ("s3", "struct", "S", "py"), ("i1", "interface", "I", "go"), ("i2", "interface", "I", "go"), ("i3", "interface", "I", None)], "id string, kind string, name string, language string")
    links = [("s1", "m1"), ("s1", "m2"), ("s2", "m1"), ("s3", "m1"), ("s3", "m2"), ("i1", "m1"), ("i1", "m2"), ("i2", "m1"), ("i3", "m1")]
    members = spark.createDataFrame(links, "source string, target string")
    every = {("s1", "i1"), ("s3", "i1"), *((s, i) for s in ("s1", "s2", "s3") for i in ("i2", "i3"))}
    assert {tuple(r) for r in joins.implements(nodes, members).collect()} == every
    assert {tuple(r) for r in joins.implements(nodes, members, same_language=True).collect()} == {("s1", "i1"), ("s1", "i2"), ("s2", "i2")}


def test_classes_of_methods_are_not_gathered_on_the_driver(spark, monkeypatch):
    """Before, Spark took the classes to be as small as their file and broadcast a row with all methods for each method of each."""
    plans, write = [], session.Stages.write
    monkeypatch.setattr(session.Stages, "write", lambda self, df, name: (plans.append(plan(df)), write(self, df, name))[1])
    nodes = spark.createDataFrame([("m1", "method", "Get", "go"), ("m2", "method", "Put", "go"), ("s", "struct", "S", "go"), ("t", "struct", "T", "go"), ("i", "interface", "I", "go")], "id string, kind string, name string, language string")
    owners = [("s", "m1"), ("s", "m2"), ("t", "m2"), ("i", "m1")]
    members = spark.createDataFrame(owners, "source string, target string")
    assert [tuple(r) for r in joins.implements(nodes, members).collect()] == [("s", "i")]
    groups = members.select(F.col("target").alias("group"), "target").distinct()
    assert [tuple(r) for r in joins.implements(nodes, members.selectExpr("source", "target as group"), groups=groups).collect()] == [("s", "i")]
    gathered = [x for p in plans for x in p.splitlines() if "BroadcastHashJoin" in x and ("Inner" in x or "Semi" in x)]
    assert plans and not any(c in x for x in gathered for c in ("[language", "[source", "method#"))


def test_pairs_of_one_name_are_many_tasks(spark, monkeypatch):
    """Before, one task made all pairs of a name: few bytes on both sides."""
    monkeypatch.setattr(joins, "BLOCK", 100)
    nodes = spark.range(1500).selectExpr("concat('n', id) as id", "'function' as kind", "if(id < 1000, 'main', null) as name", "if(id % 2 = 0, 'main', concat('q', id)) as qualified_name")
    asked = spark.range(1200).selectExpr("if(id < 1000, 'main', if(id < 1100, 'q1', if(id < 1150, 'none', null))) as name", "id as asker")
    found = joins.by_name(asked, nodes)
    tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 1000 * 1250 + 100 and max(r["count"] for r in tasks) < 1000 * 1250 // 4
    assert found.distinct().count() == 1000 * 1250 + 100 and {r["id"] for r in found.where("name = 'q1'").select("id").distinct().collect()} == {"n1"}


def test_structs_and_interfaces_of_one_set_are_many_tasks(spark, monkeypatch):
    """Before, one task made all pairs of two large classes, and all interfaces were gathered on the driver."""
    monkeypatch.setattr(joins, "BLOCK", 50)
    owners = spark.range(1000).selectExpr("concat('o', id) as id", "if(id % 2 = 0, 'struct', 'interface') as kind", "'O' as name", "'go' as language")
    nodes = owners.unionByName(spark.createDataFrame([("m", "method", "Get", "go")], owners.schema))
    found = joins.implements(nodes, owners.selectExpr("id as source", "'m' as target"))
    tasks = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 250_000 == found.distinct().count() and max(r["count"] for r in tasks) < 250_000 // 4
    assert "BroadcastHashJoin Inner" not in plan(found)


def test_tasks_are_more_where_tables_are_larger(spark, tmp_path, monkeypatch):
    """Before, a task sorted or summed 64 MB of shuffled rows, or 128 MB of a file, and there were never more than the session's number of tasks."""
    names = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.set(names[1], "64m")
        spark.conf.set(names[2], "1m")
        spark.range(200_000).write.parquet(f"{tmp_path}/t.parquet")
        monkeypatch.setattr(session, "TASK_BYTES", 32 << 10)
        load(spark, str(tmp_path))
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert int(spark.conf.get(names[0])) > least and spark.conf.get(names[1]) == str(32 << 10)
        monkeypatch.setattr(session, "TASK_BYTES", 64 << 20)
        load(spark, str(tmp_path))
        assert int(spark.conf.get(names[0])) == least and spark.conf.get(names[1]) == str(32 << 10)
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)
