"""Index runs on a small project, versions of tables, documents, the SQL surface and files."""

import os

import pytest

from lodestone.functions.globs import DEFAULT_CONFIG, PathFilter, read_config, write_default_config
from lodestone.operators import documents
from lodestone.plans import sqlapi
from lodestone.sources import files, index

PROJECT = {
    "cmd/main.go": 'package main\n\nfunc main() {\n\tRun(1)\n}\n',
    "svc/a.go": 'package svc\n\nimport "fmt"\n\n// Run starts it.\nfunc Run(x int) int {\n\treturn helper(x)\n}\n\nfunc helper(x int) int {\n\tfmt.Println("Run(")\n\treturn x\n}\n',
    "db/store.go": "package db\n\ntype Store struct {\n}\n\nfunc (s *Store) Get(k string) string {\n\treturn k\n}\n\ntype Getter interface {\n\tGet(k string) string\n}\n",
    "lib/m.py": 'class Box:\n    """A box."""\n\n    def open(self):\n        return self.peek()\n\n    def peek(self):\n        return 1\n',
    "node_modules/x.js": "function no() {}\n",
    "notes.txt": "func no() {}\n",
}


@pytest.fixture
def project(tmp_path):
    for path, text in PROJECT.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def pairs(tables, kind):
    return {(r["source"], r["target"]) for r in tables.edges.where(f"kind = '{kind}'").collect()}


def test_a_project_is_indexed_updated_and_kept(spark, project, tmp_path):
    tables = index.index(spark, str(project), PathFilter(exclude=["docs/**"]))
    kinds = {r["id"]: r["kind"] for r in tables.nodes.collect()}
    assert kinds["go:cmd/main.go::main"] == "function" and kinds["go:db/store.go::Store.Get"] == "method" and kinds["py:lib/m.py::Box"] == "class"
    assert {r["path"] for r in tables.files.collect()} == {"cmd/main.go", "svc/a.go", "db/store.go", "lib/m.py"}
    calls = pairs(tables, "calls")
    assert ("go:cmd/main.go::main", "go:svc/a.go::Run") in calls and ("go:svc/a.go::Run", "go:svc/a.go::helper") in calls and ("py:lib/m.py::Box.open", "py:lib/m.py::Box.peek") in calls
    assert not any("Println" in t or t.endswith("::Run") and s.endswith("helper") for s, t in calls)
    assert {r["path"]: r["node_count"] for r in tables.files.collect()}["svc/a.go"] == 2
    root = f"file://{tmp_path}/tables"
    first = index.commit(tables, root)
    assert index.opened(spark, root).nodes.count() == len(kinds)
    assert index.update(spark, str(project), index.opened(spark, root)).nodes.count() == len(kinds)
    (project / "svc/a.go").write_text("package svc\n\nfunc Run(x int) int {\n\treturn Store_(x)\n}\n")
    os.remove(project / "lib/m.py")
    again = index.update(spark, str(project), index.opened(spark, root))
    whole = index.index(spark, str(project))
    for kind in ("contains", "calls", "imports", "implements"):
        assert pairs(again, kind) == pairs(whole, kind)
    assert {r["id"] for r in again.nodes.collect()} == {r["id"] for r in whole.nodes.collect()}
    assert index.commit(again, root) != first and index.opened(spark, root).nodes.count() == whole.nodes.count()


def test_documents_of_a_project(spark, project):
    tables = index.index(spark, str(project))
    rows = documents.file_documents(tables.nodes, tables.edges).where("of = 'svc/a.go'").collect()
    of = {(r["section"], r["name"]): r["value"] for r in rows}
    assert of["overview", "symbols"] == "2" and of["overview", "files that need it"] == "1" and of["overview", "language"] == "Go"
    assert of["interfaces", "Run"].endswith("called 1 by main") and ("inner functions", "helper") in of
    modules = {(r["of"], r["section"], r["name"]) for r in documents.module_documents(tables.nodes, tables.edges).collect()}
    assert ("svc", "files", "svc/a.go") in modules and ("cmd", "role", "role") in modules
    whole = {(r["section"], r["name"]): r["value"] for r in documents.project_document(tables.nodes, tables.edges).collect()}
    assert whole["languages", "Go"] and ("chains", "main → Run → helper") in whole


def test_only_reading_statements_are_taken(spark):
    spark.range(3).selectExpr("id as cache", "id as load").createOrReplaceTempView("words")
    assert sqlapi.query(spark, "select cache as x, load as y from words where 'drop table t; insert' <> '';").count() == 3
    assert sqlapi.query(spark, "with a as (select 1 as set) select set from a").count() == 1
    for text in ("drop view words", "create table x as select 1", "insert into words select 1, 2", "select 1; drop view words", "with a as (select 1, 2) insert into words select * from a", "set a = b", "cache table words", "from words insert into words select cache, load"):
        with pytest.raises(Exception):
            sqlapi.query(spark, text)
    assert spark.table("words").count() == 3
    shown = sqlapi.as_text(spark.sql("select 1 as a, cast(null as string) as b union all select 2, 'x' order by a"))
    assert shown == "a | b\n1 | NULL\n2 | x\n(2 rows)"


def test_default_config(tmp_path):
    path = tmp_path / "filter.yaml"
    assert write_default_config(str(path)) and not write_default_config(str(path))
    assert path.read_text() == DEFAULT_CONFIG and read_config(DEFAULT_CONFIG) == PathFilter()


def test_compile_commands_of_one_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"directory": "/s", "file": "a.c", "command": "cc a.c"}, {"directory": "/s", "file": "b/x.c", "arguments": ["cc", "x.c"]}, {"file": "n.c", "command": "cc"}]')
    assert files.rewrite_compile_commands(spark, str(tmp_path / "c.json"), str(tmp_path / "out"), PathFilter(exclude=["b/**"])) == 1
    assert [tuple(r) for r in files.compile_commands(spark, str(tmp_path / "out")).collect()] == [("/s", "a.c", "cc a.c")]


def test_an_update_does_not_gather_changed_paths_on_the_driver(spark, project, monkeypatch):
    """Before, Spark broadcast the paths to parse again, as they are few bytes as a file."""
    known = index.Tables(*(spark.createDataFrame([], s) for s in (index.NODES, index.EDGES, index.FILES, index.VERDICTS)))
    monkeypatch.setattr(index, "build", lambda sources, *rest: sources)
    again = index.update(spark, str(project), known)
    assert {r["path"] for r in again.collect()} == {"cmd/main.go", "svc/a.go", "db/store.go", "lib/m.py"}
    assert "BroadcastHashJoin" not in again._jdf.queryExecution().executedPlan().toString()
