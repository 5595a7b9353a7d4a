"""Globs, text machines, parsers, file sources, streams and SQL."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import globs, text
from lodestone.operators import joins
from lodestone.plans import sqlapi
from lodestone.sources import files, parse
from lodestone.streaming import changes


def segments_match(patterns, parts):
    if not patterns:
        return not parts
    if patterns[0] == "**":
        return any(segments_match(patterns[1:], parts[i:]) for i in range(len(parts) + 1))
    return bool(parts) and fnmatch.fnmatchcase(parts[0], patterns[0]) and segments_match(patterns[1:], parts[1:])


def slow_match(pattern, path):
    p = globs.normalize(pattern)
    p += "**" if p.endswith("/") else ""
    if not any(c in p for c in "*?["):
        return path == p or path.startswith(p + "/")
    return segments_match(p.split("/"), path.split("/")) or ("/" not in p and p != "**" and any(fnmatch.fnmatchcase(s, p) for s in path.split("/")))


def test_globs_match_as_segment_by_segment():
    import re

    rng = random.Random(4)
    pieces = ["**", "*", "a", "b*", "?", "[ab]?", "*.go", "x.go", "docs"]
    names = ["a", "b", "ab", "bc", "x.go", "a.go", "docs", "z"]
    for _ in range(4000):
        pattern = "/".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) + rng.choice(("", "", "/"))
        path = "/".join(rng.choice(names) for _ in range(rng.randint(1, 4)))
        found = globs.glob_regex(pattern)
        assert bool(found is not None and re.fullmatch(found, path + "/")) == slow_match(pattern, path), (pattern, path, found)


@pytest.mark.parametrize(("pattern", "path", "want"), [("docs/**", "docs/a/b", True), ("**/*.pb.go", "x.pb.go", True), ("*.min.js", "a/b.min.js", True), ("dir/", "dir/x", True), ("dir", "dir", True), ("dir", "dirx", False), ("[ab]?.go", "x/b1.go", True), ("[a", "a", False)])
def test_globs(spark, pattern, path, want):
    assert spark.range(1).select(globs.PathFilter.matches(F.lit(path), [pattern])).first()[0] is want


def test_config():
    rule = globs.read_config('index:\n  include:\n    - "**/*.go"\n  # exclude:\n  - docs/**\n  scip-exclude: [a/**, "b"]\n  tree_sitter_exclude:\n    - t  # note\n')
    assert rule == globs.PathFilter(["**/*.go"], ["docs/**"], ["a/**", "b"], ["t"])
    assert globs.read_config(globs.DEFAULT_CONFIG) == globs.PathFilter()


def test_text_machines():
    assert text.without_noise('a // b\nc /* d\n */ e "f // g" h # i') == "a     \nc     \n    e          h    "
    assert text.depth_of("if x:\n    for y:\n        z") == 1 and text.depth_of("") == 0
    assert text.depth_of("a {\n b {\n  c\n }\n}") == 2
    assert text.in_quotes('a "b(" c', 4) and not text.in_quotes('a "b" c(', 7) and text.in_quotes(r'"a\" b(', 6)
    assert text.brace_end('func f() {\n s := "}"\n // }\n if x {\n }\n}\n', 1) == 6
    assert text.brace_end("no block", 1) == 1
    assert [(line, name) for line, name, _ in text.sites('a(b(1)) // c(\n/* d( */ e()\ns := "f(" + g()\n# h(\n/*\ni()\n*/ j()')] == [(1, "a"), (1, "b"), (2, "e"), (3, "g"), (7, "j")]
    assert text.sites("x.y(1)") == [(1, "y", "x")]


def test_measures(spark):
    code = "func f(a int) int {\n\tif a > 0 && a < 5 || a == 9 {\n\t\treturn 1\n\t}\n\n\treturn 2 // if\n}\n"
    r = text.measure(spark.createDataFrame([("f", code)], "id string, text string")).first()
    assert (r["branches"], r["returns"], r["loc"], r["depth"]) == (3, 2, 4, 2)


def test_python_and_pattern_parsers(spark):
    rows = parse.parse("lib/m.py", 'import os\nclass A:\n    """Doc."""\n    def f(self):\n        return self.g()\n    def g(self):\n        return 1\ndef h(): pass\ndef h(): pass\n', "python")
    nodes = {r["qualified_name"]: r for r in rows if r["row"] == "node"}
    assert set(nodes) == {"A", "A.f", "A.g", "h"} and nodes["A"]["docstring"] == "Doc." and nodes["A.f"]["kind"] == "method"
    assert ("py:lib/m.py::A.f", "py:lib/m.py::A.g") in {(r["source"], r["target"]) for r in rows if r["row"] == "calls"}
    assert [r["errors"] for r in rows if r["row"] == "file"] == ["repeated h"]
    go = parse.parse("a.go", 'package a\nimport (\n\t"fmt"\n)\ntype S struct {\n}\n// Get gets.\nfunc (s *S) Get() int {\n\treturn one()\n}\nfunc one() int { return 1 }\n', "go")
    assert {r["qualified_name"]: (r["kind"], r["start_line"], r["end_line"]) for r in go if r["row"] == "node"} == {"S": ("struct", 5, 6), "S.Get": ("method", 8, 10), "one": ("function", 11, 11)}
    assert [r["target"] for r in go if r["row"] == "imports"] == ["import:fmt"]
    ts = parse.parse("a.ts", 'import {x} from "./y"\nexport class K {\n  run(a: number): void {\n    go(a)\n  }\n}\nexport const go = (a) => {\n}\n', "typescript")
    assert {r["qualified_name"]: r["kind"] for r in ts if r["row"] == "node"} == {"K": "class", "K.run": "method", "go": "function"}
    c = parse.parse("a.c", '#include <stdio.h>\nstruct p {\n int x;\n};\nstatic int f(int a)\n{\n  return a;\n}\n', "c")
    assert {r["name"]: (r["kind"], r["end_line"]) for r in c if r["row"] == "node"} == {"p": ("struct", 4), "f": ("function", 8)}
    assert parse.parse("b.py", "def (", "python")[-1]["errors"].startswith("not parsed")


def test_tree_of_files(spark, tmp_path):
    for name, body in {"src/a.go": "package a", "src/b.txt": "no", "node_modules/c.go": "no", "x.cpp": "int x;", "y.h": "int y;"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {r["path"]: r["language"] for r in files.tree(spark, str(tmp_path)).collect()}
    assert got == {"src/a.go": "go", "x.cpp": "cpp", "y.h": "cpp"}
    rule = globs.PathFilter(exclude=["src/**"])
    assert {r["path"] for r in files.tree(spark, str(tmp_path), rule).collect()} == {"x.cpp", "y.h"}


def test_verdicts_and_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"symbol_id": "s1", "decision": "REJECT"}]')
    (tmp_path / "b.json").write_text('{"s2": {"decision": "PASS", "rule_id": "r"}}')
    got = {r["symbol_id"]: r["decision"] for r in files.verdicts(spark, str(tmp_path)).collect()}
    assert got == {"s1": "REJECT", "s2": "PASS"}
    root = str(tmp_path / "docs")
    assert files.save_document(spark, root, "file", "a/b.go", "one", "20240101T000000") == "20240101T000000"
    assert files.save_document(spark, root, "file", "a/b.go", "two", "20240101T000000") == "20240101T000000-02"
    files.save_document(spark, root, "module", "m", "three", "20250101T000000")
    assert [r["content"] for r in files.stored_documents(spark, root).collect()][0] == "three"
    (tmp_path / "cc.json").write_text('[{"directory": "/d", "file": "a.c", "command": "cc a.c"}, {"file": "b.c"}, {"directory": "/d", "file": "c.c", "arguments": ["cc", "c.c"]}]')
    assert [r["command"] for r in files.compile_commands(spark, str(tmp_path / "cc.json")).orderBy("file").collect()] == ["cc a.c", "cc c.c"]


def test_stream_of_changes_ends_as_one_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"p{rng.randrange(6)}.go", "write", f"2024-01-01 00:{i:02}:00") for i in range(30)]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "path string, op string, ts string").withColumn("ts", F.to_timestamp("ts"))
    closing = spark.createDataFrame([("end.go", "write", "2024-01-02 00:00:00")], "path string, op string, ts string").withColumn("ts", F.to_timestamp("ts"))
    for k, part in enumerate((events.limit(15), events.subtract(events.limit(15)), closing)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del k
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    seen = []
    changes.stream(source, lambda df, n: seen.extend((r["path"], r["n"]) for r in df.collect()), str(tmp_path / "ck"), gap="90 seconds").awaitTermination()
    want = [(r["path"], r["n"]) for r in changes.debounce(events, "90 seconds").collect()]
    assert sorted(seen) == sorted(want)
    content = spark.createDataFrame([("p0.go", "h0"), ("p1.go", "h1")], "path string, content_hash string")
    files_ = spark.createDataFrame([("p0.go", "h0"), ("p2.go", "x"), ("q.go", "y")], "path string, content_hash string")
    after = {tuple(r) for r in changes.apply(files_, events, content).collect()}
    assert after == {("p0.go", "h0"), ("p1.go", "h1"), ("q.go", "y")}
    assert {tuple(r) for r in changes.plan(files_, events, content).collect()} == {("p1.go", "add"), ("p2.go", "delete")}


def test_sql_is_read_only(spark):
    sqlapi.register_views(spark, t1=spark.range(3))
    assert sqlapi.as_text(sqlapi.query(spark, "select id, null as x from t1 where id = 1;")) == "id | x\n1 | NULL\n(1 rows)"
    for bad in ("drop table t1", "insert into t1 values (1)", "select 1; drop view t1", "with a as (select 1) delete from t1"):
        with pytest.raises(ValueError, match="reading"):
            sqlapi.query(spark, bad)


def test_cross_file_calls(spark):
    src = [("a.go", "func Run() {\n\thelper()\n\tstore.Get()\n\tmain()\n\t// gone()\n}\n"), ("b.go", "func helper() {\n\thelper()\n}\n")]
    sources = spark.createDataFrame(src, "path string, text string")
    nodes = [("r", "function", "Run", "Run", "a.go", 1, 6), ("h", "function", "helper", "helper", "b.go", 1, 3), ("g", "method", "Get", "store.Get", "c.go", 1, 2), ("g2", "method", "Get", "other.Get", "d.go", 1, 2), ("m", "function", "main", "main", "c.go", 5, 6)]
    got = joins.cross_file_calls(sources, spark.createDataFrame(nodes, "id string, kind string, name string, qualified_name string, file_path string, start_line long, end_line long"))
    assert {(r["source"], r["target"], r["line"]) for r in got.collect()} == {("r", "h", 2), ("r", "g", 3)}


def test_phrases(spark):
    nodes = spark.createDataFrame([("a", "open the file"), ("b", "the open file"), ("c", "Éclair")], "id string, name string")
    index = text.tokens(nodes, ("name",))
    assert {r[0] for r in text.match(index, ["open-file"]).collect()} == {"b"}
    assert {r[0] for r in text.match(index, ["eclair", "open"]).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError, match="operators"):
        text.match(index, ["a NEAR b"])
