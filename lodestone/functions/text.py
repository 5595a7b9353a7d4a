"""Source text: lines, tokens, full-text matches, and figures of complexity.

What regular expressions and array functions can say stays in the JVM. Four state machines over characters are Arrow UDFs.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.predicates import col


def lines(sources: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line_no (from 1) and line."""
    return sources.select(path, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(path, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def read_range(line_rows: DataFrame, first: Column | int, last: Column | int, key: str = "path") -> DataFrame:
    """key and text: the lines from first to last, joined again."""
    inside = line_rows.where(F.col("line_no").between(first, last))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return inside.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("text"))


def snippet(line_rows: DataFrame, at: int, count: int = 120, key: str = "path") -> DataFrame:
    """The lines about a line."""
    start = max(1, at - count // 2)
    return read_range(line_rows, start, start + count - 1, key)


@cache
def accents() -> tuple[str, str]:
    """Letters that are a base letter with marks, and the base letters; behind them the marks themselves, which have none."""
    composed, base = [], []
    for i in range(0x80, 0x10000):
        parts = unicodedata.normalize("NFD", chr(i))
        if len(parts) > 1 and all(unicodedata.combining(m) for m in parts[1:]):
            composed.append(chr(i))
            base.append(parts[0])
    marks = [chr(i) for i in range(0x300, 0x370) if unicodedata.combining(chr(i))]
    return "".join(composed + marks), "".join(base)


def words(c: Column | str) -> Column:
    """Words of the index: letters and digits in lower case, without accents."""
    plain = F.translate(F.lower(col(c)), *accents())
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def words_of(term: str) -> list[str]:
    """The words of a term, as `words` has those of a column."""
    letters, base = accents()
    plain = term.lower().translate({ord(a): base[k] if k < len(base) else None for k, a in enumerate(letters)})
    return re.findall(r"[^\W_]+", plain)


def tokens(nodes: DataFrame, columns: tuple[str, ...] = ("id", "name", "qualified_name", "docstring", "signature")) -> DataFrame:
    """node_id, col, pos and token of the indexed columns that there are."""
    parts = [nodes.select(F.col("id").alias("node_id"), F.lit(c).alias("col"), F.posexplode(words(c)).alias("pos", "token")) for c in columns if c in nodes.columns]
    return reduce(DataFrame.unionByName, parts)


def match(index: DataFrame, terms: list[str]) -> DataFrame:
    """node_id of nodes with one of the terms; a term of several words is a phrase in one column."""
    spark = index.sparkSession
    found = None
    for term in terms:
        if re.search(r"[:\"*^]|\b(?:NEAR|NOT|AND)\b", term):
            raise ValueError(f"operators aren't taken in terms: {term}")
        parts = words_of(term)
        hit = None
        for k, w in enumerate(parts):
            at = index.where(F.col("token") == w).select("node_id", "col", (F.col("pos") - k).alias("start"))
            hit = at if hit is None else hit.join(at, ["node_id", "col", "start"], "left_semi")
        if hit is not None:
            found = hit.select("node_id") if found is None else found.unionByName(hit.select("node_id"))
    return found.distinct() if found is not None else spark.createDataFrame([], "node_id string")


def ranked_match(index: DataFrame, terms: list[str], n_nodes: int) -> DataFrame:
    """node_id and score, the sum of tf-idf over the terms' words."""
    own = index.where(F.col("token").isin([w for term in terms for w in words_of(term)]))
    tf = own.groupBy("node_id", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    return tf.join(F.broadcast(df), "token").groupBy("node_id").agg(F.round(F.sum(F.col("tf") * F.log(F.lit(float(n_nodes)) / F.col("df"))), 6).alias("score"))


def explore(nodes: DataFrame, edges: DataFrame, text: str, max_nodes: int = 10) -> DataFrame:
    """file, symbols and callers: nodes that a query of words finds, by file, and who calls them; without words the first ones."""
    terms = text.split()
    found = nodes if not terms else nodes.join(match(tokens(nodes), terms), nodes["id"] == F.col("node_id"), "left_semi")
    chosen = found.orderBy("file_path", "start_line", "id").limit(max_nodes)
    calls = edges.where("kind = 'calls'").join(F.broadcast(chosen.select(F.col("id").alias("target"), "file_path")), "target")
    related = calls.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_set(F.concat("source", F.lit(" → "), "target"))), ", ").alias("callers"))
    files = chosen.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("symbols"))
    return files.join(related, "file_path", "left").select(F.col("file_path").alias("file"), "symbols", F.coalesce("callers", F.lit("")).alias("callers"))


# --- figures of complexity ---

#: Words and signs that branch.
BRANCHES = ("if", "elif", "elseif", "for", "foreach", "while", "case", "catch", "except", "when", "guard", "&&", "||", "?")
#: Words of lines that dispatch at run time.
DISPATCH = ("callback", "handler", "listener", "hook", "dispatch", "registry", "register", "vtbl", "vtable", "ops", "interface", "delegate", "lambda", "event")


def without_noise(text: str) -> str:
    """Comments and strings as blanks; line ends stay."""
    out, i, n = [], 0, len(text)
    while i < n:
        c, two = text[i], text[i : i + 2]
        if two == "//" or c == "#":
            end = text.find("\n", i)
            end = n if end < 0 else end
        elif two == "/*":
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
        elif c in "\"'`":
            end = i + 1
            while end < n and text[end] != c and (c == "`" or text[end] != "\n"):
                end += 1 + (text[end] == "\\" and c != "`")
            end = min(end + 1, n)
        else:
            out.append(c)
            i += 1
            continue
        out.append(re.sub(r"[^\n]", " ", text[i:end]))
        i = end
    return "".join(out)


def depth_of(text: str) -> int:
    """Deepest nesting: closing brackets of a line first, then its opening braces; a line that ends with : opens a block."""
    deepest = depth = base = 0
    for line in text.split("\n"):
        body = line.strip()
        if not body:
            continue
        depth = max(0, depth - sum(body.count(c) for c in "})]"))
        indent = len(line) - len(line.lstrip(" \t"))
        if body.endswith(":") and indent >= base:
            base = indent
            deepest = max(deepest, depth + 1)
        depth += body.count("{")
        deepest = max(deepest, depth)
    return deepest


def in_quotes(line: str, at: int) -> bool:
    """Whether a position of a line stands in a string."""
    quote, i = "", 0
    while i < at:
        c = line[i]
        if quote:
            if c == "\\" and quote != "`":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        i += 1
    return bool(quote)


def brace_end(text: str | list[str], start: int) -> int:
    """Line (from 1) on which the block that opens at or after a line closes; the line itself if none does. text: whole, or its lines."""
    rows = text.split("\n") if isinstance(text, str) else text
    depth, opened, quote = 0, False, ""
    for no in range(start - 1, len(rows)):
        line, i = rows[no], 0
        quote = quote if quote == "`" else ""
        while i < len(line):
            c = line[i]
            if quote:
                if c == "\\" and quote != "`":
                    i += 1
                elif c == quote:
                    quote = ""
            elif line.startswith("//", i):
                break
            elif c in "\"'`":
                quote = c
            elif c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth <= 0:
                    return no + 1
            i += 1
    return start


_CALL = re.compile(r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\(")
_PREFIX = re.compile(r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\.\s*$")


def sites(text: str) -> list[tuple[int, str, str]]:
    """(line, name, prefix) of what looks like a call outside of comments and strings."""
    out, inside = [], False
    for no, line in enumerate(text.split("\n"), 1):
        body = line
        if inside:
            end = body.find("*/")
            if end < 0:
                continue
            body, inside = " " * (end + 2) + body[end + 2 :], False
        while (a := body.find("/*")) >= 0 and not in_quotes(body, a):
            b = body.find("*/", a + 2)
            inside = b < 0
            body = body[:a] + (" " * (b + 2 - a) + body[b + 2 :] if b >= 0 else "")
        if body.lstrip().startswith(("//", "#", "*")):
            continue
        for m in _CALL.finditer(body):
            if in_quotes(body, m.start()) or (c := body.find("//")) >= 0 and c < m.start() and not in_quotes(body, c):
                continue
            prefix = _PREFIX.search(body[: m.start()])
            out.append((no, m[1], prefix[1] if prefix else ""))
    return out


def stripped(c: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: without_noise(t) if t is not None else None)

    return run(col(c))


def nesting(c: Column | str) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: depth_of(t or "")).astype("int64")

    return run(col(c))


def quoted(line: Column | str, at: Column | str) -> Column:
    """Whether a position (from 0) of a line stands in a string."""

    @F.pandas_udf("boolean")
    def run(rows: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([in_quotes(x or "", int(a)) for x, a in zip(rows, places, strict=True)], dtype=bool)

    return run(col(line), col(at))


def block_end(text: Column | str, start: Column | str) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([brace_end(t or "", int(s)) for t, s in zip(texts, starts, strict=True)], dtype="int64")

    return run(col(text), col(start))


def call_sites(c: Column | str) -> Column:
    @F.pandas_udf("array<struct<line:long,name:string,prefix:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"line": a, "name": b, "prefix": p} for a, b, p in sites(t or "")])

    return run(col(c))


def code_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[a-z0-9_]+|&&|[|]{2}|[?]"), 0)


def branches(c: Column | str) -> Column:
    return F.size(F.filter(code_tokens(c), lambda t: t.isin(*BRANCHES))).cast("long")


def returns(c: Column | str) -> Column:
    return F.size(F.filter(code_tokens(c), lambda t: t == "return")).cast("long")


def effective_lines(c: Column | str) -> Column:
    """Lines that aren't blank or a lone brace."""
    return F.size(F.filter(F.split(col(c), "\n"), lambda x: ~F.trim(F.translate(x, "\t\r", "  ")).isin("", "{", "}"))).cast("long")


def dispatch_signals(c: Column | str, most: int = 5) -> Column:
    """L<n>: line of the first lines that dispatch at run time."""
    numbered = F.transform(F.split(col(c), "\n"), lambda x, i: F.when(reduce(lambda a, b: a | b, (F.lower(x).contains(w) for w in DISPATCH)), F.concat(F.lit("L"), (i + 1).cast("string"), F.lit(": "), F.trim(x))))
    return F.slice(F.filter(numbered, lambda x: x.isNotNull()), 1, most)


def update_tokens(index: DataFrame, changed: DataFrame, gone: DataFrame | None = None, columns: tuple[str, ...] = ("id", "name", "qualified_name", "docstring", "signature")) -> DataFrame:
    """The index after a change of nodes: rows of changed (nodes) and gone (id) leave it, and those of changed are made anew."""
    touched = changed.select(F.col("id").alias("node_id"))
    if gone is not None:
        touched = touched.unionByName(gone.select(F.col("id").alias("node_id")))
    return index.join(touched.distinct(), "node_id", "left_anti").select(*index.columns).unionByName(tokens(changed, columns).select(*index.columns))


def measure(functions: DataFrame, text: str = "text") -> DataFrame:
    """functions (id, text) with branches, returns, loc and depth."""
    clean = functions.withColumn("_clean", stripped(text))
    return clean.select("id", branches("_clean").alias("branches"), returns("_clean").alias("returns"), effective_lines("_clean").alias("loc"), nesting("_clean").alias("depth"))


def complexity_reasons() -> Column:
    """Sentences on what makes a function risky, from columns cyclomatic, loc, depth, returns, fan_in, fan_out, cross, public."""
    c = F.col
    found = F.array(
        F.when(c("cyclomatic") > 20, F.format_string("very many paths: %d", "cyclomatic")).when(c("cyclomatic") > 10, F.format_string("many paths: %d", "cyclomatic")),
        F.when(c("loc") > 120, F.format_string("long: %d lines", "loc")),
        F.when(c("depth") > 4, F.format_string("deeply nested: %d", "depth")),
        F.when(c("returns") > 5, F.format_string("many returns: %d", "returns")),
        F.when((c("fan_in") > 10) | (c("fan_out") > 10), F.format_string("many calls: %d in, %d out", "fan_in", "fan_out")),
        F.when(c("cross") > 0, F.format_string("calls over directories: %d", "cross")),
        F.when(c("public"), F.lit("public, so changes reach further")),
    )
    kept = F.filter(found, lambda x: x.isNotNull())
    return F.when(F.size(kept) == 0, F.array(F.lit("low risk"))).otherwise(kept)


def running_comment(line_rows: DataFrame, key: str = "path") -> DataFrame:
    """line rows with in_comment: whether a block comment is open where the line starts."""
    opened = F.regexp_count("line", F.lit(r"/\*")) - F.regexp_count("line", F.lit(r"\*/"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return line_rows.withColumn("in_comment", F.coalesce(F.sum(opened).over(before), F.lit(0)) > 0)
