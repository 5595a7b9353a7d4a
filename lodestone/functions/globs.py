"""Path filters: globs compiled to regular expressions once, then tested by the JVM."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
BUILT_IN = (
    ".git/**", ".lodestone/**", ".understand-anything/**", ".cache/**", ".idea/**", ".vscode/**", "node_modules/**", "build/**",
    "dist/**", "vendor/**", "target/**", "out/**", "tmp/**", "temp/**", ".trash*/**",
)


def normalize(path: str) -> str:
    """Trimmed, / as the separator, no leading ./ or /, no . or empty segments; a final slash stays."""
    p = path.strip().replace("\\", "/")
    end = "/" if p.endswith("/") and p.strip("/") else ""
    out: list[str] = []
    for part in p.split("/"):
        if part == ".." and out and out[-1] != "..":
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out) + (end if out else "")


def segment_regex(glob: str) -> str | None:
    """One segment's glob as a regular expression; None if it is malformed and so matches nothing."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = i + 1 + (glob[i + 1 : i + 2] == "^")
            close = glob.find("]", end + 1) if glob[end : end + 1] != "]" else -1
            if close < 0:
                return None
            body = re.sub(r"([\\\[\]&~|^])", r"\\\1", glob[end:close])
            out += f"[{'^' if end > i + 1 else ''}{body}]"
            i = close
        elif c == "\\":
            if i + 1 == len(glob):
                return None
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def glob_regex(pattern: str) -> str | None:
    """A regular expression that a path with a / behind it matches if the glob does; None if nothing can.

    ** stands for any number of segments; a pattern that ends with / takes all below it; one without wildcards is a path or
    a directory; a wildcard pattern without / matches any segment.
    """
    p = normalize(pattern)
    if not p:
        return None
    if p.endswith("/"):
        p += "**"
    if not re.search(r"[*?\[]", p):
        return f"{re.escape(p)}/(?:[^/]*/)*"
    out = []
    for part in p.split("/"):
        seg = None if part == "**" else segment_regex(part)
        if part != "**" and seg is None:
            return None
        if part != "**" or out[-1:] != ["(?:[^/]*/)*"]:
            out.append("(?:[^/]*/)*" if part == "**" else f"{seg}/")
    whole = "".join(out)
    return f"(?:[^/]*/)*{whole}(?:[^/]*/)*" if "/" not in p and p != "**" else whole


@dataclass
class PathFilter:
    """Which paths are indexed: built-in excludes, then the include list, the excludes, and those of a stage."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    scip_exclude: list[str] = field(default_factory=list)
    tree_sitter_exclude: list[str] = field(default_factory=list)

    @staticmethod
    def matches(path: Column, patterns) -> Column:
        found = [r for p in patterns if (r := glob_regex(p)) is not None]
        return F.concat(path, F.lit("/")).rlike("^(?:" + "|".join(found) + ")$") if found else F.lit(False)

    def _stage(self, stage: str | None) -> list[str]:
        return {"scip": self.scip_exclude, "tree-sitter": self.tree_sitter_exclude}.get(stage or "", [])

    def allows(self, path: Column, stage: str | None = None) -> Column:
        inside = self.matches(path, self.include) if self.include else F.lit(True)
        return ~self.matches(path, BUILT_IN) & inside & ~self.matches(path, self.exclude) & ~self.matches(path, self._stage(stage))

    def allows_dir(self, path: Column, stage: str | None = None) -> Column:
        """The include list doesn't count; the path and the path with / are tested."""
        excluded = [*BUILT_IN, *self.exclude, *self._stage(stage)]
        return ~(self.matches(path, excluded) | self.matches(F.concat(path, F.lit("/")), excluded))

    def report(self, paths: DataFrame, column: str = "path") -> DataFrame:
        """rule and path, for each of the three exclude lists what it takes out; paths below an excluded directory aren't listed."""
        p = F.col(column)
        out = []
        for rule, patterns in (("exclude", [*BUILT_IN, *self.exclude]), ("scipExclude", self.scip_exclude), ("treeSitterExclude", self.tree_sitter_exclude)):
            names = F.split(p, "/")
            above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i * 0 + 1, i), "/"))
            first = F.get(F.filter(above, lambda d: self.matches(d, patterns) | self.matches(F.concat(d, F.lit("/")), patterns)), 0) if patterns else F.lit(None)
            shown = F.when(first == p, p).otherwise(F.concat(first, F.lit("/")))
            out.append(paths.select(F.lit(rule).alias("rule"), shown.alias("path")).where("path is not null").distinct())
        return reduce(DataFrame.unionByName, out)


def read_config(text: str) -> PathFilter:
    """The YAML subset of a filter file: lists under index, as - items or inline; case, - and _ in keys don't matter."""
    names = {"include": "include", "exclude": "exclude", "scipexclude": "scip_exclude", "treesitterexclude": "tree_sitter_exclude"}
    out, at = PathFilter(), None
    clean = lambda s: s.strip().strip("\"'")
    for line in text.splitlines():
        commented = line.strip().startswith("#")
        body = line.strip().lstrip("#").strip() if commented else re.sub(r"\s+#.*$", "", line).strip()
        if m := re.fullmatch(r"([A-Za-z_-]+)\s*:\s*(.*)", body):
            key = re.sub("[-_]", "", m[1]).lower()
            if key in names:
                at = names[key]  # a commented key names the items that follow too
                if not commented and (inline := m[2].strip()).startswith("["):
                    getattr(out, at).extend(clean(x) for x in inline.strip("[]").split(",") if clean(x))
            continue
        if not commented and at and body.startswith("-") and (item := clean(body[1:])):
            getattr(out, at).append(item)
    return out


def write_default_config(path: str) -> bool:
    """Writes the default filter file where there is none; whether it did."""
    try:
        with open(path, "x", encoding="utf-8") as f:
            f.write(DEFAULT_CONFIG)
    except FileExistsError:
        return False
    return True


DEFAULT_CONFIG = """\
# Paths are relative to the project and use / as the separator.
index:
  # include:
  #   - "**/*.go"
  # exclude:
  #   - "docs/**"
  # scipExclude:
  #   - "examples/**"
  # treeSitterExclude:
  #   - "testdata/**"
"""
