"""Column helpers for symbols, paths and text matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by language.
LANGUAGE_EXTENSIONS = {
    "go": (".go",),
    "typescript": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"),
    "python": (".py",),
    "java": (".java",),
    "c": (".c", ".h"),
    "cpp": (".cc", ".cpp", ".cxx", ".hpp", ".hxx"),
}
INDEX_EXTENSIONS = (".go", ".py", ".ts", ".tsx", ".js", ".jsx", ".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hxx", ".java")
SKIPPED_DIRECTORIES = (".git", ".lodestone", ".understand-anything", ".cache", ".idea", ".vscode", "node_modules", "build", "dist", "vendor", "target", "out", "tmp", "temp")
ID_PREFIXES = {"c": "c", "go": "go", "python": "py", "typescript": "ts", "cpp": "cxx", "java": "java"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def like(c: Column | str, pattern: str) -> Column:
    """LIKE without case or escape character: a backslash is a plain character."""
    return col(c).ilike(pattern.replace("\\", "\\\\"))


def holds(c: Column | str, text: str) -> Column:
    """LIKE %text%; % and _ in the text stay wild."""
    return like(c, f"%{text}%")


def non_synthetic(id: str = "id", name: str = "name", qualified: str = "qualified_name") -> Column:
    """Not a symbol that an indexer made up; _ is wild here."""
    return ~like(name, "$anonymous_type_%") & ~like(qualified, "%$anonymous_type_%") & ~like(id, "%$anonymous_type_%")


def strictly_non_synthetic(id: str = "id", name: str = "name", qualified: str = "qualified_name") -> Column:
    """As non_synthetic, _ taken literally, and without names that start $anon."""
    marks = [F.contains(F.col(c), F.lit("$anonymous_type_")) for c in (name, qualified, id)]
    return ~reduce(lambda a, b: a | b, marks) & ~F.startswith(F.col(name), F.lit("$anon"))


def module_of(path: Column | str) -> Column:
    """First segment of a path, or (root)."""
    p = F.trim(col(path), F.lit("/"))
    return F.when(p.contains("/"), F.substring_index(p, "/", 1)).otherwise("(root)")


def dir_of(path: Column | str) -> Column:
    """All before the last slash; . without one."""
    return F.when(col(path).contains("/"), F.regexp_extract(col(path), "^(.*)/[^/]*$", 1)).otherwise(".")


def base_of(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def extension_of(path: Column | str) -> Column:
    """Last dot of the file name and what follows, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(base_of(path), r"(\.[^.]*)$", 1))


def clean_path(path: Column | str) -> Column:
    """Trimmed, / as the separator, without empty and . segments, .. taken out with the segment before it; a final slash stays."""
    p = F.translate(F.trim(col(path)), "\\", "/")

    def step(kept: Column, part: Column) -> Column:
        up = (part == "..") & F.coalesce(F.try_element_at(kept, F.lit(-1)) != "..", F.lit(False))
        return F.when(part.isin("", "."), kept).when(up, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, part))

    kept = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.array_join(kept, "/"), F.when(F.endswith(p, F.lit("/")) & (F.size(kept) > 0), "/").otherwise(""))


def by_extension(path: Column | str, pairs: dict[str, str], default: str | None) -> Column:
    ext = extension_of(path)
    out = F
    for e, lang in pairs.items():
        out = out.when(ext == e, lang)
    return out.otherwise(F.lit(default))


def language_of(path: Column | str, with_cpp: Column) -> Column:
    """Language by extension; .h is C++ where the project (with_cpp) has C++ files, else C."""
    pairs = {e: lang for lang, exts in LANGUAGE_EXTENSIONS.items() for e in exts if e != ".h"}
    return F.when(extension_of(path) == ".h", F.when(with_cpp, "cpp").otherwise("c")).otherwise(by_extension(path, pairs, "unknown"))


def imported_language(path: Column | str) -> Column:
    """Language of an imported symbol's file; cxx for unknown extensions."""
    pairs = {e: lang for lang, exts in LANGUAGE_EXTENSIONS.items() for e in exts if e not in (".mjs", ".cjs")}
    return by_extension(path, pairs, "cxx")


def skipped_directory(path: Column | str) -> Column:
    """Whether a directory of the path is on the skip list."""
    names = F.slice(F.split(col(path), "/"), 1, F.greatest(F.size(F.split(col(path), "/")) - 1, F.lit(0)))
    return F.exists(names, lambda n: n.isin(*SKIPPED_DIRECTORIES) | n.startswith(".trash"))


def symbol_id(prefix: Column | str, path: Column | str, qualified: Column | str, symbol: Column | None = None) -> Column:
    """<prefix>:<path>::<qualified name>; an imported symbol keeps its own text unless longer than 200 bytes."""
    built = F.concat(col(prefix), F.lit(":"), col(path), F.lit("::"), col(qualified))
    if symbol is None:
        return built
    return F.when(F.octet_length(symbol) > 200, F.concat(F.lit("scip:"), col(path), F.lit("::"), col(qualified))).otherwise(symbol)


def qualified_of_symbol(symbol: Column | str) -> Column:
    """Last word of a symbol without final dots, its separators as dots."""
    last = F.substring_index(col(symbol), " ", -1)
    return F.translate(F.regexp_replace(last, r"\.$", ""), "/#:", "...")


def symbol_name(symbol: Column | str) -> Column:
    """Name in a symbol: behind the last slash, before a bracket, without final # or dot."""
    rest = F.substring_index(F.substring_index(col(symbol), " ", -1), "/", -1)
    return F.regexp_replace(F.substring_index(F.regexp_replace(rest, r"\.$", ""), "(", 1), "#$", "")


def symbol_kind(symbol: Column | str) -> Column:
    """Kind by the descriptor that a symbol ends with."""
    s = col(symbol)
    return F.when(s.rlike(r"\)\.$"), "function").when(s.rlike("#$"), "struct").when(s.rlike("!$"), "macro").when(s.rlike(r"\.$") & s.contains("("), "function").otherwise("variable")


def exported(language: Column | str, name: Column | str) -> Column:
    """Go symbols with a capital first letter."""
    return ((col(language) == "go") & col(name).rlike(r"^\p{Lu}")).cast("long")


def visibility(signature: Column | str) -> Column:
    s = F.lower(F.coalesce(col(signature), F.lit("")))
    return F.when(s.contains("private"), "private").when(s.contains("protected"), "protected").otherwise("public")


def import_text(text: Column | str) -> Column:
    """An import statement's target: without its keyword, quotes and brackets."""
    t = F.trim(col(text))
    for word in ("#include", "import", "from"):
        t = F.trim(F.regexp_replace(t, f"^{word}", ""))
    return F.regexp_replace(t, "^[\"'<> ]+|[\"'<> ]+$", "")


def content_hash(content: Column | str) -> Column:
    """SHA-256 of a content's bytes in hexadecimal."""
    return F.sha2(col(content).cast("binary"), 256)


#: Kinds of symbols in an index by what they are here; others are variables.
INDEX_KINDS = {"interface": "interface", "class": "struct", "struct": "struct", "method": "method", "function": "function", "constructor": "function", "macro": "macro"}


def index_kind(kind: Column | str, symbol: Column | str) -> Column:
    """Kind of an index's symbol by its own kind, or by its descriptor where that is unspecified."""
    low = F.lower(F.trim(col(kind)))
    out = F.when(low.isNull() | low.isin("", "unspecified", "unspecifiedkind"), symbol_kind(symbol))
    for name, is_ in INDEX_KINDS.items():
        out = out.when(low == name, is_)
    return out.otherwise("variable")


#: Names to show of languages; others are shown as they are.
LANGUAGE_NAMES = {"go": "Go", "python": "Python", "typescript": "TypeScript", "java": "Java", "c": "C", "cpp": "C++", "cxx": "C++", "http": "HTTP"}


def language_name(language: Column | str) -> Column:
    out = F
    for code, name in LANGUAGE_NAMES.items():
        out = out.when(col(language) == code, name)
    return out.otherwise(col(language))


def id_prefix(language: Column | str) -> Column:
    """Prefix of ids of a language's symbols."""
    out = F
    for code, prefix in ID_PREFIXES.items():
        out = out.when(col(language) == code, prefix)
    return out.otherwise("unknown")


def safe_path_part(part: Column | str) -> Column:
    clean = F.regexp_replace(col(part), "[^A-Za-z0-9._-]", "_")
    return F.when(F.length(clean) == 0, "_").otherwise(clean)


def short_hash(text: Column | str) -> Column:
    """Polynomial hash of base 31 over code points, wrapped at 64 bits with a sign, modulo 1000 without one."""
    codes = F.transform(F.filter(F.split(col(text), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    half, low = F.lit(1 << 32), F.lit((1 << 32) - 1)

    def step(h: Column, c: Column) -> Column:  # in two halves, as a product of 64 bits would overflow
        right = h["right"] * 31 + c
        return F.struct(((h["left"] * 31 + F.floor(right / half)) % half).alias("left"), right.bitwiseAND(low).alias("right"))

    start = F.struct(F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"))
    whole = F.aggregate(codes, start, step, lambda h: F.shiftleft(h["left"], 32).bitwiseOR(h["right"]))
    return F.abs(whole % 1000)


def diagram_id(text: Column | str) -> Column:
    base = F.substring(F.regexp_replace(base_of(text), "[^A-Za-z0-9]", "_"), 1, 20)
    return F.concat(base, F.lit("_"), short_hash(text).cast("string"))
