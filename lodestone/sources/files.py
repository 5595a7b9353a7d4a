"""Files as DataFrames: trees of sources, verdicts, compile commands, stored documents, commit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.globs import PathFilter
from lodestone.functions.predicates import INDEX_EXTENSIONS, extension_of, language_of, skipped_directory

VERDICT = "rule_id string, symbol_id string, decision string, description string, suggestion string, operator string"


def tree(spark: SparkSession, root: str, rule: PathFilter | None = None, stage: str | None = None) -> DataFrame:
    """path (from the root), text, content_hash, language, size and modified_at of all source files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/" if ":" in root.split("/")[0] else root.rstrip("/") + "/"
    named = raw.select(F.substring(full, F.lit(len(base) + 1), F.length(full)).alias("path"), "content", "length", "modificationTime")
    own = named.where(extension_of("path").isin(*INDEX_EXTENSIONS) & ~skipped_directory("path"))
    own = own.where(rule.allows(F.col("path"), stage)) if rule else own
    cpp = own.agg(F.coalesce(F.max(extension_of("path").isin(".cpp", ".cc", ".cxx", ".hpp", ".hxx")), F.lit(False)).alias("cpp"))
    joined = own.crossJoin(F.broadcast(cpp))  # one row
    return joined.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("content_hash"), language_of("path", F.col("cpp")).alias("language"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified_at"))


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of verdict files: an array of findings, or a map from symbol to finding."""
    text = spark.read.option("wholetext", True).text(path)
    listed = text.where(F.trim("value").startswith("[")).select(F.inline(F.from_json("value", f"array<struct<{_struct()}>>")))
    mapped = text.where(F.trim("value").startswith("{")).select(F.explode(F.from_json("value", f"map<string,struct<{_struct()}>>")).alias("key", "v"))
    names = [c.split()[0] for c in VERDICT.split(", ")]
    keyed = mapped.select(*(F.col("key").alias(n) if n == "symbol_id" else F.col(f"v.{n}").alias(n) for n in names))
    return listed.select(*names).unionByName(keyed)


def _struct() -> str:
    return ",".join(c.replace(" ", ":") for c in VERDICT.split(", "))


def compile_commands(spark: SparkSession, path: str, rule: PathFilter | None = None, lines: bool = False) -> DataFrame:
    """directory, file and command of the entries that have them all and that a filter allows; of a file with one array, or with
    an entry a line."""
    raw = spark.read.schema("directory string, file string, command string, arguments array<string>").option("multiLine", not lines).json(path)
    full = raw.withColumn("command", F.coalesce("command", F.array_join("arguments", " "))).where("directory is not null and file is not null and command is not null")
    return full.where(rule.allows(F.col("file"))).select("directory", "file", "command") if rule else full.select("directory", "file", "command")


def rewrite_compile_commands(spark: SparkSession, path: str, target: str, rule: PathFilter, lines: bool = False) -> int:
    """Writes the entries that are valid and allowed to another folder, as the same kind of file; how many there are."""
    kept = compile_commands(spark, path, rule, lines)
    if lines:
        kept.write.mode("overwrite").json(target)
    else:  # the entries of one file
        kept.coalesce(1).agg(F.to_json(F.collect_list(F.struct("directory", "file", "command"))).alias("value")).write.mode("overwrite").text(target)
    return kept.count()


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """type, key, content, timestamp of stored documents, the newest first; what isn't one is left out."""
    found = spark.read.schema("type string, key string, content string, timestamp string").option("recursiveFileLookup", True).option("mode", "PERMISSIVE").json(path)
    return found.where("type is not null and key is not null and timestamp is not null").orderBy(F.desc("timestamp"), "type", "key")


def save_document(spark: SparkSession, path: str, type_: str, key: str, content: str, timestamp: str) -> str:
    """Adds a version of a document under a folder; versions of one time get a number. Returns the version's name."""
    folder = f"{path}/{type_}/{''.join(c if c.isalnum() or c in '._-' else '_' for c in key) or '_'}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stamp, n = timestamp, 1
    while jvm.org.apache.hadoop.fs.Path(f"{folder}/{stamp}").getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{stamp}")):
        n += 1
        stamp = f"{timestamp}-{n:02}"
    row = spark.createDataFrame([(type_, key, content, timestamp)], "type string, key string, content string, timestamp string")
    row.coalesce(1).write.json(f"{folder}/{stamp}")
    return stamp


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """author, path and ts from a log with a line `author<TAB>epoch<TAB>path` for each file of each commit."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(parts) >= 3)
    return rows.select(F.get(parts, 0).alias("author"), F.get(parts, 2).alias("path"), F.get(parts, 1).cast("long").alias("ts"))
