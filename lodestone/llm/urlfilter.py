"""URL filters by a sorted digest array.

A rule is a host and a path; it fits the host and all its subdomains where the URL's path starts with the rule's path, and
the longest rule that fits wins (by host and path together, then by host). Rules are kept as one file: their 64-bit
xxhash keys in order, and in the same order their full strings. Executors map that file into memory. A batch of URLs is
turned into the strings that could be rules for it (each suffix of the host with each prefix of the path, if some rule has a
host and a path of just these lengths), all their keys are sought by one vectorised binary search, and a hit counts only if
the stored string is the same, so that colliding keys do no harm. A URL has no more such strings than the rules have pairs
of lengths, however long it is and however many dots its host has.

The file is made on the driver if the rules need at most MAX_BYTES there, which is counted before any is fetched; beyond that
`judge_by_join` gives the same rows from an equi-join on the digests.

Defined results: a null URL or one without :// has an empty host and path and no rule; URLs without rule get the default
verdict; equal rules count once, the first in order of verdict; rules with a null are left out; a rule with an empty host
fits only what has an empty host; repeated rows each get their row.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Stages, broadcast_if_small
from lodestone.session import ship

#: Bytes that the rules' strings may need on the driver, with ROW_BYTES for each beside its characters.
MAX_BYTES, ROW_BYTES = 256 << 20, 600
SEED = 42  # Spark's own xxhash64 of a string is this digest with this seed
ALLOW, BLOCK = "allow", "block"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


class Digests:
    """Rules in a mapped file: keys in order, string ends, verdicts, pairs of lengths, then the strings."""

    def __init__(self, path: str):
        self.keys, self.ends, self.allows, self.lengths, self.texts = (np.memmap(path, d, "r", o, (n,)) if n else np.zeros(0, d) for d, o, n in self._parts(path))

    @staticmethod
    def _parts(path: str):
        n, m, size = np.fromfile(path, np.int64, 3)
        at = 24
        for d, k in ((np.uint64, n), (np.int64, n), (np.uint8, n), (np.int32, 2 * m), (np.uint8, size)):
            yield d, int(at), int(k)
            at += np.dtype(d).itemsize * int(k)

    @staticmethod
    def write(rules: list[tuple[str, str, str]], path: str) -> None:
        """rules: host, path, verdict."""
        once: dict[str, bool] = {}
        for host, tail, verdict in sorted(rules, key=lambda r: (r[0], r[1], r[2])):
            once.setdefault(host + "\n" + tail, verdict == ALLOW)
        strings = [s.encode() for s in once]
        keys = np.array([xxhash.xxh64_intdigest(s, SEED) for s in strings], np.uint64)
        order = np.argsort(keys, kind="stable")
        allows = list(once.values())
        lengths = np.array(sorted({(len(host), len(tail)) for host, tail, _ in rules}), np.int32)
        texts = b"".join(strings[i] for i in order)
        with open(path, "wb") as f:
            f.write(np.array([len(keys), len(lengths), len(texts)], np.int64).tobytes())
            for part in (keys[order], np.cumsum([len(strings[i]) for i in order]).astype(np.int64), np.array([allows[i] for i in order], np.uint8), lengths, np.frombuffer(texts, np.uint8)):
                f.write(part.tobytes())

    def text(self, i: int) -> bytes:
        return bytes(self.texts[self.ends[i - 1] if i else 0 : self.ends[i]])

    def find(self, strings: list[bytes]) -> np.ndarray:
        """Position of each string, or -1."""
        out = np.full(len(strings), -1, np.int64)
        if not strings or not len(self.keys):
            return out
        keys = np.array([xxhash.xxh64_intdigest(s, SEED) for s in strings], np.uint64)
        at = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys)
        for i in hit[at[hit] < len(self.keys)]:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:
                if self.text(k) == strings[i]:
                    out[i] = k
                    break
                k += 1
        return out


def by_host_length(lengths: np.ndarray) -> dict[int, list[int]]:
    """The lengths of rules' paths for each length of their hosts."""
    out: dict[int, list[int]] = {}
    for host, path in lengths.reshape(-1, 2).tolist():
        out.setdefault(host, []).append(path)
    return out


def candidates(host: str, path: str, lengths: dict[int, list[int]]) -> list[str]:
    """Strings of the rules that could fit, longest first."""
    suffixes = [host] if len(host) in lengths else []
    at = host.find(".", max(0, len(host) - 1 - max(lengths, default=0)))
    while at >= 0:
        if len(host) - at - 1 in lengths:
            suffixes.append(host[at + 1 :])
        at = host.find(".", at + 1)
    found = [(len(s) + n, len(s), s + "\n" + path[:n]) for s in suffixes if s or not host for n in lengths[len(s)] if n <= len(path)]
    return [x[2] for x in sorted(found, reverse=True)]


def ship_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """The name of the rules' file, which every executor, later ones included, gets from the driver."""
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), f"rules-{uuid.uuid4().hex}")
    Digests.write(rules, path)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


_mapped: dict[str, Digests] = {}


def mapped(name: str) -> Digests:
    if name not in _mapped:
        _mapped[name] = Digests(SparkFiles.get(name))
    return _mapped[name]


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """id_col, host, path, rule (host and path of the rule that decides, else null) and verdict of each row.

    rules: columns host, path, verdict (allow or block).
    """
    spark = ship(pages.sparkSession)
    listed = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
    size = listed.agg(F.sum(F.octet_length("host") + F.octet_length("path") + ROW_BYTES)).first()[0] or 0
    if size > MAX_BYTES:
        return judge_by_join(pages, rules, id_col=id_col, url_col=url_col, default=default)
    name = ship_rules(spark, [tuple(r) for r in listed.collect()] if size else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = mapped(name)
        lengths = by_host_length(own.lengths)
        for batch in batches:
            asked, whose = [], []
            for i, (host, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                strings = candidates(host, path, lengths)
                asked += [s.encode() for s in strings]
                whose += [i] * len(strings)
            found = own.find(asked)
            rule, verdict = [None] * batch.num_rows, [default] * batch.num_rows
            for k in np.flatnonzero(found >= 0)[::-1]:  # the longest comes first, so it is written last
                rule[whose[k]] = asked[k].decode().replace("\n", "", 1)
                verdict[whose[k]] = ALLOW if own.allows[found[k]] else BLOCK
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    host, path = split_url(pages[url_col])
    key = pages.schema[id_col].dataType.simpleString()
    out = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path")).mapInArrow(run, f"id {key}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


def judge_by_join(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """As judge, for any number of rules: each URL's candidate strings meet the rules in an equi-join on digest and string."""
    stages = Stages(ship(pages.sparkSession))
    listed = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    listed = stages.write(listed.withColumn("string", F.concat("host", F.lit("\n"), "path")).withColumn("key", F.xxhash64("string")), "rules")
    pairs = stages.write(listed.select(F.length("host").alias("host_length"), F.length("path").alias("path_length")).distinct(), "pairs")
    n_pairs, longest = pairs.agg(F.count("*"), F.max("host_length")).first()
    host, path = split_url(pages[url_col])
    # The row's number is written: it is read on both sides of a join.
    rows = stages.write(pages.select(F.monotonically_increasing_id().alias("row"), pages[id_col].alias("id"), host.alias("host"), path.alias("path")), "rows")
    # No suffix longer than the longest rule's host: only the host's end is looked at, and the host as a whole if it is no longer.
    end = F.substring("host", F.greatest(F.lit(1), F.length("host") - F.lit(longest or 0)), F.length("host"))
    labels = F.split(end, r"\.")
    after = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    after = F.when(F.size(labels) > 1, F.filter(after, lambda s: s != "")).otherwise(F.array().cast("array<string>"))
    suffixes = F.when(F.length("host") <= F.lit(longest or 0), F.concat(F.array("host"), after)).otherwise(after)
    tried = rows.select("row", "path", F.explode(suffixes).alias("suffix")).withColumn("host_length", F.length("suffix"))
    tried = tried.join(broadcast_if_small(pairs, n_pairs, 16), "host_length").where(F.col("path_length") <= F.length("path"))
    tried = tried.withColumn("prefix", F.expr("substring(path, 1, path_length)")).withColumn("string", F.concat("suffix", F.lit("\n"), "prefix")).withColumn("key", F.xxhash64("string"))
    hits = tried.join(listed.select("key", "string", "verdict"), ["key", "string"])
    order = F.struct(F.length("suffix") + F.length("prefix"), F.length("suffix"))
    best = hits.groupBy("row").agg(F.max_by(F.struct(F.concat("suffix", "prefix").alias("rule"), "verdict"), order).alias("best"))
    return rows.join(best, "row", "left").select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
