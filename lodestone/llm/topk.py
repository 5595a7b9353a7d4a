"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is one or more 64-bit words, cut into m segments. If two codes differ in at most m (r + 1) - 1 bits, they differ in at
most r bits in one segment at least. So a query looks up its segments at radius 0, 1, 2, ... and verifies what it meets; once
all segments were looked up to radius r, everything within m (r + 1) - 1 bits has been verified, and the search is over as
soon as the kth verified distance is no more than that.

The index is one table over all rows, a row for each code and segment, keyed by the segment and its value. Each step sends
the probes of the queries that are still open, the values that differ from theirs in r bits, to that table in an equi-join,
and verifies the distance where they meet; queries that are covered send no more. A pair that several segments would find is
taken in the one that finds it first. A segment has about as many bits as the number of codes has, so that a value has few
codes and all probes of a query together are no more than m times the codes. Everything is DataFrame operations.

Equal codes, of rows and of queries, are one in the index, with the k + 1 least ids: no more of one code can be among a
query's k nearest and itself. So a code that a third of all rows have is one row.

Defined results: rows with a null id or code, or with a null word, are neither queries nor neighbours; codes with different
numbers of words are not compared; a query is no neighbour of its own; ties in distance go to the lesser id; with fewer than
k other rows all are returned; rows of one id are one, the one with the least code; a query need not be a row.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lodestone.llm.common import Stages, broadcast_if_small
from lodestone.session import ship

#: Segments of a word, at least and at most.
FEWEST, MOST = 2, 8


def sign_code(vector: Column) -> Column:
    """The code of a vector: bit j of word w is whether component 64 w + j is above 0. Null if a component is null or NaN."""
    usable = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))

    def word(w: Column) -> Column:
        bits = F.transform(F.slice(vector, w * 64 + 1, F.lit(64)), lambda x, j: F.when(x > 0, _bit(j)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    words = F.transform(F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / 64).cast("int")), word)
    return F.when(usable, words)


def _bit(j: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), j.cast("int"))


def per_word(codes: int) -> int:
    """Segments of a word: each has about as many bits as the number of codes."""
    return min(MOST, max(FEWEST, round(64 / math.log2(max(codes, 2)))))


def widths(per: int) -> list[int]:
    return [64 // per + (s < 64 % per) for s in range(per)]


def segments(code: Column, per: int, words: int) -> Column:
    """An array of (segment, width, value) of a code of up to so many words."""
    out, at = [], 0
    for s, width in enumerate(widths(per)):
        part = lambda w, at=at, width=width: F.shiftrightunsigned(F.element_at(code, w + 1), at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out += [F.when(F.size(code) > w, F.struct(F.lit(w * per + s).alias("segment"), F.lit(width).alias("width"), part(w).alias("value"))) for w in range(words)]
        at += width
    return F.array_compact(F.array(*out))


def far_in(a: Column, b: Column, per: int, words: int, upto: Column) -> Column:
    """(least radius, first segment with it) in which codes a and b differ, over segments; with all segments, whatever upto."""
    found, at = [], 0
    for s, width in enumerate(widths(per)):
        part = lambda c, w, at=at, width=width: F.shiftrightunsigned(F.element_at(c, w + 1), at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        found += [F.when(upto > w, F.bit_count(part(a, w).bitwiseXOR(part(b, w))) * F.lit(1 << 20) + F.lit(w * per + s)) for w in range(words)]
        at += width
    return F.least(*found)


def distance(a: Column, b: Column, words: int) -> Column:
    of = lambda w: F.bit_count(F.element_at(a, w + 1).bitwiseXOR(F.element_at(b, w + 1)))
    return sum((F.when(F.size(a) > w, of(w)).otherwise(0) for w in range(1, words)), of(0)).cast("long")


def masks(spark: SparkSession, kinds: list[int], radius: int) -> tuple[DataFrame, int]:
    """(width, mask): all values of segments of these widths with radius bits set; and how many."""
    width, mask = [], []
    for w in kinds:
        some = np.array([sum(1 << i for i in c) for c in combinations(range(w), radius)], np.int64)
        width.append(np.full(len(some), w, np.int32))
        mask.append(some)
    frame = pd.DataFrame({"width": np.concatenate(width), "mask": np.concatenate(mask)})
    return spark.createDataFrame(frame, "width int, mask long"), len(frame)


def once(df: DataFrame, id_col: str, code_col: str) -> DataFrame:
    """One row for each id with a code: id and code, an array of words."""
    code = df[code_col].cast("array<long>") if isinstance(df.schema[code_col].dataType, ArrayType) else F.when(df[code_col].isNotNull(), F.array(df[code_col].cast("long")))
    pair = df.select(df[id_col].cast("long").alias("id"), code.alias("code")).where("id is not null and code is not null and size(code) > 0 and forall(code, x -> x is not null)")
    return pair.groupBy("id").agg(F.min("code").alias("code"))


def gathered(rows: DataFrame, k: int) -> DataFrame:
    """Distinct codes of rows (id, code): code, rows, the least k + 1 ids in order, and the least of all."""
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    ids = ranked.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return ids.select("code", "ids", F.size("ids").cast("long").alias("rows"), F.element_at("ids", 1).alias("first"))


def top_k(codes: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", code_col: str = "code") -> DataFrame:
    """query_id, rank (from 1), neighbor_id and distance: for each query its k nearest rows of codes by Hamming distance.

    codes, queries: integer id and code, a 64-bit number or an array of them.
    """
    spark = ship(codes.sparkSession)
    stages = Stages(spark)
    known = stages.write(gathered(once(codes, id_col, code_col), k), "codes")
    asked = stages.write(once(queries, id_col, code_col), "queries")
    n, words = known.agg(F.count("*"), F.max(F.size("code"))).first()
    if not n:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).cast("long").alias("rank"), F.col("id").alias("neighbor_id"), F.lit(0).cast("long").alias("distance")).limit(0)
    per = per_word(n)
    exploded = known.select("code", "first", "rows", F.explode(segments(F.col("code"), per, words)).alias("part"))
    index = stages.write(exploded.select("part.segment", "part.value", F.col("code").alias("there"), "first", "rows"), "index")

    open_ = stages.write(asked.select("code").distinct(), "open-0")
    best, n_open, radius = None, open_.count(), 0
    order = Window.partitionBy("code").orderBy("distance", "first")
    while n_open and radius <= max(widths(per)):
        kinds, n_masks = masks(spark, sorted({w for w in widths(per) if w >= radius}), radius)
        parts = open_.select("code", F.explode(segments(F.col("code"), per, words)).alias("part")).select("code", "part.segment", "part.width", "part.value")
        probes = parts.join(broadcast_if_small(kinds, n_masks, 16), "width").select("code", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        here = F.lit(radius * (1 << 20)) + F.col("segment")
        met = probes.join(index, ["segment", "value"]).where(F.size("code") == F.size("there"))
        met = met.where(far_in(F.col("code"), F.col("there"), per, words, F.size("code")) == here)
        new = met.select("code", "there", "first", "rows", distance(F.col("code"), F.col("there"), words).alias("distance"))
        # Of each query the k + 1 nearest codes, ties by their least id: one of their rows may be the query itself.
        every = new if best is None else new.unionByName(best)
        best = stages.write(every.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n"), f"best-{radius}")
        covered = F.size("code") * per * (radius + 1) - 1
        done = best.where(F.col("distance") <= covered).groupBy("code").agg(F.sum("rows").alias("rows")).where(F.col("rows") > k).select("code")
        open_ = stages.write(open_.join(done, "code", "left_anti"), f"open-{radius + 1}")
        n_open = open_.count()
        radius += 1

    found = asked.join(best, "code").join(known.select(F.col("code").alias("there"), "ids"), "there")
    found = found.select(F.col("id").alias("query_id"), "distance", F.explode("ids").alias("neighbor_id")).where("query_id != neighbor_id")
    nearest = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", "distance")
