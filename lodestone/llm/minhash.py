"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Weights. A document's features are its distinct shingles of five words (lower case). A shingle's weight is
(1 + ln tf) * (idf / ln 2)^IDF_POWER with idf = ln(1 + N / (1 + df)), rounded to a grid of STEPS steps an octave. df is
estimated over the whole table in one of BUCKETS counts, a table of fixed size: the documents with a shingle of the bucket,
less the mean of all buckets, which is what other shingles add, and 1 at least. Its standard error is the root of that mean,
so that with 300 shingles a document it is about 17 at 250,000 documents and 34,000 at 10^12. The power damps the idf:
without it the few words in which members of a large group differ would outweigh all they share (figures in the README).

Sampling (Ioffe's ICWS). For a feature of weight w and hash function k with r, c ~ Gamma(2, 1) and b ~ U(0, 1):
t = floor(ln w / r + b), ln a = ln c - r (t + 1 - b); the sample is the feature with the least a, and its t. Weights lie
on a grid and (r, c, b) come from a table of ROWS draws that the feature's hash under k points into, so ln a is one
look-up in a table of ranks by weight and row, and a sample is one 64-bit number, rank and feature hash.

Candidates. BANDS bands of ROWS_A_BAND samples. Texts that are equal are one from the start. In each bucket of a band
all members are compared with the least member. Members that are not joined with it by then are compared with the other
members of its buckets outside their component, but for those that an upper bound of their similarity rules out (see
`possible`). So every pair of different texts that shares a bucket is linked, joined by a chain of verified links, or shown
to be no link; no bucket's pairs are listed as a whole.

Verification computes the weighted Jaccard similarity of both whole texts, exactly.

Defined results: null and empty texts link with nothing; equal non-empty texts always link, with no words too; texts of
one to four words have one shingle of all their words; rows with a null id are left out; repeated ids each get their row,
and an id with several texts joins their classes. Ids are integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textkit
from lodestone.llm.common import Stages, broadcast_if_small
from lodestone.llm.components import connected_components
from lodestone.session import ship

SHINGLE = 5
SIMILARITY = 0.8
BUCKETS = 1 << 18
_BUCKET_SHIFT = np.uint64(64 - 18)
IDF_POWER = 0.1
BANDS, ROWS_A_BAND = 16, 4
ROWS = 1 << 15
STEPS = 16  # of weight an octave
LEVELS = 64


@cache
def sampling() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of ln a by weight level and row, shifted to the upper half of 64 bits; and two keys for each hash function."""
    rng = np.random.default_rng(1912)
    r, c, b = rng.gamma(2, 1, ROWS), rng.gamma(2, 1, ROWS), rng.random(ROWS)
    weight = np.arange(LEVELS)[:, None] * (math.log(2) / STEPS)
    t = np.floor(weight / r + b)
    ln_a = np.log(c) - r * (t + 1 - b)
    rank = np.unique(ln_a, return_inverse=True)[1].reshape(ln_a.shape).astype(np.uint64) << np.uint64(32)
    k = BANDS * ROWS_A_BAND
    return rank.ravel(), rng.integers(0, 2**32, k, dtype=np.uint32), rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    """Damped idf by bucket; df: documents with a shingle in each."""
    own = np.maximum(df - df.mean(), 1)
    return ((np.log1p(np.maximum(n, own + 1) / (1 + own)) / math.log(2)) ** IDF_POWER).astype(np.float32)


def levels(hashes: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weight level of each shingle: its weight is 2^(level / STEPS)."""
    weight = (1 + np.log(tf)) * idf[hashes >> _BUCKET_SHIFT]
    return np.clip(np.rint(np.log2(weight) * STEPS), 0, LEVELS - 1).astype(np.uint32)


def text_features(texts: pa.Array) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For blocks of texts the first one's position, and of each its distinct shingles in order with their counts."""
    data, offsets = textkit.utf8(textkit.lower(texts))
    for i, _, part, at in textkit.blocks(data, offsets):
        words, bounds = textkit.word_hashes(part, at)
        yield i, [np.unique(s, return_counts=True) for s in textkit.shingles(words, bounds, SHINGLE)]


def band_keys(features: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> list[np.ndarray]:
    """BANDS keys of each text with features, none of the others."""
    rank, xor, odd = sampling()
    sizes = np.array([len(h) for h, _ in features], np.int64)
    full = np.flatnonzero(sizes)
    out = [np.zeros(0, np.int64)] * len(features)
    if not len(full):
        return out
    hashes = np.concatenate([features[i][0] for i in full])
    level = levels(hashes, np.concatenate([features[i][1] for i in full]), idf) * np.uint32(ROWS)
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    point, name = (hashes >> np.uint64(16)).astype(np.uint32), hashes & np.uint64(0xFFFFFFFF)
    keys = np.zeros((BANDS, len(full)), np.uint64)
    shift = np.uint32(32 - 15)
    for k in range(BANDS * ROWS_A_BAND):
        code = rank[((point ^ xor[k]) * odd[k] >> shift) + level]
        code |= name
        keys[k // ROWS_A_BAND] = textkit.mix(keys[k // ROWS_A_BAND] + np.minimum.reduceat(code, starts) + np.uint64(k + 1))
    for i, column in zip(full, keys.T, strict=True):
        out[i] = column.astype(np.int64)
    return out


Weighted = tuple[np.ndarray, np.ndarray]


def common(a: Weighted, b: Weighted) -> tuple[np.ndarray, np.ndarray]:
    """Which of a's shingles b has, and the shared weight of each of these."""
    (x, wx), (y, wy) = a, b
    if not len(x) or not len(y):
        return np.zeros(len(x), bool), np.zeros(0)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = y[at] == x
    return both, np.minimum(wx[both], wy[at[both]])


def similarity(a: Weighted, b: Weighted) -> float:
    """Weighted Jaccard of two texts, each its shingles in order and their weights."""
    shared = float(common(a, b)[1].sum())
    total = float(a[1].sum()) + float(b[1].sum()) - shared
    return shared / total if total else 0.0


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents (id, text) with a shingle in each bucket, and the number of documents: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rows = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, features in text_features(batch.column(0)):
                found = [h >> _BUCKET_SHIFT for h, _ in features if len(h)]
                found = [b[np.concatenate([[True], b[1:] != b[:-1]])] for b in found]  # in order, so equal ones are neighbours
                if found:
                    count[:BUCKETS] += np.bincount(np.concatenate(found).astype(np.int64), minlength=BUCKETS)
        count[BUCKETS] = rows
        where = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(count[where])], ["bucket", "n"])

    got = docs.select("text").mapInArrow(textkit.tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return df[:BUCKETS], int(df[BUCKETS])


def sketches(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """id, a 128-bit hash of the text as two longs (null for empty texts), and the band keys."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.utf8(batch.column(1))
            view = memoryview(data)
            marks = [hashlib.blake2b(view[a:b], digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            keys = [k for _, features in text_features(batch.column(1)) for k in band_keys(features, shared.value)]
            half = [pa.array([m and int.from_bytes(m[s : s + 8], "little", signed=True) for m in marks], pa.int64()) for s in (0, 8)]
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *half, pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["id", "mark1", "mark2", "bands"])

    return docs.mapInArrow(textkit.tidy(run), "id long, mark1 long, mark2 long, bands array<long>")


def with_texts(pairs: DataFrame, n_pairs: int, docs: DataFrame) -> DataFrame:
    """a, b and both texts, for pairs (a, b) of ids of docs (id, text)."""
    needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = docs.join(broadcast_if_small(needed, 2 * n_pairs, 16), "id", "left_semi")
    joined = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return joined.select("a", "b", "text_a", "text_b")


def weighted_sides(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[tuple[Weighted, Weighted]]:
    """The weighted shingles of both texts of each row (a, b, text_a, text_b)."""
    sides = []
    for column in (batch.column(2), batch.column(3)):
        coded = column.dictionary_encode()  # each text of the batch once: many pairs share their second text
        texts, inverse = coded.dictionary, np.asarray(coded.indices)
        weights = [(h, np.exp2(levels(h, tf, idf) / STEPS)) for _, f in text_features(texts) for h, tf in f]
        sides.append((weights, inverse))
    (xs, xi), (ys, yi) = sides
    for i, j in zip(xi, yi, strict=True):
        yield xs[i], ys[j]


def verify(pairs: DataFrame, n_pairs: int, docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """a, b, similarity, the weight that their texts share, and the weight of a's."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in weighted_sides(batch, shared.value):
                both, own = float(common(x, y)[1].sum()), float(x[1].sum())
                total = own + float(y[1].sum()) - both
                rows.append((both / total if total else 0.0, both, own))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.float64()) for c in columns)], ["a", "b", "similarity", "shared", "weight"])

    return with_texts(pairs, n_pairs, docs).mapInArrow(textkit.tidy(run), "a long, b long, similarity double, shared double, weight double")


def outside(pairs: DataFrame, n_pairs: int, docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """a, b, and each shingle of a's text that b's doesn't have (b has less of), with the weight that it lacks."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, found, lacking = [], [], [], []
            for i, (x, y) in enumerate(weighted_sides(batch, shared.value)):
                both, weight = common(x, y)
                rest = x[1].copy()
                rest[both] -= weight
                where = np.flatnonzero(rest > 0)
                found.append(x[0][where].astype(np.int64))
                lacking.append(rest[where])
                a.append(np.full(len(where), i))
            if not a:
                continue
            at = pa.array(np.concatenate(a))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(found)), pa.array(np.concatenate(lacking))], ["a", "b", "shingle", "weight"])

    return with_texts(pairs, n_pairs, docs).mapInArrow(textkit.tidy(run), "a long, b long, shingle long, weight double")


def possible(placed: DataFrame, docs: DataFrame, idf: np.ndarray, threshold: float, stages: Stages) -> DataFrame:
    """Pairs that may link although neither's link to their buckets' least member b joins them.

    placed: a, b, similarity, shared, weight, and the components of_a and of_b. What x and y share is at most
    min(shared with b) + min(o(x), o(y)), where o is the weight that a text has beyond b's and that at least one other
    member of b's buckets has beyond b's too. That bounds each text's similarity with any other and each pair's; where
    copies were changed each in its own places, no pair is left.
    """
    groups = placed.groupBy("b").agg(F.count("*").alias("n"), F.max((F.col("of_a") != F.col("of_b")).cast("int")).alias("apart"))
    groups = groups.where("n > 1 and apart = 1").select("b")
    members = stages.write(placed.join(groups, "b", "left_semi"), "open")
    n_members = members.count()
    beyond = stages.write(outside(members.select("a", "b"), n_members, docs, idf), "beyond")
    twice = beyond.groupBy("b", "shingle").agg(F.count("*").alias("n")).where("n > 1").select("b", "shingle")
    also = beyond.join(twice, ["b", "shingle"]).groupBy("a", "b").agg(F.sum("weight").alias("beyond"))
    members = members.join(also, ["a", "b"], "left").withColumn("beyond", F.coalesce("beyond", F.lit(0.0)))
    t, slack = threshold, 1e-6
    alive = members.withColumn("most", (F.col("shared") + F.col("beyond")) * (1 + slack)).where(F.col("most") >= t * F.col("weight"))
    alive = stages.write(alive, "alive")

    def cell(weight):
        return F.floor(F.log(weight) / F.log(F.lit(1.02)))

    x = alive.where("of_a != of_b").select("b", *(F.col(c).alias(f"x_{c}") for c in ("a", "of_a", "shared", "weight", "beyond")), "most")
    heaviest = F.least(F.col("x_weight") / t, (1 + 1 / t) * F.col("most") - F.col("x_weight")) * (1 + slack)
    low, high = cell(F.col("x_weight") * t * (1 - slack)), cell(heaviest)
    x = x.where(heaviest > 0).where(high >= low).withColumn("cell", F.explode(F.sequence(low, high))).drop("most")
    y = alive.select("b", *(F.col(c).alias(f"y_{c}") for c in ("a", "of_a", "shared", "weight", "beyond")), cell(F.col("weight")).alias("cell"))
    most = (F.least("x_shared", "y_shared") + F.least("x_beyond", "y_beyond")) * (1 + slack)
    near = most >= t * (F.col("x_weight") + F.col("y_weight") - most)
    pairs = x.join(y, (x["b"] == y["b"]) & (x["cell"] == y["cell"]) & (F.col("x_of_a") != F.col("y_of_a")) & near)
    return pairs.select(F.greatest("x_a", "y_a").alias("a"), F.least("x_a", "y_a").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per row of docs with an id: id_col, class_id (the least id of its class) and kept (whether it is that one)."""
    spark = ship(docs.sparkSession)
    stages = Stages(spark)
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where("id is not null")
    idf = idf_table(*document_frequencies(docs))
    sketched = stages.write(sketches(docs, idf), "sketches")

    # Equal texts are one from here on, under their least id.
    groups = stages.write(sketched.where("mark1 is not null").groupBy("mark1", "mark2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min_by("bands", "id").alias("bands")), "groups")
    entries = groups.select(F.col("rep").alias("a"), F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.min("a").alias("b"), F.count("*").alias("members")).where("members > 1").drop("members")
    members = stages.write(entries.join(buckets, "bucket").where("a != b"), "members")
    stars = stages.write(members.select("a", "b").distinct(), "stars")
    scored = stages.write(verify(stars, stars.count(), docs, idf), "scored")
    links = scored.where(F.col("similarity") >= threshold).select("a", "b")
    first = connected_components(links, stages, "first")
    first = stages.write(first, "components")

    # Members that are still apart from their buckets' least member may link with one another.
    def component(df: DataFrame, column: str) -> DataFrame:
        named = first.select(F.col("id").alias(column), F.col("component").alias(f"of_{column}"))
        return df.join(named, column, "left").withColumn(f"of_{column}", F.coalesce(f"of_{column}", column))

    known = scored.groupBy("a", "b").agg(*(F.max(c).alias(c) for c in ("similarity", "shared", "weight")))
    placed = stages.write(component(component(known, "a"), "b"), "placed")
    rest = stages.write(possible(placed, docs, idf, threshold, stages), "rest")
    if more := rest.count():
        further = stages.write(verify(rest, more, docs, idf), "further").where(F.col("similarity") >= threshold).select("a", "b")
        links = links.unionByName(further)
        first = stages.write(connected_components(links, stages, "second"), "components2")

    stages.drop("members", "stars", "scored", "placed", "open", "beyond", "alive", "rest", "further")
    repeated = groups.where("copies > 1").select("mark1", "mark2", "rep")
    rows = sketched.select("id", "mark1", "mark2").join(repeated, ["mark1", "mark2"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    classes = rows.join(first.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return classes.select(F.col("id").alias(id_col), F.coalesce("component", "rep").alias("class_id")).withColumn("kept", F.col(id_col) == F.col("class_id"))
