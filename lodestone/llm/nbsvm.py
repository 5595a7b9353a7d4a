"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

A document's indicators are its distinct word unigrams and bigrams, runs of symbols, and whether a word stands two,
three and six times running, hashed to a fixed number of dimensions. Each indicator is scaled by its log-count ratio
between the classes; a linear hinge-loss model is then fitted by dual coordinate descent and calibrated on labelled rows
that it was not fitted to.

The model is fitted on the driver to at most SAMPLE labelled rows, those with the least hash of their id, and of these to as
many as have SAMPLE_BYTES of indicators together; of rows with one id the least text alone is learnt from, so that no id can use
up the sample. A row's indicators are computed on the executors over its whole text. Every document is then scored in one
pass without a shuffle.

Defined results: null and empty texts are scored from the bias alone; repeated rows each get their row; a document with
several labels counts with the lowest; without labelled rows of both classes every score is the share of label 1, or
0.5 without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import linear, textkit
from lodestone.llm.common import Stages
from lodestone.session import ship

#: Labelled rows that the model is fitted to, at most.
SAMPLE = 6000
#: Bytes of indicators (4 each) that the driver fetches, at most.
SAMPLE_BYTES = 256 << 20
DIMS = 1 << 18
_SHIFT = np.uint64(64 - 18)
_SALT = np.arange(1, 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = ~(textkit.WORD_BYTES | (np.arange(256) <= 32))


def indicators(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of documents: the first one's position, offsets of each document's indicators, and the indicators."""
    data, offsets = textkit.utf8(textkit.lower(texts))
    for i, j, part, at in textkit.blocks(data, offsets):
        words, bounds = textkit.word_hashes(part, at, textkit.TOKEN_BYTES)
        n = j - i
        doc = np.repeat(np.arange(n), np.diff(bounds))
        keys, docs = [words ^ _SALT[0]], [doc]
        pairs, to = textkit.grams(words, bounds, 2)
        keys.append(pairs ^ _SALT[1])
        docs.append(np.repeat(np.arange(n), np.diff(to)))
        for k, times in enumerate((2, 3, 6)):
            same = np.ones(max(len(words) - times + 1, 0), bool)
            for s in range(1, times):
                same &= (words[s : len(same) + s] == words[: len(same)]) & (doc[s : len(same) + s] == doc[: len(same)])
            where = np.flatnonzero(same)
            keys.append(np.full(len(where), _SALT[2 + k]))
            docs.append(doc[where])
        if len(part) >= 2:
            both = np.flatnonzero(_SYMBOL[part[:-1]] & _SYMBOL[part[1:]])
            of = np.searchsorted(at, both, "right") - 1
            inside = both + 1 < at[of + 1]
            both, of = both[inside], of[inside]
            keys.append((part[both].astype(np.uint64) * np.uint64(256) + part[both + 1].astype(np.uint64) + np.uint64(1)) * _SALT[6])
            docs.append(of)
        flat = np.concatenate(docs).astype(np.uint64) << np.uint64(18) | textkit.mix(np.concatenate(keys)) >> _SHIFT
        flat = np.unique(flat)
        yield i, np.searchsorted(flat >> np.uint64(18), np.arange(n + 1, dtype=np.uint64)), (flat & np.uint64(DIMS - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # of each indicator, its log-count ratio included
    bias: float
    slope: float
    shift: float

    def margins(self, at: np.ndarray, found: np.ndarray) -> np.ndarray:
        n = np.diff(at)
        total = np.bincount(np.repeat(np.arange(len(n)), n), self.weights[found], minlength=len(n))
        return total / np.sqrt(np.maximum(n, 1)) + self.bias

    def scores(self, at: np.ndarray, found: np.ndarray) -> np.ndarray:
        return linear.sigmoid(self.slope * self.margins(at, found) + self.shift)


def fit(rows: list[np.ndarray], labels: np.ndarray, *, cost: float = 1.0, smoothing: float = 1.0) -> Model:
    """The model of labelled rows of indicators; a fifth of them calibrates it."""
    labels = np.asarray(labels, float)
    if not 0 < labels.sum() < len(labels):
        share = (labels.mean() if len(labels) else 0.5).clip(1e-3, 1 - 1e-3) if len(labels) else 0.5
        return Model(np.zeros(DIMS), 0.0, 1.0, float(np.log(share / (1 - share))))
    held = np.arange(len(rows)) % 5 == 4
    if len({*labels[held]}) < 2 or len({*labels[~held]}) < 2:
        held[:] = False
    used = np.flatnonzero(~held)
    count = [np.full(DIMS, smoothing), np.full(DIMS, smoothing)]
    for i in used:
        count[int(labels[i])][rows[i]] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    ratio[count[0] + count[1] < 2 * smoothing + 2] = 0  # what one row alone has tells nothing of others
    data = linear.Rows.of([(rows[i], ratio[rows[i]] / np.sqrt(max(len(rows[i]), 1))) for i in used])
    weights, bias = linear.svm(data, np.where(labels[used] > 0, 1.0, -1.0), DIMS, cost=cost)
    model = Model(weights * ratio, bias, 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else used
    at = np.concatenate([[0], np.cumsum([len(rows[i]) for i in check])]).astype(np.int64)
    model.slope, model.shift = linear.platt(model.margins(at, np.concatenate([rows[i] for i in check])), labels[check])
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, cost: float = 1.0) -> Model:
    """Fits the model to at most sample labelled rows. labels: id and label 0 or 1; other labels and null ids are left out."""
    ship(docs.sparkSession)
    key = labels.schema[id_col].dataType.simpleString()
    chosen = (
        labels.select(labels[id_col].cast(key).alias("id"), labels[label_col].cast("int").alias("label"))
        .where("id is not null and label in (0, 1)")
        .groupBy("id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, at, found in indicators(batch.column(1)):
                rows += [found[at[k] : at[k + 1]].astype(np.int32).tobytes() for k in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["id", "label", "found"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id")
    picked = picked.groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = Stages(docs.sparkSession).write(picked.select("id", "text", "label").mapInArrow(textkit.tidy(run), f"id {key}, label int, found binary"), "labelled")
    sizes = rows.select("id", F.octet_length("found").cast("long").alias("bytes"))  # at most sample rows
    within = sizes.withColumn("upto", F.sum("bytes").over(Window.orderBy(F.xxhash64("id"), "id"))).where(F.col("upto") <= SAMPLE_BYTES).select("id")
    got = rows.join(F.broadcast(within), "id").toPandas()
    got = got.sort_values("id")
    return fit([np.frombuffer(x, np.int32).astype(np.int64) for x in got["found"]], got["label"].to_numpy(), cost=cost)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns id_col and keep as they are, and score: the probability of label 1."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)
    kept = [id_col, *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            scores = [own.scores(at, found) for _, at, found in indicators(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*(f"c{i}" for i in range(len(kept))), "score"])

    slim = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(kept)), docs[text_col].alias("text"))
    types = ", ".join(f"c{i} {slim.schema[i].dataType.simpleString()}" for i in range(len(kept)))
    out = slim.mapInArrow(textkit.tidy(run), f"{types}, score double")
    return out.select(*(out[f"c{i}"].alias(c) for i, c in enumerate(kept)), "score")
