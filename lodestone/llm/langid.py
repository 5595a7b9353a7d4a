"""Language identification in two levels: the family first, then one-versus-one linear models within it.

A document's features are the shares of its letter bigrams and trigrams (bytes of the text, ASCII letters folded to one
case, other ASCII characters taken as one separator). A model's margin is then a mean of weights over the text's
positions, so that scoring is two table look-ups a byte and model, over the whole text.

The models are linear hinge-loss models fitted by dual coordinate descent to at most SAMPLE rows a language, those whose
id's hash falls under a bound set by the language's count; features of the sample are computed on the executors. Of the
values of the language column the LANGUAGES most frequent are learnt (of equally frequent ones the least), so that a column
full of misspellings stays a bounded sample, and the models of all pairs of them take at most 260 MB. Rows of one id count as
one, the least by language and text; the driver fetches features of SAMPLE_BYTES at most, the same for each language.

Defined results: und with score 0 for null texts and texts without a letter, and when nothing could be learnt; of families
and languages that a text fits equally well the first by name is taken; repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import linear, textkit
from lodestone.llm.common import Stages
from lodestone.session import ship

#: Rows a language that the models are fitted to, about.
SAMPLE = 500
#: Bytes of features that the driver fetches, at most.
SAMPLE_BYTES = 256 << 20
#: Languages that are learnt, at most.
LANGUAGES = 32
DIMS = 1 << 17
#: Language codes by family. A language of no listed family is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "gu", "pa", "ne"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}

_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def positions(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the feature of the bigram and of the trigram that end there; a block starts after two separators."""
    codes = np.full(len(part) + 2, 32, np.uint32)
    codes[2:] = _FOLD[part]
    two = codes[1:-1] << np.uint32(8) | codes[2:]
    three = (codes[:-2] << np.uint32(16) | two) * np.uint32(2654435761)
    return two.astype(np.int64), (three >> np.uint32(16)).astype(np.int64) + 65536


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse features of each text: indices, and shares scaled to a length of about one."""
    data, offsets = textkit.utf8(texts)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        total = np.zeros(DIMS)
        for x in range(a, b, textkit.BLOCK_BYTES):
            y = min(b, x + textkit.BLOCK_BYTES)
            lead = min(2, x - a)
            for found in positions(data[x - lead : y]):
                total += np.bincount(found[lead:], minlength=DIMS)
        where = np.flatnonzero(total)
        out.append((where, total[where] * (SCALE / max(b - a, 1))))
    return out


#: Factor of the shares: features of shares are short vectors, and the cost of the fit is set for length one.
SCALE = 10.0


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    outer: list[tuple[np.ndarray, float]] = field(default_factory=list)  # a family against the rest, in order
    inner: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """A language for each text and its score."""
        models = [*self.outer, *self.inner.values()]
        data, offsets = textkit.utf8(texts)
        n = len(offsets) - 1
        margins, letters = np.zeros((len(models), n)), np.zeros(n, bool)
        for i, j, part, at in textkit.blocks(data, offsets):
            if len(part) == 0:
                continue
            letters[i:j] = np.diff(np.concatenate([[0], np.cumsum(_LETTER[part])])[at]) > 0
            full = np.flatnonzero(np.diff(at))
            two, three = positions(part)
            for a in (0, 1):  # a document's first two bytes stand after separators too
                head = at[full] + a
                head = head[head < at[full + 1]]
                prior = np.full(len(head), 32, np.int64) if a == 0 else _FOLD[part[head - 1]].astype(np.int64)
                now = _FOLD[part[head]].astype(np.int64)
                two[head] = prior << 8 | now
                code = (np.uint32(32) << np.uint32(16) | two[head].astype(np.uint32)) * np.uint32(2654435761)
                three[head] = (code >> np.uint32(16)).astype(np.int64) + 65536
            size = np.diff(at)[full]
            for k, (weights, _) in enumerate(models):
                margins[k, i + full] = np.add.reduceat(weights[two] + weights[three], at[full], dtype=np.float64) * SCALE / size
        for k, (_, bias) in enumerate(models):
            margins[k] += bias
        for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
            letters[i] = any(c.isalpha() for c in texts[int(i)].as_py())
        return self._decide(margins, letters)

    def _decide(self, margins: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(letters)
        if not self.families:
            return ["und"] * n, np.zeros(n)
        outer = margins[: len(self.outer)] if self.outer else np.zeros((1, n))
        best = outer.argmax(axis=0)
        sure = linear.sigmoid(4 * outer.max(axis=0)) if self.outer else np.ones(n)
        at = {pair: len(self.outer) + k for k, pair in enumerate(self.inner)}
        langs = np.empty(n, object)
        for f, name in enumerate(self.families):
            own, langs_of = np.flatnonzero(best == f), self.members[name]
            votes, strength = np.zeros((len(langs_of), len(own))), np.zeros((len(langs_of), len(own)))
            for x, y in combinations(range(len(langs_of)), 2):
                m = margins[at[langs_of[x], langs_of[y]], own]
                votes[x] += m >= 0
                votes[y] += m < 0
                strength[x] += m
                strength[y] -= m
            pick = (votes + 1e-3 * np.tanh(strength)).argmax(axis=0)
            langs[own] = np.array(langs_of, object)[pick]
            if len(langs_of) > 1:
                sure[own] *= linear.sigmoid(4 * strength[pick, np.arange(len(own))] / (len(langs_of) - 1))
        langs[~letters], sure[~letters] = "und", 0.0
        return list(langs), sure


def fit(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], *, cost: float = 10.0) -> Model:
    model = Model()
    if not rows:
        return model
    data, langs = linear.Rows.of(rows), np.array(langs, object)
    of = np.array([family(x) for x in langs], object)
    model.families = sorted(set(of))
    if len(model.families) > 1:
        for name in model.families:
            weights, bias = linear.svm(data, np.where(of == name, 1.0, -1.0), DIMS, cost=cost)
            model.outer.append((weights.astype(np.float32), bias))
    for name in model.families:
        model.members[name] = sorted(set(langs[of == name]))
        for x, y in combinations(model.members[name], 2):
            which = np.flatnonzero((langs == x) | (langs == y))
            weights, bias = linear.svm(data.take(which), np.where(langs[which] == x, 1.0, -1.0), DIMS, cost=cost)
            model.inner[x, y] = weights.astype(np.float32), bias
    return model


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """Fits the models to about sample rows of each of the most frequent languages; rows without language, text or id are left out."""
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), docs[text_col].alias("text")).where("id is not null and lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return Model()
    whole = 1 << 30
    bound = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(whole, int(whole * sample / n) + 1))))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(whole)) < bound[F.col("lang")])
    picked = picked.groupBy("id").agg(F.min(F.struct("lang", "text")).alias("least")).select("id", "least.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["id", "lang", "indices", "shares"])

    key = rows.schema["id"].dataType.simpleString()
    found = Stages(docs.sparkSession).write(picked.mapInArrow(textkit.tidy(run), f"id {key}, lang string, indices binary, shares binary"), "learnt")
    sizes = found.select("id", "lang", (F.octet_length("indices") + F.octet_length("shares")).cast("long").alias("bytes"))  # about sample rows a language
    upto = F.sum("bytes").over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    within = sizes.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES // len(counts)).select("id")
    got = found.join(within, "id", "left_semi").toPandas().sort_values(["lang", "id"])
    return fit([(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v)) for i, v in zip(got["indices"], got["shares"], strict=True)], list(got["lang"]))


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, lang_pred and score of every row."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    key = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(textkit.tidy(run), f"id {key}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
