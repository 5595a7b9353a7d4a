"""Mixing documents to target domain weights by soft membership.

A labelled table gives some documents a domain. A naive Bayes classifier over the TERMS most telling words (and how varied
a text's words are) predicts every document's posterior over the domains, which is its soft membership. Document rates
x >= 0, how often each document is to be taken, are fitted by projected gradient steps to the least-squares problem

    minimise  sum_d (S_d - T_d)^2 / (2 T^2 s_d)  +  ridge / 2 * sum_i (t_i / T) (x_i - 1)^2,   S_d = sum_i x_i t_i p_id,

with t_i a document's tokens, p_id its posterior, T all tokens, T_d the target share of d times T, and s_d its share as it
is. In the measure of tokens the gradient at document i is g_i = sum_d p_id e_d / s_d + ridge (x_i - 1), with the relative
error e_d = (S_d - T_d) / T, and a step is x_i <- max(0, x_i - g_i / (1 + ridge)). Posteriors add up to one, so no eigenvalue
of the curvature is above 1 + ridge: the step needs no search and the error never grows. There are at most STEPS of them;
targets that few documents can meet are neared slowly.

A step is one distributed sum over documents, of which the driver gets D numbers; the rate of a document follows from its
posterior and the errors of the steps before, so no rates are written between steps. Documents with exactly the same
posterior have the same rate at every step, so they are added up first; the table of these is never larger than that of the
documents. All of it is DataFrame operations.

A document is taken floor(rate) times, and once more if a hash of its id falls under the rest.

Defined results: null and empty texts have no tokens and the posterior of texts without any chosen term; rows with a null id are left out;
repeated rows each get their row; a document with several labels counts for the least domain by name; without labelled
documents all posteriors are even; a domain that no document belongs to can't be matched and leaves the others as near as
least squares gets.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Stages

#: Labelled documents that the classifier is fitted to, at most: those with the least hash of their id.
SAMPLE = 6000
TERMS = 1000
#: A term tells of a domain if its count there is so many squared deviations from the expected; counts are shrunk so far.
SURPRISE, SHRINK = 10.0, 5.0
#: The absence of all terms of a domain counts for so much at most.
ABSENT = -3.5
#: What stands between words.
BREAKS = r"""[\s.,;:!?"()]+"""
STEPS, RIDGE = 60, 1e-3
#: Steps end when none changes a domain's tokens by so much of its target.
TOLERANCE = 1e-3


def with_terms(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """id, tokens and the distinct terms of each document, with more columns."""
    split = F.array_remove(F.split(F.lower(F.coalesce(docs[text_col], F.lit(""))), BREAKS), "")
    words = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("id"), split.alias("words"), *more)
    rest = [c for c in words.columns if c not in ("id", "words")]
    words = words.select("id", "words", F.array_distinct("words").alias("distinct"), *rest)
    count = F.size("words").cast("long")
    variety = F.concat(F.lit("#variety="), F.floor(10 * F.size("distinct") / F.size("words")).cast("string"))
    return words.select("id", count.alias("tokens"), F.when(count > 0, F.concat("distinct", F.array(variety))).otherwise(F.array().cast("array<string>")).alias("terms"), *rest)


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], stages: Stages, *, id_col: str, text_col: str, sample: int, n_terms: int) -> tuple[list[float], list[tuple[str, list[float]]]]:
    """Log odds of the domains for a text without any chosen term, and what each chosen term adds to them. labelled: id_col and domain."""
    key = docs.schema[id_col].dataType
    chosen = (
        labelled.select(labelled[id_col].cast(key).alias("id"), labelled["domain"].alias("domain"))
        .where(F.col("id").isNotNull() & F.col("domain").isin(domains))
        .groupBy("id").agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    # The sample is taken before its texts are split, and its terms are written: they are read more than once.
    sampled = docs.join(F.broadcast(chosen.withColumnRenamed("id", id_col)), id_col)
    rows = stages.write(with_terms(sampled, id_col, text_col, F.col("domain")), "sample")
    size = [F.count(F.when(F.col("domain") == d, 1)).cast("double").alias(f"n{k}") for k, d in enumerate(domains)]
    mass = [F.sum(F.when(F.col("domain") == d, F.size("terms"))).cast("double").alias(f"m{k}") for k, d in enumerate(domains)]
    total = rows.agg(*size, *mass).first()
    n, m = ([total[f"{x}{k}"] or 0.0 for k in range(len(domains))] for x in "nm")
    counts = rows.select("domain", F.explode("terms").alias("term")).groupBy("term").agg(*size)
    # Against the share of all terms, not of documents: else the domain of the longer texts would get every long text.
    everywhere = sum((F.col(f"n{k}") for k in range(len(domains))), F.lit(0.0)) / max(sum(m), 1.0)
    expected = [everywhere * m[k] for k in range(len(domains))]
    # Only what a domain has more of: what it has less of goes with the language and length of a text.
    surprise = [F.when(F.col(f"n{k}") > expected[k], (F.col(f"n{k}") - expected[k]) ** 2 / (expected[k] + SHRINK)).otherwise(0.0) for k in range(len(domains))]
    most = F.greatest(*surprise) if len(surprise) > 1 else surprise[0]
    best = counts.where(most >= SURPRISE).orderBy(most.desc(), "term").limit(n_terms)
    found = best.select("term", *(F.col(f"n{k}") for k in range(len(domains))), *(z.alias(f"z{k}") for k, z in enumerate(surprise))).collect()
    prior = [math.log((x + 1.0) / (sum(n) + len(n))) for x in n]
    weights, absent = [], [0.0] * len(domains)
    for r in found:
        common = sum(r[f"n{k}"] for k in range(len(domains))) / max(sum(n), 1.0)
        share = [(r[f"n{k}"] + SHRINK * common) / (n[k] + SHRINK) if r[f"z{k}"] >= SURPRISE else common for k in range(len(domains))]
        share = [min(max(x, 1e-4), 1 - 1e-4) for x in share]
        # What the term's absence says goes into the start, what its presence adds to that is its weight.
        absent = [p + math.log(1 - x) for p, x in zip(absent, share, strict=True)]
        weights.append((r["term"], [math.log(x / (1 - x)) for x in share]))
    # Many terms that go together are not so many proofs of absence.
    top = max(absent)
    return [p + max(x - top, ABSENT) for p, x in zip(prior, absent, strict=True)], weights


def posteriors(docs: DataFrame, prior: list[float], weights: list[tuple[str, list[float]]], *, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """id, tokens, the posterior over the domains, p0, p1, ..., and columns to keep under keep_<name>."""
    held = [f"keep_{c}" for c in keep]
    start = F.array(*(F.lit(float(p)) for p in prior))
    known = with_terms(docs, id_col, text_col, *(docs[c].alias(f"keep_{c}") for c in keep))
    if weights:
        listed = F.array(*(F.lit(t) for t, _ in weights))
        of = F.map_from_arrays(listed, F.array(*(F.array(*(F.lit(float(x)) for x in w)) for _, w in weights)))
        # In one order, so that equal sets of terms have the same sums to the last bit.
        known = known.withColumn("terms", F.array_sort(F.array_intersect("terms", listed)))
        logs = F.aggregate(F.transform("terms", lambda t: F.element_at(of, t)), start, lambda a, w: F.zip_with(a, w, lambda x, y: x + y))
    else:
        logs = start
    known = known.select("id", "tokens", logs.alias("logs"), *held)
    known = known.select("id", "tokens", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))).alias("odds"), *held)
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    return known.select("id", "tokens", *((F.element_at("odds", k + 1) / total).alias(f"p{k}") for k in range(len(prior))), *held)


def fit_rates(cells: DataFrame, n: int, targets: list[float], *, steps: int = STEPS, ridge: float = RIDGE) -> Column:
    """The rate of a row of p0, p1, ...: projected gradient steps over cells (tokens, p0, ...), which all start at 1."""
    names = [f"p{k}" for k in range(n)]

    def look(rate: Column) -> tuple[float, np.ndarray]:
        """All tokens, and the share of each domain at these rates."""
        row = cells.select("tokens", *names, rate.alias("rate")).agg(F.sum("tokens"), *(F.sum(F.col("rate") * F.col("tokens") * F.col(c)) for c in names)).first()
        total = float(row[0] or 0)
        return total, np.array([float(x or 0) for x in row[1:]]) / (total or 1.0)

    rate, wanted = F.lit(1.0), np.array(targets)
    total, share = look(rate)
    scale = np.maximum(share, 1e-9)
    for _ in range(steps if total else 0):
        push = (share - wanted) / scale
        slope = sum((F.col(c) * float(x) for c, x in zip(names, push, strict=True)), F.lit(-ridge))
        # x - (slope + ridge x) / (1 + ridge)
        rate = F.greatest(F.lit(0.0), (rate - slope) * (1 / (1 + ridge)))
        before, (_, share) = share, look(rate)
        if np.abs((share - before) / np.maximum(wanted, 1e-3)).max() < TOLERANCE:
            break
    return rate


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, n_terms: int = TERMS, keep: list[str] | None = None) -> DataFrame:
    """One row per document with an id: id_col, tokens, p_<domain> for each domain, rate, copies (how often it is taken) and keep.

    labelled: id_col and domain; targets: the share of all tokens that each domain is to have.
    """
    stages = Stages(docs.sparkSession)
    domains = sorted(targets)
    whole = sum(targets.values())
    prior, weights = classifier(docs.select(id_col, text_col), labelled, domains, stages, id_col=id_col, text_col=text_col, sample=sample, n_terms=n_terms)
    names = [f"p{k}" for k in range(len(domains))]
    members = stages.write(posteriors(docs, prior, weights, id_col=id_col, text_col=text_col, keep=keep or []), "members")
    cells = stages.write(members.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "cells")
    rated = members.withColumn("rate", fit_rates(cells, len(domains), [targets[d] / whole for d in domains]))
    draw = F.pmod(F.xxhash64("id", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")
    return rated.select(F.col("id").alias(id_col), "tokens", *(F.col(p).alias(f"p_{d}") for p, d in zip(names, domains, strict=True)), "rate", copies.cast("int").alias("copies"), *(F.col(f"keep_{c}").alias(c) for c in keep or []))
