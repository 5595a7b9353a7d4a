"""Near-duplicate vectors: a robust-pruned flat graph over overlapping cluster shards, and range search on it.

Only vectors of one label and length are compared. Equal vectors are one from the start, under their least id.

Shards. A label with more than SHARD vectors is split by pivots, a hash sample of its own vectors, each vector going to
the two nearest; parts that are still too large are split again, where a vector's home gets a second part and its other
copies move on to one. Pivots are APART from one another, so that a dense group has one and stays together, unless all of a
part is one dense group. A shard fits one task.

Graph. Within a shard each vector's nearest ones and a few random ones are pruned robustly: a candidate is dropped if a
chosen neighbour is ALPHA times nearer to it than the vector is. Links get their reverse, and what the medoid can't reach
gets a link from the nearest vector that it can. A vector's lists from all its shards are united.

Search. Within a shard each vector is sought from the shard's medoid and ENTRIES more spread over it: a beam of the nearest
vectors seen is expanded until all are, then all vectors seen within range, until no new one appears. Links found are
verified in double precision. Each shard audits a sample of its queries against brute force and doubles the beam until the
recall reaches AUDIT. A link in two shards counts in the lesser one alone; to the components each shard gives one link from
each vector to the least of its part, so no list of links leaves it.

Across shards. A vector's home is the shard of the nearest pivot at each split; homes are cells that don't overlap. Cells of
a label are compared exactly, block against block, and pairs with a common shard left out, as the search has them. A pair of
cells, or a vector against a cell, is passed over only if the cells' centers and radii rule out every link. Cells go in
tiles of TILE numbers at most; a task compares one tile with another, so a vector is copied once for each tile of its label.

Defined results: vectors that are null, empty, zero or have null or non-finite components, and those without label, link
with nothing; equal vectors link; rows with a null id are left out; each row is a vector of its own, repeated ids too.
Vectors of double precision, or of whole numbers, are compared as they are, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_BYTES, Stages, broadcast_if_small
from lodestone.llm.components import connected_components
from lodestone.session import ship

COSINE = 0.93
SHARD, PIVOTS, APART = 2048, 48, 0.75
DEGREE, NEAREST, RANDOM, ALPHA = 24, 48, 16, 1.2
BEAM, AUDIT, ENTRIES, AT_A_TIME = 16, 0.98, 64, 16
#: Components of all vectors in a tile of cells, at most.
TILE = 1 << 21
_BLOCK = 128


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one in single precision; scaled first, so that no square overflows."""
    return scaled(x).astype(np.float32)


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors of length one in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def prune(x: np.ndarray, at: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) of the vectors at some positions, chosen from a row of candidates for each."""
    far = 1 - np.einsum("ijk,ik->ij", x[seen], x[at])
    far[seen == at[:, None]] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    seen, far = np.take_along_axis(seen, order, 1), np.take_along_axis(far, order, 1)
    near = x[seen]
    between = ALPHA * (1 - near @ near.transpose(0, 2, 1))
    open_ = np.isfinite(far)
    open_[:, 1:] &= seen[:, 1:] != seen[:, :-1]
    every, chosen = np.arange(len(at)), []
    for _ in range(DEGREE):
        k = open_.argmax(axis=1)
        has = open_[every, k]
        if not has.any():
            break
        chosen.append((at[has], seen[every, k][has]))
        open_ &= between[every, k] > far
        open_[every, k] = False
    return np.concatenate([c[0] for c in chosen] or [at[:0]]), np.concatenate([c[1] for c in chosen] or [at[:0]])


class Links:
    """Directed links of a shard, those of one vector side by side."""

    def __init__(self, n: int, source: np.ndarray, target: np.ndarray):
        source, target = np.divmod(np.unique(source.astype(np.int64) * n + target), n) if n else (source, target)
        inner = source != target
        self.n, self.target = n, target[inner]
        self.at = np.searchsorted(source[inner], np.arange(n + 1))

    def ahead(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many neighbours each of nodes has, and the neighbours."""
        size = self.at[nodes + 1] - self.at[nodes]
        return size, self.target[np.repeat(self.at[nodes] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())] if len(nodes) else self.target[:0]

    def of(self, node: int) -> np.ndarray:
        return self.target[self.at[node] : self.at[node + 1]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(self.n), np.diff(self.at)), self.target


def build(x: np.ndarray, seed: int = 5) -> Links:
    """Neighbours of each vector of a shard; all can be reached from the medoid."""
    n, rng = len(x), np.random.default_rng(seed)
    near, found = min(NEAREST + 1, n), []
    for a in range(0, n, 512):
        sims = x[a : a + 512] @ x.T
        top = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        found.append(prune(x, np.arange(a, a + len(top)), np.concatenate([top, rng.integers(0, n, (len(top), RANDOM))], axis=1)))
    source, target = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    # Reverse links have no bound but the shard's: the members of a dense group hang on its middle.
    return reach(x, Links(n, np.concatenate([source, target]), np.concatenate([target, source])))


def reach(x: np.ndarray, links: Links) -> Links:
    """links with more, so that the medoid reaches every vector."""
    reached, more = np.zeros(links.n, bool), []
    todo = np.array([medoid(x)])
    while True:
        while len(todo):
            reached[todo] = True
            ahead = np.unique(links.ahead(todo)[1])
            todo = ahead[~reached[ahead]]
        rest = np.flatnonzero(~reached)
        if not len(rest):
            break
        inside = np.flatnonzero(reached)
        more.append((int(inside[(x[inside] @ x[rest[0]]).argmax()]), int(rest[0])))
        todo = rest[:1]
    if not more:
        return links
    source, target = links.pairs()
    added = np.array(more, np.int64)
    return Links(links.n, np.concatenate([source, added[:, 0]]), np.concatenate([target, added[:, 1]]))


class Graph:
    def __init__(self, x: np.ndarray, links: Links):
        self.x, self.links = x, links
        self.start = np.unique(np.append(np.random.default_rng(17).permutation(len(x))[:ENTRIES], medoid(x)))

    def _visit(self, sims: np.ndarray, asked: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> None:
        """Similarities to the neighbours of each row's nodes, where not yet known."""
        size, ahead = self.links.ahead(nodes)
        keys = np.repeat(rows, size) * len(self.x) + ahead
        fresh = np.zeros(sims.size, bool)
        fresh[keys] = True
        keys = np.flatnonzero(fresh & (sims.ravel() == -np.inf))
        for a in range(0, len(keys), 65536):
            rows, nodes = np.divmod(keys[a : a + 65536], len(self.x))
            sims[rows, nodes] = np.einsum("ij,ij->i", self.x[nodes], asked[rows])

    def search(self, queries: np.ndarray, bound: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, vector) with a similarity of bound or more, as the search meets them, in blocks."""
        n = len(self.x)
        beam = min(beam, n)
        for a in range(0, len(queries), _BLOCK):
            block = queries[a : a + _BLOCK]
            asked = self.x[block]
            sims = np.full((len(block), n), -np.inf, np.float32)
            done = np.zeros((len(block), n), bool)
            sims[:, self.start] = asked @ self.x[self.start].T
            while True:
                top = np.argpartition(sims, n - beam, axis=1)[:, n - beam :]
                value = np.take_along_axis(sims, top, 1)
                value[np.take_along_axis(done, top, 1)] = -np.inf
                best = np.argpartition(-value, min(AT_A_TIME, beam) - 1, axis=1)[:, :AT_A_TIME]
                open_ = np.take_along_axis(value, best, 1) > -np.inf
                if not open_.any():
                    break
                rows = np.nonzero(open_)[0]
                nodes = np.take_along_axis(top, best, 1)[open_]
                done[rows, nodes] = True
                self._visit(sims, asked, rows, nodes)
            while True:  # the range: all within the bound are expanded
                rows, nodes = np.nonzero((sims >= bound) & ~done)
                if not len(rows):
                    break
                done[rows, nodes] = True
                self._visit(sims, asked, rows, nodes)
            rows, nodes = np.nonzero(sims >= bound)
            yield block[rows], nodes


def shard_links(vectors: np.ndarray, links: Links, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a shard (first position less than second), searched, audited and verified."""
    n = len(vectors)
    x = unit(vectors)
    graph, bound = Graph(x, links), cosine - 1e-4
    sample = np.random.default_rng(3).permutation(n)[:64]
    true = x[sample] @ x.T >= bound
    beam = BEAM
    while beam < n:
        found = sum(len(r) for r, _ in graph.search(sample, bound, beam))
        if found >= AUDIT * true.sum():
            break
        beam *= 2
    pairs = [np.minimum(a, b) * n + np.maximum(a, b) for a, b in graph.search(np.arange(n), bound, beam)]
    a, b = np.divmod(np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64), n)
    a, b = a[a != b], b[a != b]
    exact = scaled(vectors)
    keep = [np.einsum("ij,ij->i", exact[a[s : s + 65536]], exact[b[s : s + 65536]]) >= cosine for s in range(0, len(a), 65536)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return a[keep], b[keep]


def parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n positions the least one that it reaches over links (a, b)."""
    least = np.arange(n)
    while len(a):
        low = np.minimum(least[a], least[b])
        now = least.copy()
        np.minimum.at(now, least[a], low)
        np.minimum.at(now, least[b], low)
        while (now[now] != now).any():
            now = now[now]
        if (now == least).all():
            break
        least = now
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    return least


def within(sims: np.ndarray, radius: np.ndarray | float, cosine: float) -> np.ndarray:
    """Whether what has such a similarity to a cell's center may link with a member of the cell."""
    return np.arccos(np.clip(sims, -1, 1)) <= radius + np.arccos(cosine) + 1e-3


class Cell:
    """The vectors whose home is one shard."""

    def __init__(self, row, at: int, number: dict[str, int]):
        self.tile, self.radius, self.at = row.tile, row.radius, at
        self.center = np.frombuffer(row.center, np.float64)
        self.ids, self.copies, self.least = (np.frombuffer(b, np.int64) for b in (row.ids, row.copies, row.least))
        vectors = np.frombuffer(row.vectors, np.float32 if len(row.vectors) == 4 * row.dim * len(self.ids) else np.float64)
        self.vectors = vectors.reshape(len(self.ids), -1)
        self.x = unit(self.vectors)
        size = [len(paths) for paths in row.paths]
        self.row = np.repeat(np.arange(len(size)), size)
        self.shard = np.array([number.setdefault(p, len(number)) for paths in row.paths for p in paths], np.int64)

    def may_meet(self, other: Cell, cosine: float) -> np.ndarray:
        return np.flatnonzero(within(self.x @ other.center, other.radius, cosine))

    def inside(self, shards: np.ndarray) -> np.ndarray:
        """Which vectors are in which of the sorted shards, as 0 and 1."""
        out = np.zeros((len(self.ids), len(shards)), np.float32)
        there = np.isin(self.shard, shards)
        out[self.row[there], np.searchsorted(shards, self.shard[there])] = 1
        return out


def cell(frame: pd.DataFrame) -> pd.DataFrame:
    """One row with all of a cell, its center, and the angle from there to the farthest member."""
    frame = frame.sort_values("rep")
    vectors = np.stack(frame["vector"].to_numpy())
    x = unit(vectors).astype(np.float64)
    center = x.mean(axis=0) if np.linalg.norm(x.mean(axis=0)) > 1e-6 else x[0]
    center /= np.linalg.norm(center)
    radius = float(np.arccos(np.clip((x @ center).min(), -1, 1)))
    packed = {c: [frame[c].to_numpy().astype(np.int64).tobytes()] for c in ("rep", "copies", "least")}
    return pd.DataFrame({"path": [frame["path"].iloc[0]], "kind": [frame["kind"].iloc[0]], "dim": [vectors.shape[1]], "center": [center.tobytes()], "radius": [radius], "ids": packed["rep"], "copies": packed["copies"], "least": packed["least"], "vectors": [vectors.tobytes()], "paths": [[list(p) for p in frame["paths"]]]})


def hits(a: Cell, b: Cell, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Positions in a and in b, and which of them link without having a common shard; None if none may."""
    if not within(a.center @ b.center, a.radius + b.radius, cosine):
        return None
    rows, columns = a.may_meet(b, cosine), b.may_meet(a, cosine)
    if not len(rows) or not len(columns):
        return None
    sims = a.x[rows] @ b.x[columns].T
    hit = sims >= cosine - 1e-4
    if len(common := np.intersect1d(a.shard, b.shard)):
        hit &= a.inside(common)[rows] @ b.inside(common)[columns].T == 0
    # What is too near to the bound for single precision.
    close_a, close_b = np.nonzero(hit & (sims < cosine + 1e-4))
    for s in range(0, len(close_a), 65536):
        i, j = close_a[s : s + 65536], close_b[s : s + 65536]
        hit[i, j] = np.einsum("ij,ij->i", scaled(a.vectors[rows[i]]), scaled(b.vectors[columns[j]])) >= cosine
    return (rows, columns, hit) if hit.any() else None


def across(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links between the cells of two tiles, or within one: a count for each vector, and a spanning forest by least ids."""
    cells, number, n = [], {}, 0
    for row in frame.sort_values("path").itertuples():
        cells.append(Cell(row, n, number))
        n += len(cells[-1].ids)
    one = frame["low"].iloc[0] == frame["high"].iloc[0]
    ids, least = (np.concatenate([getattr(c, k) for c in cells]) for k in ("ids", "least"))
    count, parent, tree = np.zeros(n), list(range(n)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, a in enumerate(cells):
        for b in cells[k + 1 :]:
            if not one and a.tile == b.tile or (found := hits(a, b, cosine)) is None:
                continue
            rows, columns, hit = found
            amount = hit.astype(np.float64)
            count[a.at + rows] += amount @ b.copies[columns]
            count[b.at + columns] += a.copies[rows] @ amount
            while True:  # each turn joins every part that has a link to another, until none has
                here, there = (np.array([root(i) for i in at.tolist()]) for at in (a.at + rows, b.at + columns))
                fresh = hit & (here[:, None] != there[None, :])
                some, other = np.flatnonzero(fresh.any(axis=1)), np.flatnonzero(fresh.any(axis=0))
                if not len(some):
                    break
                pairs = np.concatenate([np.stack([rows[some], columns[fresh[some].argmax(axis=1)]], 1), np.stack([rows[fresh[:, other].argmax(axis=0)], columns[other]], 1)])
                for i, j in (pairs + [a.at, b.at]).tolist():
                    p, q = root(i), root(j)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        tree.append((least[i], least[j]))
    met = np.flatnonzero(count)
    ends = np.array(tree, np.int64).reshape(-1, 2)
    return pd.DataFrame({"rep": np.concatenate([ids[met], np.full(len(ends), -1)]), "n": np.concatenate([count[met], np.zeros(len(ends))]).astype(np.int64), "a": np.concatenate([np.full(len(met), -1), ends[:, 0]]), "b": np.concatenate([np.full(len(met), -1), ends[:, 1]])})


def links_across(members: DataFrame, stages: Stages, cosine: float) -> DataFrame | None:
    """Links of vectors without a common shard, as across() gives them; None if no label has been split."""
    homes = members.where("home and path != kind").select("rep", "vector", "path", "kind", "paths", "copies", "least")
    schema = "path string, kind string, dim long, center binary, radius double, ids binary, copies binary, least binary, vectors binary, paths array<array<string>>"
    cells = stages.write(homes.groupBy("path").applyInPandas(cell, schema), "cells")
    if cells.isEmpty():
        return None
    place = F.row_number().over(Window.partitionBy("kind").orderBy("path")) - 1
    tiled = cells.select("path", "kind", "center", "radius", F.floor(place / F.greatest(F.lit(1), F.floor(F.lit(TILE) / (F.lit(SHARD) * F.col("dim"))))).cast("long").alias("tile"))
    tiled = stages.write(tiled, "tiled")
    tiles = tiled.groupBy("kind", F.col("tile").alias("other")).agg(F.collect_list(F.struct("path", "center", "radius")).alias("there"))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for path, center, radius, there in zip(frame["path"], frame["center"], frame["radius"], frame["there"], strict=True):
                there = [t for t in there if t["path"] != path]
                sims = np.array([np.frombuffer(t["center"], np.float64) @ np.frombuffer(center, np.float64) for t in there])
                keep.append(bool(len(there)) and bool(within(sims, radius + np.array([t["radius"] for t in there]), cosine).any()))
            yield frame.loc[keep, ["path", "tile", "low", "high"]]

    pairs = tiled.join(tiles, "kind").select("*", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    keys = pairs.select("path", "center", "radius", "tile", "low", "high", "there").mapInPandas(meet, "path string, tile long, low long, high long")
    return keys.join(cells, "path").groupBy("kind", "low", "high").applyInPandas(lambda frame: across(frame, cosine), "rep long, n long, a long, b long")


def spread(centers: np.ndarray) -> np.ndarray:
    """The pivots that are no nearer than APART to one before; all of them if less than three are."""
    sims = centers @ centers.T
    chosen: list[int] = []
    for i in range(len(centers)):
        if not chosen or sims[i, chosen].max() < APART:
            chosen.append(i)
    return centers[chosen] if len(chosen) > 2 else centers


def matrix(vectors: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def two_nearest(reps: np.ndarray, vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Numbers of the two nearest centers, the nearest first; ties, as of vectors in one direction, are broken by the id, or a part would not shrink."""
    dice = (reps.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(len(centers), dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)
    sims = unit(vectors) @ centers.T + dice.astype(np.float32) * np.float32(1e-6 / (1 << 24))
    return np.argsort(-sims, axis=1)[:, :2]


def split(points: DataFrame, stages: Stages) -> DataFrame:
    """points (rep, vector, path, home) with one row for each shard that a vector is in, one of them its home; a shard has at
    most SHARD rows. A home that is split gives its vectors a second shard; other copies move on to the nearest part alone,
    so that a vector has at most one shard more than its home was split."""
    spark, turn, done = points.sparkSession, 0, []
    columns = ["rep", "vector", "path", "home"]
    kind = points.schema["vector"].dataType.simpleString()
    while True:
        counts = points.groupBy("path").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"))
        large = stages.write(counts.where(F.col("n") > SHARD).withColumn("pivots", F.least(F.lit(PIVOTS), F.ceil(F.col("n") * 4 / SHARD))), f"large-{turn}")
        n_large, dim = large.agg(F.count("*"), F.max("dim")).first()
        if not n_large:
            break
        few = broadcast_if_small(large.select("path", "n", "pivots"), n_large, 128)
        done.append(points.join(few, "path", "left_anti").select(columns))
        points = points.join(few, "path")
        # A hash of id and turn stands for a uniform draw: about as many pivots as named, others in the next turn.
        draw = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        chosen = points.where(draw < F.col("pivots") / F.col("n"))
        lists = stages.write(chosen.groupBy("path").agg(F.sort_array(F.collect_list("vector")).alias("centers")), f"pivots-{turn}")
        # Centers go to the workers as one table if they are small, else with each row.
        shared = None
        if n_large * PIVOTS * 2 * dim * 8 <= BROADCAST_BYTES:
            shared = spark.sparkContext.broadcast({r["path"]: spread(unit(np.array(r["centers"]))) for r in lists.collect()})
            moved = points.select(columns)
        else:
            moved = points.select(columns).join(lists, "path", "left").select(*columns, "centers")

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                paths = batch.column(2).dictionary_encode()
                code = np.asarray(paths.indices)
                for k, path in enumerate(paths.dictionary.to_pylist()):
                    part = batch.take(pa.array(np.flatnonzero(code == k)))
                    if shared is not None:
                        centers = shared.value.get(path)
                    else:
                        own = part.column(4)[0]
                        centers = spread(unit(np.array(own.as_py()))) if own.is_valid else None
                    if centers is None:  # no pivot was drawn: the part waits for the next turn
                        yield pa.RecordBatch.from_arrays(part.columns[:4], columns)
                        continue
                    two = two_nearest(part.column(0).to_numpy(), matrix(part.column(1)), centers)
                    home = np.asarray(part.column(3))
                    for c in range(two.shape[1]):
                        keep = pa.array(np.flatnonzero(home) if c else np.arange(len(home)))
                        names = pa.array([f"{path}/{x}" for x in two[keep.to_numpy(), c].tolist()], pa.string())
                        yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), names, pa.array(home[keep.to_numpy()] & (c == 0))], columns)

        points = stages.write(moved.mapInArrow(nearest, f"rep long, vector {kind}, path string, home boolean"), f"points-{turn + 1}")
        turn += 1
    for part in done:
        points = points.unionByName(part)
    return points


def near_duplicates(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row with an id: id_col, n_links (other rows linked directly), component_id and kept."""
    spark = ship(rows.sparkSession)
    stages = Stages(spark)
    kind = rows.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = rows.select(rows[id_col].cast("long").alias("id"), rows[vector_col].cast(kind).alias("vector"), rows[label_col].cast("string").alias("label")).where("id is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    path = F.concat_ws(":", "label", F.size("vector").cast("string"))
    marked = rows.where("usable").select("id", "vector", path.alias("path"), F.xxhash64("vector").alias("mark1"), F.xxhash64(F.lit("second"), "vector").alias("mark2"))
    groups = marked.groupBy("path", "mark1", "mark2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    # A repeated id may stand for several vectors: their own numbers keep them apart.
    groups = stages.write(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")

    points = split(groups.select(F.col("node").alias("rep"), "vector", "path", F.lit(True).alias("home")), stages)
    copies = groups.select(F.col("node").alias("rep"), "copies", F.col("rep").alias("least"), F.col("path").alias("kind"))
    # Ids alone are gathered; vectors are joined with them once.
    shards = points.groupBy("rep").agg(F.array_sort(F.collect_list("path")).alias("paths")).join(copies, "rep")
    members = stages.write(points.join(shards, "rep"), "members")

    def graph(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rep")
        ids = rows["rep"].to_numpy()
        links = build(unit(matrix(rows["vector"])))
        return pa.table({"rep": ids, "nearby": pa.ListArray.from_arrays(pa.array(links.at.astype(np.int32)), pa.array(ids[links.target]))})

    lists = members.select("rep", "vector", "path").groupBy("path").applyInArrow(graph, "rep long, nearby array<long>")
    united = stages.write(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("nearby"))).alias("nearby")), "graph")

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rep")
        own, n = rows["path"][0].as_py(), rows.num_rows
        ids, least, amount = (rows[c].to_numpy() for c in ("rep", "least", "copies"))
        vectors = matrix(rows["vector"])
        nearby = rows["nearby"].combine_chunks()
        source, target = np.repeat(np.arange(n), np.diff(nearby.offsets.to_numpy())), nearby.flatten().to_numpy()
        at = np.minimum(np.searchsorted(ids, target), n - 1)
        there = ids[at] == target
        a, b = shard_links(vectors, reach(unit(vectors), Links(n, source[there], at[there])), cosine)
        # The lesser of two vectors' common shards counts their link.
        paths = rows["paths"].combine_chunks()
        names, whose = paths.flatten().dictionary_encode(), np.repeat(np.arange(n), np.diff(paths.offsets.to_numpy()))
        earlier = np.array([p < own for p in names.dictionary.to_pylist()], bool)
        number = np.cumsum(earlier) - 1
        code = np.asarray(names.indices)
        inside = np.zeros((n, int(earlier.sum())), bool)
        inside[whose[earlier[code]], number[code[earlier[code]]]] = True
        mine = [~(inside[a[s : s + 65536]] & inside[b[s : s + 65536]]).any(axis=1) for s in range(0, len(a), 65536)]
        mine = np.concatenate(mine) if mine else np.zeros(0, bool)
        count = np.bincount(a[mine], amount[b[mine]], n) + np.bincount(b[mine], amount[a[mine]], n)
        root = parts(n, a, b)
        tree = np.flatnonzero(root != np.arange(n))
        blank = np.full(n, -1)
        return pa.table({"rep": np.concatenate([ids, np.full(len(tree), -1)]), "n": np.concatenate([count, np.zeros(len(tree))]).astype(np.int64), "a": np.concatenate([blank, least[root[tree]]]), "b": np.concatenate([blank, least[tree]])})

    found = stages.write(members.join(united, "rep").groupBy("path").applyInArrow(search, "rep long, n long, a long, b long"), "found")
    if (more := links_across(members, stages, cosine)) is not None:
        found = found.unionByName(stages.write(more, "across"))
    links = found.where("rep = -1").select("a", "b")
    components = stages.write(connected_components(links, stages, "links"), "components")
    linked = found.where("rep >= 0").groupBy(F.col("rep").alias("node")).agg(F.sum("n").alias("n"))
    summed = groups.drop("vector").join(linked, "node").join(components.select(F.col("id").alias("rep"), "component"), "rep", "left")
    summed = summed.select("path", "mark1", "mark2", (F.col("n") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    some = marked.select("id", "path", "mark1", "mark2").join(summed, ["path", "mark1", "mark2"]).select("id", "n_links", "component_id")
    none = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    stages.drop("members", "graph")
    return some.unionByName(none).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
