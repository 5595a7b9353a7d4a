"""Best-fit packing of tokenised documents into sequences, after a dominance reduction of the instance.

Lengths are whole numbers up to the capacity, so an instance of any size is a histogram of at most `capacity` counts.
Planning works on that histogram, on the driver, many equal bins at a time:

1. Reduction (Martello and Toth): a set that dominates every other feasible set with the same largest piece is fixed for
   good. A piece and one that fills the rest of its sequence exactly dominate whatever else could go there; a piece that
   nothing fits beside stands alone; where no two (or no better two) others fit beside a piece, the largest that fits does.
2. Best fit: what remains goes, longest first, where the least room is left.

The plan is a list of patterns, each with a number of equal sequences. Pieces take their places by their rank among the
pieces of their length, which Spark counts in cells of about CELL rows (CELLS cells a length at most), dealt by a number that
each written row has, so that a length that a third of all rows have is spread over many tasks, whatever its ids. No step
sees more than a histogram, the counts of a length's cells, a cell or a Python batch.

Defined results: a null text counts as empty; an empty text is one piece with the end id alone; repeated rows are packed
one by one, rows with a null id too; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import textkit
from lodestone.llm.common import Stages, broadcast_if_small
from lodestone.session import ship

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that are ranked in one task, about.
CELL, CELLS = 1000, 4096
#: Words whose ids a worker keeps: the first ones, which most texts share. It starts anew when they are of little use.
CACHE_WORDS = 300_000

#: Texts of these characters only are the same for the tokenizer word by word and in lower case: no combining marks, no
#: white space that Python and the tokenizer's patterns see differently, no capital that folds to more than one character.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ‐-‧‰-⁞]*")
_LETTERS = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ]+")
_LETTERS_MARKS = re.compile(r"([a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ]+)([!-&(-/:-@\[-`{-~]+)")


def plain(text: str) -> bool:
    """Whether a text has only the characters of _PLAIN."""
    if text.isascii():
        return text.replace("\n", " ").replace("\t", " ").isprintable()
    return _PLAIN.fullmatch(text) is not None


class Ids:
    """Token ids of texts as bytes (little-endian, 32 bits each), the same as the tokenizer's for the whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.closes = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        runs, rest, split = set(), set(), []
        for w in words:
            if _LETTERS.fullmatch(w):
                runs.add(w)
            elif m := _LETTERS_MARKS.fullmatch(w):
                split.append((w, *m.groups()))
                if m[1] not in self.words:
                    runs.add(m[1])
                if m[2] not in self.words:
                    rest.add(m[2])
            else:
                rest.add(w)
        listed = list(runs)
        for i in range(0, len(listed), 2000):
            part = listed[i : i + 2000]
            ids = self._encode([" ".join(part)])[0]
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                rest.update(part)
                continue
            for w, a, b in zip(part, [0, *ends[:-1]], ends, strict=True):
                self.words[w] = ids[a:b].tobytes()
        listed = list(rest)
        for w, ids in zip(listed, self._encode(listed), strict=True):
            self.words[w] = ids.tobytes()
        for w, base, marks in split:
            self.words[w] = self.words[base] + self.words[marks]

    def of(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        split: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if "<|" not in text and plain(text):
                split[i] = text.lower().split()
            else:
                out[i] = self._encode([text])[0].tobytes()
        known = self.words
        words = set().union(*split.values())
        missing = words - known.keys()
        full = len(known) >= CACHE_WORDS
        if full and 2 * len(missing) > len(words):
            known.clear()
            missing, full = words, False
        size = len(known)
        if missing:
            self._learn(missing)
        for i, parts in split.items():
            out[i] = b"".join(map(known.__getitem__, parts))
        if full:
            for w in list(islice(reversed(known), len(known) - size)):
                del known[w]
        return out


_ids: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each document's ids, end_id last, cut into pieces of at most capacity ids.

    Columns id, piece (from 0), start (the document's ids before it), length, ids_crc32, and with with_ids the ids
    themselves as binary. tokenizer is the path of a tokenizers file on every executor.
    """
    ship(docs.sparkSession)
    end = struct.pack("<I", end_id)
    key = docs.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ids_of(tokenizer)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for r, data in enumerate(encoder.of(part.column(1).to_pylist())):
                    data += end
                    for k, a in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[a : a + 4 * capacity]
                        row.append(r)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            kept.append(cut)
                out = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary())] * with_ids, names)

    schema = f"id {key}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(textkit.tidy(run), schema)


#: Runs of equal lengths in a sequence, first to last, and how many sequences are so filled.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def reduce(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Fixes dominating sets and takes them from count, the number of pieces by length; what is left is the reduced instance."""
    fixed: list[Pattern] = []

    def fix(lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            count[x] -= times
        fixed.append((tuple((x, 1) for x in lengths), times))

    if count[capacity]:
        fix((capacity,), int(count[capacity]))
    for x in range(capacity - 1, capacity // 2, -1):  # a piece that fills the rest exactly dominates any set that could stand there
        if times := int(min(count[x], count[capacity - x])):
            fix((x, capacity - x), times)
    if capacity % 2 == 0 and count[capacity // 2] >= 2:
        fix((capacity // 2, capacity // 2), int(count[capacity // 2] // 2))
    while True:
        lengths = np.flatnonzero(count)
        if not len(lengths):
            return fixed
        x = int(lengths[-1])
        others = count.copy()
        others[x] -= 1
        there = np.flatnonzero(others)
        room = capacity - x
        least = np.repeat(there, np.minimum(others[there], 3))[:3]
        if not len(least) or least[0] > room:
            # Nothing fits beside x; and if it is so for one, it is so for all pieces of the length.
            fix((x,), int(count[x]) if 2 * x > capacity else 1)
            continue
        best = int(there[there <= room][-1])
        alone = len(least) < 2 or least[0] + least[1] > room
        if not alone and (len(least) < 3 or least.sum() > room):
            alone = best >= best_pair(others, room)
        if not alone:
            return fixed
        fix((x, best), int(min(count[x], count[best])) if x != best else int(count[x] // 2))


def best_pair(count: np.ndarray, room: int) -> int:
    """The greatest sum of two pieces that is at most room; 0 if no two fit."""
    lengths = np.flatnonzero(count)
    best, i, j = 0, 0, len(lengths) - 1
    while i <= j:
        if i == j and count[lengths[i]] < 2:
            break
        total = int(lengths[i] + lengths[j])
        if total > room:
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def best_fit(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Longest pieces first, each where the least room is left that takes it; equal pieces and equal sequences at a time."""
    open_by_room: dict[int, list[Pattern]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: tuple[tuple[int, int], ...], times: int) -> None:
        if room not in open_by_room:
            bisect.insort(rooms, room)
        open_by_room[room].append((pattern, times))

    for x in np.flatnonzero(count)[::-1].tolist():
        left = int(count[x])
        while left:
            k = bisect.bisect_left(rooms, x)
            if k < len(rooms):
                room = rooms[k]
                pattern, times = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room], rooms[k]
            else:
                room, pattern, times = capacity, (), left
            each = room // x
            full = min(times, left // each)
            if full:
                put(room - each * x, (*pattern, (x, each)), full)
                left -= full * each
                times -= full
            if left and times:
                put(room - left * x, (*pattern, (x, left)), 1)
                left = 0
                times -= 1
            if times and pattern:
                put(room, pattern, times)
    return [p for room in rooms for p in open_by_room[room]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold every piece of a histogram of lengths exactly once."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    return [*reduce(count, capacity), *best_fit(count, capacity)]


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of a length go by rank: (length, first rank, end rank, pieces a sequence, first sequence, offset)."""
    out, used, first = [], defaultdict(int), 0
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            out.append((length, used[length], used[length] + times * each, each, first, offset))
            used[length] += times * each
            offset += length * each
        first += times
    return out


def numbered(cut: DataFrame, stages: Stages) -> DataFrame:
    """The pieces as a written table, each with a number of its own, row."""
    return stages.write(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")


def pack(cut: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. cut is read several times: a table from `numbered`."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    places = slots(plan(histogram, capacity))
    counts = spark.createDataFrame([(k, min(CELLS, -(-n // CELL))) for k, n in histogram.items()], "length long, cells long")
    placed = spark.createDataFrame(places, "length long, first long, end long, each long, sequence long, base long")
    salted = cut.join(F.broadcast(counts), "length").withColumn("cell", F.pmod(F.xxhash64("row"), F.col("cells"))).drop("cells")
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = salted.groupBy("length", "cell").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "cell").orderBy("row")) - 1)
    ranked = ranked.join(cells, ["length", "cell"]).withColumn("rank", F.col("rank") + F.col("before")).drop("cell", "before")
    inside = (ranked["length"] == placed["length"]) & (ranked["rank"] >= placed["first"]) & (ranked["rank"] < placed["end"])
    index = F.col("rank") - F.col("first")
    return ranked.join(broadcast_if_small(placed, len(places), 48), inside).select(
        *(ranked[c] for c in cut.columns if c != "row"),
        (F.col("sequence") + F.floor(index / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + (index % F.col("each")) * placed["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their places: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = numbered(pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), Stages(docs.sparkSession))
    return pack(cut, capacity=capacity).withColumnRenamed("id", id_col)


def sequences(placed: DataFrame) -> DataFrame:
    """The sequences themselves, from placed pieces with ids: sequence_id and the ids as binary, in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    return placed.groupBy("sequence_id").agg(F.concat_ws("", F.transform(parts, lambda b: F.hex(b))).alias("hexed")).select("sequence_id", F.unhex("hexed").alias("ids"))
