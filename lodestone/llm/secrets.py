"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Characters per token under a byte-pair vocabulary is high for words and identifiers, which the vocabulary knows in
large pieces, and low for random strings, which fall into pieces of one or two characters. Runs of key characters
are put to that test after known digests (hexadecimal of a digest's length) and identifiers (UUIDs, numbers, dates,
words in one case) are taken out.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows each get their row.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestone.llm import textkit
from lodestone.session import ship

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_WORDS = "(?i)password|passwd|secret|token|api_?key"

#: Key characters: runs of these are candidates of the token-efficiency test.
RUN_BYTES = np.zeros(256, bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-":
    RUN_BYTES[_c] = True
RUN = re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
DIGEST = re.compile("[0-9a-f]+|[0-9A-F]+")
IDENTIFIER = re.compile(
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    "|[0-9+/_=-]+"  # numbers, dates, rules
    "|[A-Z]?[a-z/_=+-]+|[A-Z/_=+-]+"  # words in one case, paths
)

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tiktoken vocabulary in a file of ranks, loaded once per worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns."""
    spans = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return spans


def is_random(run: str, vocabulary: str, ratio: float) -> bool:
    """Whether a run of key characters has fewer characters per token than ratio, and is no known digest or identifier."""
    core = run.strip("=/+_-")
    if len(core) < 16 or len(core) in DIGEST_LENGTHS and DIGEST.fullmatch(core) or IDENTIFIER.fullmatch(run):
        return False
    return len(core) < ratio * len(encoder(vocabulary).encode_ordinary(core))


def text_spans(text: str, vocabulary: str, ratio: float) -> list[tuple[int, str, int]]:
    """All spans of a text, by start, then kind; the test's spans overlap none of the fixed ones."""
    spans = base_spans(text)
    taken = sorted((a, b) for a, _, b in spans)
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
    starts = [a for a, _ in taken]
    for m in RUN.finditer(text):
        k = int(np.searchsorted(starts, m.end()))  # those that start before the run ends
        if (k == 0 or ends[k - 1] <= m.start()) and is_random(m.group(), vocabulary, ratio):
            spans.append((m.start(), "random", m.end()))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def suspicious(texts: pa.Array) -> np.ndarray:
    """Which texts may have a span: a quick test over bytes that misses none."""
    data, offsets = textkit.utf8(texts)
    hit = np.zeros(len(texts), bool)
    for i, _, part, at in textkit.blocks(data, offsets):
        starts, ends, runs = textkit.word_bounds(part, at, RUN_BYTES)
        long = np.flatnonzero(ends - starts >= 16)
        hit[i + np.searchsorted(runs, long, "right") - 1] = True
    return hit | np.asarray(pc.match_substring_regex(pc.fill_null(texts, ""), ASSIGN_WORDS))


def scan(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", ratio: float = 2.0, redact: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per document: id and spans, an array of (kind, start, end) in code points, by start then kind.

    With redact, a column text too, in which that string replaces each span (overlapping ones together). Columns in keep
    come along as they are. vocabulary is the path of a tiktoken file of ranks on every executor.
    """
    kept = [docs.schema[c] for c in keep or []]
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>" + (", text string" if redact is not None else "")
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found: list[list[tuple[int, str, int]]] = [[] for _ in range(len(texts))]
            changed: dict[int, str] = {}
            for i in map(int, np.flatnonzero(suspicious(texts))):
                text = texts[i].as_py() or ""
                found[i] = text_spans(text, vocabulary, ratio)
                if redact is not None and found[i]:
                    changed[i] = replace_spans(text, found[i], redact)
            out = [batch.column(0), pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in s] for s in found], pa.list_(SPAN))]
            if redact is not None:
                mask = np.zeros(len(texts), bool)
                mask[list(changed)] = True
                out.append(pc.replace_with_mask(texts, pa.array(mask), pa.array(list(changed.values()), texts.type)))
            names = ["id", "spans", "text"][: len(out)] + [f.name for f in kept]
            yield pa.RecordBatch.from_arrays(out + batch.columns[2:], names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *(docs[f.name] for f in kept)).mapInArrow(textkit.tidy(run), schema)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def replace_spans(text: str, spans: list[tuple[int, str, int]], by: str) -> str:
    """The text with each union of overlapping spans replaced."""
    out, end = [], 0
    for a, _, b in sorted(spans):
        if a >= end:
            out += [text[end:a], by]
        end = max(end, b)
    return "".join(out) + text[end:]


def spans_text(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)

