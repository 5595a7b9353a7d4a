"""Personal data: fixed patterns, and candidates that boosted trees accept.

Generators propose spans that may overlap (loose addresses, groups of digits, bank and device numbers). Boosted trees
score each from its format and the words around it; a kind's candidates are accepted from a threshold that keeps the
precision at PRECISION on candidates that the trees were not fitted to. Of overlapping accepted spans the likeliest stays,
and none that overlaps a span of the fixed patterns is added.

The trees are fitted here, once a driver, to generated lines: there is no labelled table of personal data. The lines mix
personal data in many formats with what looks like it: dates, versions, amounts, page ranges, part numbers, formulas.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows each get their row.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestone.llm import boosting, textkit
from lodestone.session import ship

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the spans that the trees add.
ADDED = ("more_email", "more_ip", "more_card", "more_phone", "more_account")
PRECISION = 0.99

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match starts at a run of digits' first one or nowhere in it, so the look-behind changes no match.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local characters that ends at an @ after the last match, and the domain behind it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns."""
    spans = [(a, "email", b) for a, b in emails(text)]
    spans += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            spans.append((m.start(), "card", m.end()))
    spans += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return spans


_AT = r"(?:@|\(at\)|\[at\]|\{at\}|\bat\b|\(a\))"
_DOT = r"(?:\.|\(dot\)|\[dot\]|\bdot\b|\(punkt\))"
GENERATORS = {
    "more_email": re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}\x20?{_AT}\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?{_DOT}\x20?[A-Za-z0-9-]{{1,63}}){{1,4}}", re.IGNORECASE | re.ASCII),
    "more_ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "more_card": re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./-]?[0-9]{4}){2}(?:[\x20./-]?[0-9]{1,7})?(?![0-9])"),
    "more_phone": re.compile(r"(?<![0-9.])[+(]?[0-9][0-9().\x20/-]{5,22}[0-9](?![0-9])"),
    "more_account": re.compile(r"\b(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?|[0-9]{3}-[0-9]{2}-[0-9]{4})\b", re.ASCII),
}
#: What a text needs for any pattern or generator: an address sign, a digit, or the middle of what else a generator fits.
_MAY_HAVE = rf"[0-9@]|(?i:[A-Z0-9._%+-]\x20?{_AT}\x20?[A-Z0-9-]{{1,63}}\x20?{_DOT}\x20?[A-Z0-9-])|(?:[A-Fa-f]{{1,4}}:){{3}}[A-Fa-f]"

_CONTEXT = (
    re.compile(r"phone|call|tel|mobil|cell|fax|whatsapp|ring|contact|dial|sms", re.IGNORECASE),
    re.compile(r"mail|write to|contact|address|reach|schreib|correo|courriel", re.IGNORECASE),
    re.compile(r"card|visa|master|amex|credit|debit|kart|carte|tarjeta", re.IGNORECASE),
    re.compile(r"ssn|social|iban|account|konto|compte|cuenta|passport|tax id|insurance|bank", re.IGNORECASE),
    re.compile(r"\bip\b|host|server|address|ping|login from|device|mac\b", re.IGNORECASE),
    re.compile(r"page|vol|isbn|version|fig|table|chapter|year|order|ref|part|item|build|release|date|since|from|between|score|sum|total|\bid\b|serial|[$€£#%*/=]\s*$", re.IGNORECASE),
)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./](?:0?[1-9]|1[0-2])[-./](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[-./](?:0?[1-9]|1[0-2])[-./](?:19|20)[0-9]{2}")
_BRACKETED = re.compile(r"[(\[{]a", re.IGNORECASE)
_WRITTEN_DOT = re.compile(r"\bdot\b|\(punkt\)", re.IGNORECASE)
_BARE_AT = re.compile(r"\x20at\x20", re.IGNORECASE)
_YEARS = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 3]
    d = _digits(s)
    groups = re.findall("[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    letters = sum(c.isalpha() for c in s)
    around = text[max(0, start - 60) : start] + text[end : end + 60]
    last = re.split(r"[^A-Za-z0-9]+", s)[-1]
    return [
        ADDED.index(kind), len(s), len(d), letters, sum(c.isupper() for c in s), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        s[0] == "+", "(" in s, s.count("-"), s.count("."), s.count(" "), "/" in s, s.count(":"), "@" in s, bool(_BRACKETED.search(s)), bool(_WRITTEN_DOT.search(s)), bool(_BARE_AT.search(s)),
        len(set(d)), len(d) >= 12 and luhn(d), last.isalpha() and 2 <= len(last) <= 6, bool(_DATE.search(s)), len(_YEARS.findall(s)),
        before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in ("$", "€", "£", "#", "*", "=", "/"), after[:1] in ("%", "*", "=", "/", "€"),
        *(bool(c.search(before)) for c in _CONTEXT), sum("0" <= c <= "9" for c in around) / max(len(around), 1),
    ]


def candidates(text: str) -> list[tuple[int, str, int]]:
    return [(m.start(), kind, m.end()) for kind, g in GENERATORS.items() for m in g.finditer(text)]


def generated(n: int = 4000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """Lines with one span each: text, start, end, and 1 for personal data or 0 for what looks like it."""
    r = random.Random(seed)
    dig = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "th", "on", "ti", "es", "la", "re", "mi", "do", "ch", "be")) for _ in range(r.randint(1, 4)))
    up = lambda k: "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ0123456789") for _ in range(k))

    def card() -> str:
        d = r.choice("3456") + dig(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice((".", "/", "")).join(d[i : i + 4] for i in range(0, 16, 4))

    yes = (
        (lambda: f"{word()}{r.choice(('.', '_', '', '-'))}{word()} {r.choice(('(at)', '[at]', 'at', '(a)'))} {word()}{r.choice((' dot ', ' (dot) ', '[dot]'))}{r.choice(('com', 'org', 'net', 'de', 'fr'))}", ("mail ", "write to ", "contact ", "reach me: ", "")),
        (lambda: f"{word()}@{word()} {r.choice(('dot', '(dot)', '[dot]'))} {r.choice(('com', 'org', 'es'))}", ("e-mail: ", "")),
        (lambda: f"({dig(3)}) {dig(3)}-{dig(4)}", ("call ", "phone: ", "tel. ", "")),
        (lambda: f"{dig(3)}-{dig(3)}-{dig(4)}", ("call ", "phone: ", "mobile ", "fax ", "")),
        (lambda: f"0{dig(2)} {dig(3)} {dig(4)}", ("call ", "tel: ", "whatsapp ", "dial ")),
        (lambda: f"0{dig(3)}/{dig(6)}", ("Telefon ", "tel: ", "mobil ")),
        (lambda: ":".join("%x" % r.randint(0, 65535) for _ in range(8)), ("ip ", "host ", "server ", "login from ")),
        (card, ("card ", "visa: ", "credit card ", "")),
        (lambda: f"{r.choice(('DE', 'FR', 'ES', 'GB'))}{dig(2)} {dig(4)} {dig(4)} {dig(4)} {dig(4)} {dig(2)}", ("iban ", "account: ", "Konto ", "")),
        (lambda: f"{dig(3)}-{dig(2)}-{dig(4)}", ("ssn ", "social security ", "ssn: ")),
    )
    no = (
        (lambda: f"{word()} at {word()}. {word().title()}", ("", "mail ", "contact ", "write to ")),
        (lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", ("on ", "date ", "since ", "")),
        (lambda: f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1900, 2030)}", ("am ", "from ", "")),
        (lambda: f"{r.randint(1900, 2020)} - {r.randint(1900, 2030)}", ("between ", "", "years ")),
        (lambda: f"{dig(3)} {dig(3)} {dig(3)}", ("total ", "sum of ", "", "$")),
        (lambda: f"{dig(2)}.{dig(3)}.{dig(3)}", ("$", "€", "total ", "")),
        (lambda: f"{dig(4)} {dig(4)} {dig(4)} {dig(4)}", ("part ", "serial ", "item ", "table ")),
        (lambda: f"978-{dig(1)}-{dig(3)}-{dig(5)}-{dig(1)}", ("isbn ", "ISBN: ")),
        (lambda: f"{dig(1)}.{dig(2)}.{dig(2)}.{dig(4)}", ("version ", "release ", "build ")),
        (lambda: " ".join(dig(r.randint(1, 3)) for _ in range(r.randint(4, 8))), ("", "scores ", "table ")),
        (lambda: f"{dig(r.randint(8, 16))}", ("", "order ", "ref ", "id ", "#")),
        (lambda: f"{word()} at {word()}.{word()}", ("", "we ", "was ", "look ", "the ")),
        (lambda: f"{word()} at the {word()}. {word().title()}", ("", "was ")),
        (lambda: ":".join(dig(2) for _ in range(4)), ("at ", "time ", "")),
        (lambda: f"{r.choice('ABCD')}{r.choice('EFGH')}{dig(2)}{up(8)}", ("part ", "item ", "build ", "ref ")),
        (lambda: f"{dig(3)}-{dig(2)}-{dig(4)}", ("part ", "item ", "catalog ", "version ")),
        (lambda: f"{dig(1)}{r.choice((' / ', '/', '-'))}{dig(6)}", ("fig ", "score ", "=")),
        (lambda: f"{dig(3)}.{dig(3)}.{dig(3)}", ("", "total ")),
    )
    out = []
    for i in range(n):
        label = i % 2
        make, leads = r.choice(yes if label else no)
        lead = " ".join(word() for _ in range(r.randint(0, 8))) + " " + r.choice(leads)
        s = make()
        out.append((lead + s + r.choice((" ", ", ", ". ", "\n")) + " ".join(word() for _ in range(r.randint(0, 8))), len(lead), len(lead) + len(s), label))
    return out


@cache
def trained() -> tuple[boosting.Trees, dict[str, float]]:
    """The trees, and for each kind the probability from which a candidate is accepted."""
    x, y, kinds = [], [], []
    for text, start, end, label in generated():
        for a, kind, b in candidates(text):
            if a < end and b > start:
                x.append(features(text, kind, a, b))
                # A candidate of personal data must cover most of it and little else.
                y.append(int(label and a <= start + 1 and b >= end - 1 and b - a <= end - start + 4))
                kinds.append(kind)
    x, y, kinds = np.array(x, float), np.array(y, float), np.array(kinds)
    part = np.arange(len(y)) % 3
    model = boosting.fit(x[part == 0], y[part == 0])
    boosting.calibrate(model, x[part == 1], y[part == 1])
    p, bounds = model.probabilities(x), {}
    for kind in ADDED:
        held = (part == 2) & (kinds == kind)
        order = np.argsort(-p[held])
        precise = np.cumsum(y[held][order]) / np.arange(1, held.sum() + 1) >= PRECISION
        bounds[kind] = max(0.5, float(p[held][order][np.flatnonzero(precise)[-1]])) if precise.any() else 1.1
    return model, bounds


def text_spans(text: str, model: boosting.Trees, bounds: dict[str, float]) -> list[tuple[int, str, int]]:
    """All spans of a text, by start, then kind."""
    spans = base_spans(text)
    taken = sorted((a, b) for a, _, b in spans)
    starts = [a for a, _ in taken]
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)

    def free(a: int, b: int) -> bool:
        k = int(np.searchsorted(starts, b))
        return k == 0 or ends[k - 1] <= a

    proposed = [c for c in candidates(text) if free(c[0], c[2])]
    if proposed:
        p = model.probabilities(np.array([features(text, k, a, b) for a, k, b in proposed], float))
        accepted = sorted(((-q, c) for q, c in zip(p, proposed, strict=True) if q >= bounds[c[1]]), key=lambda t: (t[0], t[1]))
        covered: list[tuple[int, int]] = []  # in order, none over another
        for _, (a, kind, b) in accepted:
            k = bisect.bisect_left(covered, (b, b))  # those that start before this one ends
            if k == 0 or covered[k - 1][1] <= a:
                covered.insert(k, (a, b))
                spans.append((a, kind, b))
    order = {k: i for i, k in enumerate((*KINDS, *ADDED))}
    return sorted(spans, key=lambda s: (s[0], order[s[1]]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and spans, an array of (kind, start, end) in code points, by start then kind."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bounds = shared.value
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            found: list[list[dict]] = [[] for _ in range(len(texts))]
            for i in map(int, np.flatnonzero(np.asarray(pc.match_substring_regex(texts, _MAY_HAVE)))):
                found[i] = [{"kind": k, "start": a, "end": b} for a, k, b in text_spans(texts[i].as_py(), model, bounds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(SPAN))], ["id", "spans"])

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(textkit.tidy(run), f"id {key}, spans array<struct<kind:string,start:bigint,end:bigint>>")
