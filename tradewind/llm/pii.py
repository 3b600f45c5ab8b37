"""Personal data: fixed detectors, and boosted trees over high-recall candidate spans."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, boost
from .text import slices

KINDS = ("email", "ip", "card", "phone")
#: Documents (by a hash of the id) whose candidates the trees are fitted on.
SAMPLE_DOCUMENTS = 2000
#: Code points of context on either side of a span that is rewritten for training.
AROUND = 100

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

#: High-recall generators: kind of the span they propose, and its loose form. Each is linear in the text.
GENERATORS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]{1,63}+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]{1,63}+){1,8}+")),
    ("ip", re.compile(r"(?<![0-9.:])[0-9]{1,3}+(?:[.:][0-9]{1,3}+){2,7}+")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}+(?:[\x20.-]?[0-9]{2,6}+){2,4}+(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\+|00|\()?[0-9]{2,4}+(?:[\x20().-]{1,2}+[0-9]{2,5}+){1,5}+(?![0-9])")),
)
_TRIGGER = re.compile(r"[0-9@]|\(at\)|\[at\]")
_HINTS = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "pay", "account"), "phone": ("tel", "phone", "call", "fax", "mobile")}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed detectors' spans (kind, start, end), by kind as listed, then start; code points."""
    out = [("email", s, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans the generators propose, in order of kind and start."""
    if not _TRIGGER.search(text):
        return []
    return [(kind, *m.span()) for kind, pattern in GENERATORS for m in pattern.finditer(text)]


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    s = text[start:end]
    digits = _DIGITS.findall(s)
    groups = re.findall(r"[0-9]+", s)
    before, after = text[max(0, start - 24) : start].lower(), text[end : end + 2]
    return [
        *(float(kind == k) for k in KINDS),
        float(len(s)),
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(s.count("@")),
        float(s.count(".")),
        float(s.count("-") + s.count(" ")),
        float(s.count("(") + s.count(")")),
        float(s.startswith("+")),
        float(bool(digits) and len(digits) < 40 and luhn("".join(digits))),
        float(bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(len(re.split(r"[.\x20]", s)[-1])),
        float(any(w in before for w in _HINTS[kind])),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before[-1:].isspace() or not before),
        float(bool(re.search(r"[A-Za-z]{2,}$", s))),
        float(s.count(":")),
        float(bool(re.search(r"\.\s", s))),
        float(bool(_DATE.search(s))),
        float(bool(re.fullmatch(r"[0-9]{1,3}(?:[.\x20][0-9]{3})+", s))),
    ]


_DATE = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9]|[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2})(?![0-9])")


def _overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether [start, end) meets one of the disjoint, sorted spans."""
    i = bisect_left(spans, (end, -1))
    return i > 0 and spans[i - 1][1] > start


def unmet(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The candidates that meet none of the base spans."""
    # Fixed detectors of different kinds may overlap; join them so that lookups need one comparison.
    merged: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return [c for c in candidates(text) if not _overlaps(merged, c[1], c[2])]


def loose_forms(kind: str, s: str) -> list[str]:
    """Other writings of a confirmed span, which the fixed detectors do not know."""
    if kind == "email":
        name, _, host = s.partition("@")
        return [f"{name} (at) {host.replace('.', ' (dot) ')}", f"{name}[at]{host.replace('.', '[dot]')}", f"{name}(at){host}", f"{name} @ {host}"]
    if kind == "ip":
        return [s.replace(".", ":")]
    if kind == "card":
        d = re.sub(r"[^0-9]", "", s)
        return [".".join(d[i : i + 4] for i in range(0, len(d), 4)), f"{d[:4]}.{d[4:10]}.{d[10:]}"]
    return [s[1:], "00" + s[1:], re.sub(r"[\x20()-]+", ".", s[1:]), re.sub(r"[\x20().-]+", " ", s[1:])]


def plain_forms(kind: str, draw: random.Random) -> list[str]:
    """Writings the generator of ``kind`` proposes that are clearly not personal: dates, times, amounts, versions, failed check digits."""
    n = draw.randint
    year, month, day = n(1900, 2099), n(1, 12), n(1, 28)
    if kind == "email":
        return [f"{n(1, 99)} @ {n(1, 99)}.{n(10, 99)}", f"items @ {n(1, 99)}.{n(10, 99)}", f"opens (at) {n(1, 23)}.{n(10, 59)}", "met @ noon. Then"]
    if kind == "ip":
        return [f"{n(0, 23):02d}:{n(0, 59):02d}:{n(0, 59):02d}", f"{n(0, 23):02d}:{n(0, 59):02d}:{n(0, 59):02d}:{n(0, 24):02d}", f"{n(0, 20)}.{n(0, 20)}.{n(0, 20)}", f"{n(256, 999)}.{n(0, 255)}.{n(256, 999)}.{n(0, 255)}", f"{day}.{month}.{year % 100:02d}"]
    if kind == "card":
        d = str(n(10**15, 10**16 - 1))
        d = d[:-1] + next(c for c in "01" if not luhn(d[:-1] + c))
        return [".".join(d[i : i + 4] for i in range(0, 16, 4)), f"{d[:4]}.{d[4:10]}.{d[10:]}", d, str(n(10**9, 10**11)), f"{year}-{month:02d}-{day:02d}", f"{year}{month:02d}{day:02d}{n(0, 235959):06d}"]
    return [
        f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{year}-{year + n(1, 30)}", f"{n(10, 9999)}.{n(10, 99)}", f"{n(10, 99)} {n(10, 99)}", f"{n(10, 999)}.{n(100, 999)}.{n(100, 999)}", f"{n(10, 999)} {n(100, 999)} {n(100, 999)}",
        f"{n(100, 999)}-{n(100, 999)}", f"{n(10, 23)}.{n(10, 59)}-{n(10, 23)}.{n(10, 59)}", f"{year}-{month:02d}-{day:02d} {n(10, 23)}", ".".join(str(n(1000, 9999)) for _ in range(4)),
    ]


def clearly_plain(kind: str, s: str) -> bool:
    """Whether a candidate of ``kind`` cannot be one in any writing: wrong number of digits, failed check digit, no host."""
    digits, groups = "".join(_DIGITS.findall(s)), re.findall(r"[0-9]+", s)
    if kind == "email":
        return not re.search(r"[A-Za-z]{2,}$", s)
    if kind == "ip":
        return len(groups) != 4 or any(int(g) > 255 for g in groups)
    if kind == "card":
        return not 13 <= len(digits) <= 19 or not luhn(digits)
    return not 7 <= len(digits) <= 15 or bool(_DATE.search(s))


def examples(text: str) -> list[tuple[str, int, int, list[float]]]:
    """Training rows (kind, label, group, features) of a text; a group is never split between fit and calibration.

    Positive: a confirmed span in a loose form, in its own context. Negative: formats that are clearly not
    personal, in the same context and at another word gap, and candidates of the text that are clearly
    plain. All other candidates that no detector meets are unlabelled and give no row.
    """
    base, out = base_spans(text), []
    out += [(c[0], 0, crc32(text[max(0, c[1] - AROUND) : c[2]].encode()) & 0x7FFFFFFF, features(text, c)) for c in unmet(text, base) if clearly_plain(c[0], text[c[1] : c[2]])]

    def put(kind: str, label: int, group: int, start: int, end: int, form: str) -> None:
        left = text[max(0, start - AROUND) : start]
        near, s, e = left + form + text[end : end + AROUND], len(left), len(left) + len(form)
        found = base_spans(near)
        for c in candidates(near):
            if s <= c[1] and c[2] <= e and not any(b[1] < c[2] and b[2] > c[1] for b in found):
                if label and c[0] == kind:
                    out.append((kind, 1, group, features(near, c)))
                elif not label or clearly_plain(c[0], near[c[1] : c[2]]):
                    out.append((c[0], 0, group, features(near, c)))

    for kind, start, end in base:
        group = crc32(text[max(0, start - AROUND) : end].encode()) & 0x7FFFFFFF
        for form in loose_forms(kind, text[start:end]):
            put(kind, 1, group, start, end, form)
        draw = random.Random(group)
        gap = text.find(" ", group % len(text)) + 1
        for form in plain_forms(kind, draw):
            put(kind, 0, group, start, end, form)
            put(kind, 0, group, gap, gap, form + " ")
    return out


@dataclass
class ByKind:
    """Boosted trees of each kind, each with its own calibration and threshold."""

    kinds: dict[str, Boosted] = field(default_factory=dict)

    @property
    def threshold(self) -> float:
        """The least threshold; above 1 when nothing can be selected."""
        return min((m.threshold for m in self.kinds.values()), default=1.1)


def train(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCUMENTS, **options) -> ByKind:
    """Fit the trees of every kind on ``examples`` of a hash sample of documents.

    No span is marked by hand, so a kind without confirmed spans in the sample selects nothing. One of
    four groups calibrates and sets the threshold of its kind. The sample draws ``sample`` rows in
    expectation (all, if fewer), looks only at rows with an ``@`` or a digit, and is the bound on what
    reaches the driver.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(r"[0-9@]"))
    share = min(1.0, sample / max(1, rows.count()))
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id", F.xxhash64("text")), F.lit(1 << 30)) / float(1 << 30)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [x for t in batch.column("text").to_pylist() for x in examples(t)]
            kinds, ys, groups, xs = zip(*found) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(ys, pa.int32()), pa.array(groups, pa.int32()), pa.array(xs, pa.list_(pa.float64()))], names=["kind", "y", "g", "x"])

    found = sorted(tuple(r) for r in rows.where(draw < share).select("text").mapInArrow(collect, "kind string, y int, g int, x array<double>").collect())
    out = ByKind()
    for kind in KINDS:
        own = [r for r in found if r[0] == kind]
        # Groups are dealt in order of their hash, so that a quarter of them is set aside however few there are.
        of = {g: i for i, g in enumerate(sorted({r[2] for r in own if r[1]}) + sorted({r[2] for r in own} - {r[2] for r in own if r[1]}))}
        if own:
            out.kinds[kind] = boost(np.array([r[3] for r in own]), np.array([r[1] for r in own], dtype=int), aside=np.array([of[r[2]] % 4 == 3 for r in own]), **options)
    return out


def scan(text: str | None, model: Boosted | ByKind) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans the trees add): candidates at or over the threshold of their kind that meet no base span.

    Of overlapping candidates the likelier stays, then the longer, then the earlier.
    """
    text = text or ""
    base = base_spans(text)
    new = unmet(text, base)
    if not new or model.threshold > 1:
        return base, []
    p, least = np.zeros(len(new)), np.full(len(new), 1.1)
    for kind in KINDS:
        own = model.kinds.get(kind) if isinstance(model, ByKind) else model
        if own and (at := [i for i, c in enumerate(new) if c[0] == kind]):
            p[at], least[at] = own.probability(np.array([features(text, new[i]) for i in at])), own.threshold
    added: list[tuple[str, int, int]] = []
    held: list[tuple[int, int]] = []
    for i in sorted(np.flatnonzero(p >= least), key=lambda i: (-p[i], new[i][1] - new[i][2], new[i][1])):
        kind, s, e = new[i]
        if not _overlaps(held, s, e):
            held.insert(bisect_left(held, (s, e)), (s, e))
            added.append((kind, s, e))
    return base, added


_SPAN = "struct<kind:string,start:long,end:long>"


def find(documents: DataFrame, model: Boosted | ByKind, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, base (spans), added (spans of the method).

    Spans are (kind, start, end) in code points, end exclusive, by kind as listed and then start.
    Null and empty texts have none; texts of any length are read whole; repeated rows stay; an empty
    table gives an empty result; extra columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    rank = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = [scan(t, shared.value) for t in batch.column("text").to_pylist()]
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in sorted(x[i], key=lambda s: (rank[s[0]], s[1]))] for x in both], pa.list_(span)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "base", "added"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, base array<{_SPAN}>, added array<{_SPAN}>")
