"""Secret scan: known forms, and the entropy of sliding windows over candidates.

Known forms (assignments, access keys, hex runs) are found by pattern. The
method then looks at every candidate, a long run of token characters, without
regard to what stands before it: a window slides over it, and for each
character class (hex, base 64) the Shannon entropy of the window is kept by
incremental counts, adding the character that enters and taking away the one
that leaves. Windows over the class's threshold that overlap make one span. The
allow-list suppresses what is harmless: a candidate of a known shape as a whole,
and the segments (between "/" and "=") that a span begins or ends with if they
are words or placeholders, so that a harmless path does not hide the key behind
it. A span that a known form covers already is left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .frames import with_fields
from .words import chunks

# The known forms and the least length of what each must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# Character classes and the entropy in bits a window must reach. Twenty
# different characters have 4.32 bits, sixteen hex digits at most 4.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 3.2),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 3.9),
)
SHAPES = (
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # a UUID
    re.compile(r"[0-9+/_=-]+"),  # numbers, dates, rules
    re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[/_=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[/_=+-]*"),  # words, names and paths
)
PLACEHOLDER = re.compile(r"(?i)example|placeholder|changeme|xxxxxx|abcdefgh|12345678")
SEGMENT = re.compile(r"[^/=]+")

SPAN = StructType([StructField("kind", StringType(), False), StructField("start", LongType(), False), StructField("end", LongType(), False)])
FIELD = StructField("secrets", ArrayType(SPAN, False), False)


def _terms(window: int) -> list[float]:
    """n * log2(n): the part of the entropy that one character with count n adds."""
    return [n * math.log2(n) if n else 0.0 for n in range(window + 2)]


_TERMS = {WINDOW: _terms(WINDOW)}


def entropy_spans(text: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Where windows reach their class's threshold: overlapping windows are one span."""
    ends: set[int] = set()
    term = _TERMS.get(window) or _TERMS.setdefault(window, _terms(window))
    for _, members, least in CLASSES:
        counts: dict[str, int] = {}
        outside, total = 0, 0.0
        limit = math.log2(window) - least  # entropy = log2(w) - sum(n log2 n) / w
        for i, char in enumerate(text):
            n = counts.get(char, 0)
            total += term[n + 1] - term[n]
            counts[char] = n + 1
            outside += char not in members
            if i >= window:
                gone = text[i - window]
                n = counts[gone]
                total += term[n - 1] - term[n]
                counts[gone] = n - 1
                outside -= gone not in members
            if i >= window - 1 and not outside and total / window <= limit + 1e-9:
                ends.add(i + 1)
    spans: list[tuple[int, int]] = []
    for end in sorted(ends):
        if spans and end - window <= spans[-1][1]:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((end - window, end))
    return spans


def entropy_span(text: str, window: int = WINDOW) -> tuple[int, int] | None:
    """From the first to the end of the last window over its class's threshold."""
    spans = entropy_spans(text, window)
    return (spans[0][0], spans[-1][1]) if spans else None


def shaped(candidate: str) -> bool:
    """The candidate as a whole is harmless by its shape."""
    return any(form.fullmatch(candidate) for form in SHAPES)


def _harmless(segment: str) -> bool:
    return shaped(segment) or PLACEHOLDER.search(segment) is not None


def without_harmless(candidate: str, low: int, high: int, least: int = ASSIGN_LEAST) -> tuple[int, int] | None:
    """The span less the harmless segments at its ends, or None if too little is left."""
    segments = [(m.start(), m.end()) for m in SEGMENT.finditer(candidate) if m.start() < high and m.end() > low]
    while segments and _harmless(candidate[slice(*segments[0])]):
        segments.pop(0)
    while segments and _harmless(candidate[slice(*segments[-1])]):
        segments.pop()
    if not segments:
        return None
    low, high = max(low, segments[0][0]), min(high, segments[-1][1])
    return (low, high) if high - low >= least else None


def find_secrets(text: str, window: int = WINDOW) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as in ``KINDS``."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    known = [(s, e) for _, s, e in found]
    for match in CANDIDATE.finditer(text):
        run = match[0]
        if run.islower() and run.isalpha() or shaped(run):
            continue
        for reached in entropy_spans(run, window):
            span = without_harmless(run, *reached)
            if span:
                low, high = match.start() + span[0], match.start() + span[1]
                if not any(s <= low and high <= e for s, e in known):
                    found.append(("entropy", low, high))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def scan_secrets(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``secrets``, an array of (kind, start, end), end exclusive.

    Places are code points of the whole text. Null and empty texts have none;
    every row is scanned alone, so repeated rows repeat their result. A column
    already named ``secrets`` gives way.
    """
    schema = with_fields(docs, FIELD)
    names = schema.fieldNames()
    span = pa.struct([pa.field("kind", pa.string(), False), pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text):
                found = [find_secrets(t, window) if t else [] for t in batch.column(text).to_pylist()]
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in found]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:-1]] + [pa.array(spans, pa.list_(pa.field("element", span, False)))], names=names)

    return docs.mapInArrow(scan, schema)


def redact_secrets(scanned: DataFrame, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """The texts of ``scan_secrets`` with every span replaced by ``mark``; ``secrets`` is dropped."""
    # Spans may overlap: what lies before the end of an earlier one is left out.
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state, span):
        gap = F.substring(F.col(text), (state["at"] + 1).cast("int"), F.greatest(span["start"] - state["at"], F.lit(0)).cast("int"))
        fresh = span["start"] >= state["at"]
        return F.struct(F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"), F.greatest(state["at"], span["end"]).alias("at"))

    def finish(state):
        return F.concat(state["out"], F.substring(F.col(text), (state["at"] + 1).cast("int"), F.length(text)))

    return scanned.withColumn(text, F.when(F.col(text).isNotNull(), F.aggregate("secrets", start, step, finish))).drop("secrets")


def spans_text(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
