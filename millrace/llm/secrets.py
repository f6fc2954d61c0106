"""Secret scans: sliding-window Shannon entropy per character class, over candidate strings.

Three base kinds are found by pattern. Beyond them, every token of LEAST characters or more outside
the base spans is a candidate. It belongs to the narrowest character class that holds it (hex digits,
one case, mixed); a window slides over it and its entropy follows from counts that change by one
character in and one out. A token whose best window reaches what all but MISSED of random tokens of
its class and length reach is a secret of kind ``entropy``, unless the allow-list clears it.

Defined cases: null text is empty; a document without findings has empty lists, whose digest is
that of the empty string; repeated rows and null doc_ids are scanned each by itself; spans that begin
together are ordered by kind, and a candidate that touches a base span gives way; texts of any length
are scanned whole, in time in proportion to their length; empty table: empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import on_workers

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # shorter runs would be dropped in any case
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

WINDOW = 20
LEAST = 16
#: Characters by class, narrowest first; a token belongs to the first that holds all of it.
CLASSES = {
    "lower hex": "0123456789abcdef", "upper hex": "0123456789ABCDEF", "lower": "0123456789abcdefghijklmnopqrstuvwxyz", "upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "mixed": "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-",
}
#: Share of random tokens that may stay under the threshold of their class and length.
MISSED = 0.01
ALLOWED = re.compile(
    r"[a-z]+|[A-Z]+|[0-9]+"  # words and numbers
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUIDs
    r"|[A-Za-z]+(?:[-_/=+][A-Za-z]+)+|[0-9]+(?:[-_/=+][0-9]+)+"  # hyphenated words, paths, dates
    r"|.*(?i:example|sample|dummy|placeholder|changeme).*"
)
#: Letters alone are a name in camel case unless more of their neighbours than this differ in case.
CASE_CHANGES = 0.3
_LOG = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


@lru_cache(maxsize=None)
def threshold(kind: str, length: int) -> float:
    """The entropy that all but MISSED of random tokens of a class and length reach, by simulation
    from a fixed seed; from three windows on, longer tokens are held to the same bound."""
    length = min(length, 3 * WINDOW)
    r = random.Random(f"{kind}/{length}")
    found = sorted(best_entropy("".join(r.choices(CLASSES[kind], k=length)), min(WINDOW, length)) for _ in range(500))
    return found[int(MISSED * len(found))] - 1e-9


def best_entropy(token: str, window: int = WINDOW) -> float:
    """Largest Shannon entropy, in bits a character, of any ``window`` characters of the token; 0 in a
    shorter one."""
    if len(token) < window:
        return 0.0
    counts: dict[str, int] = {}
    total, least = 0.0, math.inf  # total: the sum of c * log2(c)
    logs = _LOG if window <= WINDOW else [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    for i, c in enumerate(token):
        if i >= window:
            old = token[i - window]
            n = counts[old]
            total += logs[n - 1] - logs[n]
            counts[old] = n - 1
        n = counts.get(c, 0)
        total += logs[n + 1] - logs[n]
        counts[c] = n + 1
        if i >= window - 1:
            least = min(least, total)
    return max(math.log2(window) - least / window, 0.0)


def is_secret(token: str) -> bool:
    if len(token) < LEAST or ALLOWED.fullmatch(token) or not any(c.isalpha() for c in token):
        return False
    if token.isalpha() and sum(a.islower() != b.islower() for a, b in pairwise(token)) <= CASE_CHANGES * len(token):
        return False
    kind = next(k for k, held in _HELD.items() if held.issuperset(token))
    return best_entropy(token, min(WINDOW, len(token))) >= threshold(kind, len(token))


_HELD = {k: frozenset(v) for k, v in CLASSES.items()}


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted; code points, end exclusive."""
    return scan_and_confirm(text)[0]


def scan_and_confirm(text: str) -> tuple[list[tuple[int, int, int]], int]:
    """The spans, and how many tokens that touch base spans have a secret's entropy as well."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base, at, reach, confirmed = sorted(spans), 0, 0, 0  # reach: where the base spans that begin so far end
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if is_secret(m[0]):
            if reach <= m.start():
                spans.append((m.start(), 3, m.end()))
            else:
                confirmed += 1
    return sorted(spans), confirmed


def _write(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy, n_confirmed for every document."""
    on_workers(docs.sparkSession)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy", "n_confirmed"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                spans, confirmed = scan_and_confirm(text.as_py() or "")
                base = [x for x in spans if x[1] < 3]
                n = [sum(x[1] == k for x in spans) for k in range(4)]
                rows.append((doc_id.as_py(), *n[:3], hashlib.sha256(_write(base).encode()).hexdigest(), _write(spans), n[3], confirmed))
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long, n_confirmed long"
    )
