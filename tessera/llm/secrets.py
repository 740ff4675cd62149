"""Secret scans with multipart credential linking.

Strong findings stand alone: assignments of a long value to a secret-like name, AWS-style access
ids, long runs of hex digits.  Weak parts stand only together: an access identifier (a user,
client or account name that is assigned), a secret-looking token (long, of mixed classes, no
word), and an endpoint (a URL, host with port, or connection string).  Within a scope, the
paragraph and at most ``reach`` code points, identifiers, secrets and endpoints are interval-joined
by one sweep over their sorted places; a weak part is reported when a part that complements it is
in reach: a secret needs an identifier or endpoint, an identifier or endpoint needs a secret.
Strong findings act as parts too (access as identifier; assign and hex as secret).

A text is scanned once and whole in an Arrow pass; a document's parts never leave their row.

Edge cases: a null text is empty; kinds overlap freely, matches of one kind do not; equal parts
count each; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the strong kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Patterns of the weak kinds.
IDENT = re.compile(r"""\b(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?|tenant(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+|\b(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.-]+(?::\d{2,5})?|\b(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,63}:\d{2,5}\b""", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

KINDS = ("assign", "access", "hex", "ident", "endpoint", "secret")
REACH = 400
MIN_VALUE, MIN_ACCESS = 8, 16


def looks_secret(token: str) -> bool:
    """Mixed classes of characters, and many different ones: no word, no path, no number."""
    classes = (any(c.isdigit() for c in token), any(c.islower() for c in token), any(c.isupper() for c in token))
    return classes[0] and (classes[1] or classes[2]) and sum(c.isdigit() for c in token) >= 3 and len(set(token)) >= 10 and token.count("/") < 3


def base_spans(text: str, low: str) -> list[tuple[int, int, str]]:
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def weak_parts(text: str, low: str, strong: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak parts that no strong finding covers.  The costly token scan runs only where something
    could complement a token."""
    out = []
    marked = "=" in text or ":" in text
    if marked:
        out += [(*m.span(), "ident") for m in IDENT.finditer(text)]
        if "://" in text or re.search(r":\d", text) or any(w in low for w in ("host", "endpoint", "server", "url")):
            out += [(*m.span(), "endpoint") for m in ENDPOINT.finditer(text)]
    if out or any(k == "access" for _, _, k in strong):  # else a token has no complement
        out += [(*m.span(), "secret") for m in TOKEN.finditer(text) if looks_secret(m[0])]
    strong = sorted(strong)
    starts, reach = [s for s, _, _ in strong], []
    for s, e, _ in strong:
        reach.append(max(e, reach[-1] if reach else 0))
    # The running end makes "some strong span overlaps [s, e)" one bisection.
    return [(s, e, k) for s, e, k in out if not (i := bisect_left(starts, e)) or reach[i - 1] <= s]


ROLE = {"assign": "secret", "hex": "secret", "access": "ident", "ident": "ident", "endpoint": "endpoint", "secret": "secret"}


def linked(text: str, strong: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """The weak parts with a complement in reach within their paragraph."""
    if not weak:
        return []
    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    # Parts by role and paragraph, in order of their start, with the running greatest end: some
    # part meets [s - reach, e + reach] if the greatest end of those starting in time reaches back.
    scopes: dict[tuple[str, int], tuple[list[int], list[int]]] = {}
    for s, e, k in sorted({*strong, *weak}):
        starts, ends = scopes.setdefault((ROLE[k], bisect_right(breaks, s)), ([], []))
        starts.append(s)
        ends.append(max(e, ends[-1] if ends else 0))

    def meets(s: int, e: int, role: str) -> bool:
        starts, ends = scopes.get((role, bisect_right(breaks, s)), ((), ()))
        i = bisect_right(starts, e + reach)
        return bool(i) and ends[i - 1] >= s - reach

    need = {"secret": ("ident", "endpoint"), "ident": ("secret",), "endpoint": ("secret",)}
    return [(s, e, k) for s, e, k in weak if any(meets(s, e, r) for r in need[k])]


def scan(text: str | None, reach: int = REACH) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Strong findings and linked weak parts as (start, end, kind) in code points."""
    text = text or ""
    low = text.lower() if text.isascii() else text.encode().lower().decode()
    strong = base_spans(text, low)
    weak = linked(text, strong, weak_parts(text, low, strong), reach)
    order = lambda x: (x[0], KINDS.index(x[2]))
    return sorted(strong, key=order), sorted(weak, key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def scan_documents(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_weak, base_spans, spans."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            found = [scan(t, reach) for t in b.column(1).to_pylist()]
            count = lambda kind: pa.array([sum(k == kind for _, _, k in s) for s, _ in found], pa.int64())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [b.column(0), count("assign"), count("access"), count("hex"), pa.array([len(w) for _, w in found], pa.int64()), pa.array([joined(s) for s, _ in found]), pa.array([joined(s + w) for s, w in found])],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_weak", "base_spans", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_weak long, base_spans string, spans string")

