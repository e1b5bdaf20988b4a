"""Secrets in texts: known patterns, and credentials linked from their parts.

Strong kinds are reported wherever they match. Weak parts (an identifier of an
account, an unnamed key-like string, an endpoint) are too common to report on
their own; an interval join within a scope, a paragraph and at most SCOPE code
points, links a secret with every identity and endpoint, and only linked ones
count. Parts that hang together by links are one credential, with a number.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship

#: Code points between parts that belong together, at most.
SCOPE = 240

#: Fixed patterns of the strong kinds, in the order in which ties are listed.
ASSIGN = re.compile(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as long runs only: a run never holds a second match
#: Weak parts, each a run of one class of characters in full, whatever its length.
IDENTITY = re.compile(r"""(?ia:\b(?:user(?:name)?|login|account|client_?id|tenant_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""")
ENDPOINT = re.compile(r"""(?ia:\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\s"'<>]{3,})""")
KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")

STRONG = ("assign", "access", "hex")
KINDS = (*STRONG, "identity", "endpoint", "key")
#: The part that a kind plays in a credential.
ROLE = {"assign": "secret", "access": "identity", "hex": "secret", "identity": "identity", "endpoint": "endpoint", "key": "secret"}

Span = tuple[str, int, int]


def strong_spans(text: str) -> list[Span]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _key_like(value: str) -> bool:
    """Mixed in its characters and close to random (bits of entropy a character)."""
    if not (any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)):
        return False
    counts = Counter(value).values()
    return -sum(n / len(value) * log2(n / len(value)) for n in counts) >= 3.5


def weak_spans(text: str) -> list[Span]:
    found = [("identity", *m.span()) for m in IDENTITY.finditer(text)] if "=" in text or ":" in text else []
    if "://" in text:
        found += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    return found + [("key", *m.span()) for m in KEY.finditer(text) if _key_like(m[0])]


#: Where a paragraph ends.
BREAK = re.compile(r"(?:\r\n?+|\n)[^\S\r\n]*(?:\r\n?+|\n)")


def _apart(weak: list[Span], strong: list[Span]) -> list[Span]:
    """The weak parts but keys that overlap a strong one (which has them already)."""
    taken = sorted((s, e) for _, s, e in strong)
    reach: list[int] = []  # the furthest end of all that begin before or here
    for _, e in taken:
        reach.append(max(e, reach[-1] if reach else 0))
    out = []
    for kind, start, end in weak:
        if kind == "key" and (k := bisect_right(taken, (end - 1, 1 << 62))) and reach[k - 1] > start:
            continue
        out.append((kind, start, end))
    return out


def credentials(text: str, strong: list[Span], weak: list[Span]) -> list[tuple[int, Span]]:
    """``number, part`` of all parts that are linked, numbered by the first part's place.

    A link joins a secret and an identity or endpoint of one paragraph with at
    most SCOPE code points between them (none if they overlap). The interval
    join is a sweep by start: the open parts of either side are those that end
    no more than SCOPE before; a new part joins all open ones of the other
    side, which are one credential from then on and need one entry. So every
    part is entered and taken out once.
    """
    if not weak:
        return []
    breaks = [m.start() for m in BREAK.finditer(text)]
    parts = sorted(strong + _apart(weak, strong), key=lambda x: (x[1], x[2], KINDS.index(x[0])))
    root = list(range(len(parts)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    linked = [False] * len(parts)
    side: list[list[tuple[int, int]]] = [[], []]  # end and number of the open parts: secrets, others
    paragraph = -1
    for k, (kind, start, end) in enumerate(parts):
        at = bisect_right(breaks, start)
        if at != paragraph:
            paragraph, side = at, [[], []]
        own = ROLE[kind] != "secret"
        near = [x for x in side[not own] if x[0] + SCOPE >= start]
        for _, other in near:
            linked[k] = linked[other] = True
            a, b = find(k), find(other)
            root[max(a, b)] = min(a, b)
        side[not own] = [(max(e for e, _ in near), near[0][1])] if near else []
        side[own].append((end, k))
    number: dict[int, int] = {}
    return [(number.setdefault(find(k), len(number)), x) for k, x in enumerate(parts) if linked[k]]


def linked(text: str, strong: list[Span], weak: list[Span]) -> list[Span]:
    """Those of the weak parts that are linked, in the order given."""
    found = {x for _, x in credentials(text, strong, weak)}
    return [x for x in weak if x in found]


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[], [], []]
        digest, every, links = [], [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            strong = strong_spans(text)
            found = credentials(text, strong, weak_spans(text))
            for k, kind in enumerate(STRONG):
                counts[k].append(sum(x[0] == kind for x in strong))
            digest.append(hashlib.sha256(_listed(strong).encode()).hexdigest())
            every.append(_listed(strong + [x for _, x in found if x[0] not in STRONG]))
            links.append(",".join(f"{n}:{k}:{s}:{e}" for n, (k, s, e) in sorted(found, key=lambda x: x[0])))
        arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.string()) for c in (digest, every, links))]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "links"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_assign, n_access, n_hex, base_sha256, spans, links``.

    ``links`` lists the parts of credentials as number:kind:start:end. Places count code points, ends are exclusive. One pass without a shuffle:
    a scope never leaves its text. Null and empty texts have no spans; null ids
    and repeated rows are kept as they come. An empty table gives an empty
    result; other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run, "id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, links string").withColumnRenamed("id", id_col)
