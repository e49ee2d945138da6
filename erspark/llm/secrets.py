"""Secret scans with multipart credential linking.

Three base kinds stand for themselves: ``assign`` (a keyword with a value), ``access`` (an access key id) and ``hex`` (a
long hexadecimal run). The method looks for weaker parts besides: random-looking tokens, account names and endpoints (URLs,
IPv4 addresses, hosts with a port). Every part has a role: identifier, secret or endpoint. Within a scope (a paragraph: text
without an empty line) parts are interval-joined: two link if at most ``REACH`` characters lie between them.
A weak part is reported only if parts of both other roles link to it, or a base part of another role does.

All offsets are code points, ends exclusive. A text is scanned whole, by patterns that need linear time (hosts begin where a run of their
characters does, and give nothing back); its parts are joined by sorted starts, so the work is
n log n in the parts of one text, and nothing is shuffled.

Defined cases: null and empty texts have no spans; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from erspark.plans.lineage import small_batches

BASE = ("assign", "access", "hex")
WEAK = ("token", "account", "endpoint")
KINDS = (*BASE, *WEAK)
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "token": "secret", "account": "identifier", "endpoint": "endpoint"}
REACH = 256
MIN_TOKEN = 16
MIN_ENTROPY = 3.2

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}")
_ACCOUNT = re.compile(r"(?:user(?:name)?|login|account|client_?id|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}", re.IGNORECASE | re.ASCII)
_ENDPOINT = re.compile(r"[a-z][a-z0-9+]{1,9}://[^\s\"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.])|(?<![a-z0-9-])(?<![a-z0-9-]\.)[a-z0-9-]++(?:\.[a-z0-9-]++)++:[0-9]{2,5}")
_SCOPE = re.compile(r"\n[^\S\n]*\n")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds. Runs are maximal, so asking for the length in the pattern equals dropping short matches."""
    out = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    return out


def _random(token: str) -> bool:
    """Whether a token mixes digits and letters and spreads over many characters."""
    if not (any(c.isdigit() for c in token) and any(c.isalpha() for c in token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= MIN_ENTROPY


def weak_parts(text: str, base: list[Span]) -> list[Span]:
    """Weak parts that don't overlap a base span."""
    found = []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "token") for m in _TOKEN.finditer(text) if _random(m[0])]
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "account") for m in _ACCOUNT.finditer(text)]
    if "://" in text or _DIGIT.search(text):
        found += [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    if not base or not found:
        return found
    edges = sorted((a, b) for a, b, _ in base)
    starts = [a for a, _ in edges]
    reach, most = [], 0
    for _, b in edges:
        reach.append(most := max(most, b))
    return [x for x in found if not (k := bisect_left(starts, x[1])) or reach[k - 1] <= x[0]]


def linked(text: str, base: list[Span], weak: list[Span]) -> list[Span]:
    """The weak parts with complementary parts in reach, within their scope."""
    if not weak:
        return []
    cuts = [m.start() for m in _SCOPE.finditer(text)]
    parts: dict[tuple[int, str, bool], list[tuple[int, int]]] = {}
    for strong, spans in ((True, base), (False, weak)):
        for a, b, kind in spans:
            parts.setdefault((bisect_left(cuts, a), ROLE[kind], strong), []).append((a, b))
    latest: dict[tuple[int, str, bool], tuple[list[int], list[int]]] = {}
    for key, own in parts.items():
        own.sort()
        most, ends = 0, []
        for _, b in own:
            ends.append(most := max(most, b))
        latest[key] = [a for a, _ in own], ends

    def near(scope: int, role: str, strong: bool, a: int, b: int) -> bool:
        if (scope, role, strong) not in latest:
            return False
        starts, ends = latest[scope, role, strong]
        k = bisect_left(starts, b + REACH + 1)
        return k > 0 and ends[k - 1] >= a - REACH

    out = []
    for a, b, kind in weak:
        scope, others = bisect_left(cuts, a), {"identifier", "secret", "endpoint"} - {ROLE[kind]}
        if any(near(scope, r, True, a, b) for r in others) or all(near(scope, r, True, a, b) or near(scope, r, False, a, b) for r in others):
            out.append((a, b, kind))
    return out


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    listed = _listed(base)
    extra = linked(text, base, weak_parts(text, base))
    kinds = Counter(s[2] for s in base)
    return *(kinds[k] for k in BASE), hashlib.sha256(listed.encode()).hexdigest(), _listed(base + extra) if extra else listed


_FOUND = StructType([*(StructField(f"n_{k}", LongType()) for k in BASE), StructField("base_sha256", StringType()), StructField("spans", StringType())])


@F.pandas_udf(_FOUND)
def scan_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scan(t) for t in texts], columns=_FOUND.names)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), scan_udf(F.col(text_col)).alias("m")).select("doc_id", "m.*")
