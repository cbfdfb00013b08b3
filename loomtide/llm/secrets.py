"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings with an allow-list."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm.ranks import column

# The patterns of the base kinds, in the order that ranks spans of equal start.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ASSIGN_VALUE = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")

#: Strings that may be keys: long runs of the characters of encoded bytes.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SEPARATORS = "+/_=-"
#: Candidates without digits and words with a number, which letters alone tell from names.
WORDS_ONLY = re.compile(r"[A-Za-z+/_=-]+$|[A-Za-z]+[0-9]{1,4}$")
WINDOW = 20
#: Bits per character that a window has to reach, by the class of the candidate's characters.
ENTROPY_LIMITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
#: What a window of ``WORDS_ONLY`` has to reach: bits per character, letters of either case, changes between the cases.
WORDS_LIMIT = 3.7
CASE_LETTERS = 5
CASE_CHANGES = 5
#: Changes that names with single capitals don't reach.
MANY_CHANGES = 12
#: Candidates that are known not to be secrets.
ALLOWED = tuple(re.compile(x) for x in (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"[0-9_=+/-]+$",  # numbers, phone numbers, rules
    r"(?i).*(example|sample|placeholder|your[_-]|xxxx)",
    r"(?:[a-z]+[/_-])+[a-z]*[0-9]{0,4}$",  # paths and names in lower case, the last part with a number
))

_TERM = [0.0] + [k * log2(k) for k in range(1, WINDOW + 1)]


def char_class(text: str) -> str:
    if not text.strip("0123456789abcdef") or not text.strip("0123456789ABCDEF"):
        return "hex"
    return "alnum" if text.isalnum() else "base64"


def mixed_case(text: str) -> bool:
    """Whether letters of both cases alternate as in random strings; names have few of one case, few changes or capitals one by one."""
    upper = [c.isupper() for c in text if c.isalpha()]
    changes = sum(a != b for a, b in zip(upper, upper[1:]))
    together = any(a and b for a, b in zip(upper, upper[1:]))
    return min(sum(upper), len(upper) - sum(upper)) >= CASE_LETTERS and changes >= (CASE_CHANGES if together else MANY_CHANGES)


def hot_ranges(text: str, limit: float, window: int = WINDOW, mixed: bool = False) -> list[tuple[int, int]]:
    """Joined windows whose entropy reaches the limit; a text shorter than a window is one window.

    With ``mixed``, windows that aren't of mixed case don't count.

    Going one character on changes two counts, so the sum of c*log2(c) is kept up to date instead of counted anew.
    """
    n = min(window, len(text))
    counts: dict[str, int] = {}
    total, found = 0.0, []
    term = _TERM if n < len(_TERM) else [0.0] + [k * log2(k) for k in range(1, n + 1)]
    for i, c in enumerate(text):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += term[k + 1] - term[k]
        if i >= n:
            old = text[i - n]
            k = counts[old]
            counts[old] = k - 1
            total += term[k - 1] - term[k]
        if i >= n - 1 and log2(n) - total / n >= limit - 1e-12 and (not mixed or mixed_case(text[i - n + 1 : i + 1])):
            a = i - n + 1
            if found and a <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((a, i + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, rank of kind) of the fixed patterns, in order of start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def uncovered(start: int, end: int, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a candidate outside of base spans that are long enough, without a separator where they were cut."""
    parts, at = [], start
    for s, e, _ in base:
        if s < end and at < e:
            if at < s:
                parts.append((at, s))
            at = max(at, e)
    if at < end:
        parts.append((at, end))
    cut = [(a + (a > start and text[a] in SEPARATORS), z - (z < end and text[z - 1] in SEPARATORS)) for a, z in parts]
    return [(a, z) for a, z in cut if z - a >= WINDOW]


def entropy_spans(text: str, base: list[tuple[int, int, int]], limits: dict[str, float]) -> list[tuple[int, int, int]]:
    """Spans of high entropy outside of base spans, without allow-listed candidates."""
    found = []
    for m in CANDIDATE.finditer(text):
        for start, end in uncovered(m.start(), m.end(), text, base):
            word = text[start:end]
            if any(a.match(word) for a in ALLOWED):
                continue
            if WORDS_ONLY.match(word):
                hot = hot_ranges(word, max(WORDS_LIMIT, limits[char_class(word)]), mixed=True)
            else:
                hot = hot_ranges(word, limits[char_class(word)])
            found += [(start + a, start + b, 3) for a, b in hot]
    return found


def scan(docs: DataFrame, text_col: str = "text", limits: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with ``secrets``: array of struct(kind, start, end), by start, then kind; offsets are code points.

    Kinds ``assign``, ``access`` and ``hex`` are the leftmost non-overlapping matches of fixed patterns in the whole
    text. ``entropy`` spans are added: candidate strings, or what those matches leave uncovered of them, not on the
    allow-list, in which a sliding window of 20 characters reaches the entropy limit of their class (hex, alphanumeric,
    base64); overlapping windows are one span. Without digits, or with a few at the end of a word only, a window has to
    be of mixed case as well.

    A null or empty text has no spans. Each row is judged alone, so ties and repeated rows don't matter. Other columns
    are kept whatever their names; one named ``secrets`` is replaced.
    """
    limits = limits or ENTROPY_LIMITS

    def found(text: str) -> list[dict]:
        if not text:
            return []
        base = base_spans(text)
        every = sorted(base + entropy_spans(text, base, limits), key=lambda s: (s[0], s[2]))
        return [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in every]

    @F.pandas_udf("array<struct<kind: string, start: long, end: long>>")
    def spans_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([found(t) for t in texts])

    return docs.withColumn("secrets", spans_of(column(text_col)))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "*") -> DataFrame:
    """``docs`` after ``scan``, with every character of a span replaced; the text keeps its length."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans):
            for s in own if own is not None else []:
                text = text[: s["start"]] + mark * (s["end"] - s["start"]) + text[s["end"] :]
            out.append(text)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, masked(column(text_col), F.col("secrets")))
