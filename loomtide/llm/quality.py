"""Quality rules on repetition: the share of characters inside repeated word n-grams and repeated lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm import words as W
from loomtide.llm.ranks import column, unused

#: Largest share of a text's word characters inside n-grams that repeat an earlier one, by n. Published rule values.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of word characters in lines that repeat an earlier one. Published rule value.
LINE_CHARS_LIMIT = 0.20
MIN_WORDS = 20
BASE_WINDOW = 8
BASE_PERCENT = 30

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, dup_ngram_chars array<long>"
)


def _later(keys: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Which of the repeated keys stand behind an equal one."""
    at = np.flatnonzero(again)
    out = again.copy()
    out[at[np.unique(keys[at], return_index=True)[1]]] = False
    return out


def measures(texts: list, lengths: tuple[int, ...]) -> pd.DataFrame:
    """The columns of ``MEASURES`` for some texts."""
    out = []
    for lo, hi in W.groups(texts):
        w = W.words(texts[lo:hi], fold=False)
        starts = np.concatenate([[0], np.cumsum((w.buffer & 0xC0) != 0x80)])  # characters before each byte
        chars = starts[w.end] - starts[w.start]
        frame = {"n_words": w.per_text(), "word_chars": w.per_text(chars)}
        at = np.flatnonzero(SYMBOLS[w.buffer])
        frame["n_symbols"] = np.bincount(np.searchsorted(w.text_end, at, side="right"), minlength=w.n_texts).astype(np.int64)

        # lines that hold a word, by the first word of each
        breaks = np.flatnonzero(w.buffer == 10)
        line = np.searchsorted(breaks, w.start)
        rows = np.flatnonzero(np.diff(line, prepend=-1))
        begin, end = breaks[line[rows] - 1] + 1, breaks[line[rows]]
        key = W.in_text(W.hash_spans(w.buffer, begin, end, W.PLAIN), w.text[rows])
        dup = _later(key, W.repeated(key))
        frame["n_lines"] = np.bincount(w.text[rows], minlength=w.n_texts).astype(np.int64)
        frame["n_dup_lines"] = np.bincount(w.text[rows], weights=dup, minlength=w.n_texts).astype(np.int64)
        in_dup = np.repeat(dup, np.diff(np.append(rows, len(line))))
        frame["dup_line_chars"] = w.per_text(chars * in_dup)

        shares = []
        for n in sorted({*lengths, BASE_WINDOW}):
            own = W.inside_text(w.text, n)
            first = np.flatnonzero(own)
            key = W.in_text(W.window_hashes(w.hash, n)[first], w.text[first])
            again = W.repeated(key)
            if n == BASE_WINDOW:
                frame["n_repeat_words"] = w.per_text(W.covered(len(w.hash), first[again], n))
            if n in lengths:
                shares.append(w.per_text(chars * W.covered(len(w.hash), first[_later(key, again)], n)))
        frame["dup_ngram_chars"] = list(np.stack(shares, axis=1)) if shares else [[]] * w.n_texts
        out.append(pd.DataFrame(frame))
    names = [x.split()[0] for x in MEASURES.split(", ")]
    return pd.concat(out, ignore_index=True)[names] if out else pd.DataFrame({n: [] for n in names})


def repetition(docs: DataFrame, text_col: str = "text", limits: dict[int, float] | None = None) -> DataFrame:
    """``docs`` with a struct ``quality``: the measures of the whole text, ``base_failed``, ``failed`` rules, ``kept``.

    Measures count words (runs without ASCII white space), characters in words, symbols of ``#*$%&|<>``, lines that
    equal an earlier line, words in 8-word windows found at least twice, and for each n of ``limits`` the characters
    of words inside n-grams that repeat an earlier n-gram of the text (rolling 64-bit hashes over all its words).
    ``base_failed``: under 20 words, or over 30 % of them in repeated windows. ``kept``: no base failure, no n-gram
    share above its limit, no more than 20 % of the characters in repeated lines. A heading that a short text repeats
    at its end is no failure, so the share of lines alone decides nothing.

    A null or empty text has no words and fails the base rules. Ties and repeated rows don't matter, each row is
    judged alone. Other columns, whatever their names, are kept; a column named ``quality`` is replaced.
    """
    limits = limits or NGRAM_LIMITS
    lengths = tuple(sorted(limits))

    @F.pandas_udf(MEASURES)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield measures(texts.tolist(), lengths)

    values, fails = unused(docs, "_measures", "_fails")
    m = F.col(values)
    rules = [
        (f"ngram_{n}", m["dup_ngram_chars"][i] > limits[n] * m["word_chars"]) for i, n in enumerate(lengths)
    ] + [
        ("line_chars", m["dup_line_chars"] > LINE_CHARS_LIMIT * m["word_chars"]),
    ]
    failed = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
    return docs.withColumn(values, measured(column(text_col))).withColumn(fails, failed).withColumn(
        "quality",
        F.struct(*[m[x.split()[0]].alias(x.split()[0]) for x in MEASURES.split(", ")], base.alias("base_failed"), F.col(fails).alias("failed"),
                 (~base & (F.size(fails) == 0)).alias("kept")),
    ).drop(values, fails)


def quality_kept(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``repetition`` keeps, with their own columns."""
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("_row"), column(text_col).alias("_text"))
    return repetition(rows, "_text").filter("quality.kept").select(*[F.col("_row")[c].alias(c) for c in docs.columns])
