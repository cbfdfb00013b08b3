"""Benchmark decontamination: suffix arrays over the corpus, searched for every window of the benchmark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtide.llm import words as W
from loomtide.llm.ranks import column, unused

WINDOW = 10
#: Words of the benchmark that are searched at a time; a larger benchmark is searched in several blocks.
BLOCK_WORDS = 2_000_000
#: Suffixes of one shard's suffix array.
SHARD_SUFFIXES = 400_000
#: Pairs of a place in a text and a place in an item that are looked at together.
PAIRS_TOGETHER = 1_000_000

MATCHES = (
    "struct<n_words: long, spans: array<struct<start: long, end: long>>, items: array<string>, "
    "matches: array<struct<start: long, n_words: long, item: string, item_start: long>>>"
)
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass
class Benchmark:
    """A block of the benchmark: its vocabulary, and its distinct windows in order with the items that hold them.

    ``windows`` has the numbers of words in the sorted ``vocabulary``, from 1; a window shorter than the widest is
    filled up with zeros. ``holders`` and ``at`` (where in the item) belong to window w from ``offset[w]`` on, as do
    ``before`` and ``after``, the windows one word earlier and later in that item (-1: none).
    """

    items: list[str | None]
    vocabulary: np.ndarray
    pairs: np.ndarray
    windows: np.ndarray
    length: np.ndarray
    offset: np.ndarray
    holders: np.ndarray
    at: np.ndarray
    before: np.ndarray
    after: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list, window: int) -> Benchmark:
        rows, holders, at, lengths = [], [], [], []
        hashes = []
        for lo, hi in W.groups(texts):
            w = W.words(texts[lo:hi], W.ALNUM)
            cut = w.first()
            hashes += [w.hash[a:b] for a, b in zip(cut[:-1], cut[1:])]
        every = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        vocabulary = np.unique(every)
        pairs = [W.window_hashes(h, 2) for h in hashes if len(h) > 1]
        for i, h in enumerate(hashes):
            n = min(window, len(h))
            if n == 0:
                continue
            own = np.searchsorted(vocabulary, h).astype(np.int32) + 1
            block = np.zeros((len(h) - n + 1, window), dtype=np.int32)
            for k in range(n):
                block[:, k] = own[k : k + len(block)]
            rows.append(block)
            holders.append(np.full(len(block), i))
            at.append(np.arange(len(block)))
            lengths.append(np.full(len(block), n))
        if not rows:
            none = np.zeros(0, dtype=np.int64)
            return cls([], vocabulary, vocabulary, np.zeros((0, window), dtype=np.int32), none, np.zeros(1, dtype=np.int64), none, none, none, none)
        stacked, holder, where = np.concatenate(rows), np.concatenate(holders), np.concatenate(at)
        order = np.lexsort([where, holder, *[stacked[:, k] for k in range(window - 1, -1, -1)]])
        stacked, holder, where = stacked[order], holder[order], where[order]
        new = np.ones(len(stacked), dtype=bool)
        new[1:] = (stacked[1:] != stacked[:-1]).any(axis=1)
        offset = np.append(np.flatnonzero(new), len(stacked))
        number = (np.cumsum(new) - 1).astype(np.int32)
        along = np.lexsort([where, holder])
        same = holder[along[1:]] == holder[along[:-1]]
        before, after = np.full(len(along), -1, dtype=np.int32), np.full(len(along), -1, dtype=np.int32)
        before[along[1:][same]] = number[along[:-1][same]]
        after[along[:-1][same]] = number[along[1:][same]]
        return cls(
            [None if i is None else str(i) for i in ids], vocabulary,
            np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.uint64),
            stacked[new], (stacked[new] > 0).sum(axis=1), offset, holder, where, before, after,
        )


@dataclass
class Shard:
    """Suffixes of some texts that may begin a match: their first words, text and position."""

    words: np.ndarray
    text: np.ndarray
    position: np.ndarray

    @classmethod
    def joined(cls, parts: list[Shard]) -> Shard:
        return cls(*[np.concatenate([getattr(p, n) for p in parts]) for n in ("words", "text", "position")])


def suffixes(w: W.Words, b: Benchmark, first_text: int) -> Shard:
    """The suffixes whose first words, as many as the shortest window has, are words and pairs of the benchmark.

    No other suffix can begin with a window. Words outside of the vocabulary and ends of texts become zeros.
    """
    width = b.windows.shape[1]
    known = W.among(w.hash, b.vocabulary)
    number = np.zeros(len(w.hash) + width, dtype=np.int32)
    at = np.flatnonzero(known)
    number[at] = np.searchsorted(b.vocabulary, w.hash[at]) + 1
    pair = np.zeros(len(w.hash), dtype=bool)
    near = np.flatnonzero(known[:-1] & known[1:] & (w.text[1:] == w.text[:-1]))
    pair[near] = W.among(W.window_hashes(w.hash, 2)[near], b.pairs)
    # words that go on from each word through pairs of the benchmark
    breaks = np.flatnonzero(~pair)
    run = breaks[np.searchsorted(breaks, np.arange(len(pair)))] - np.arange(len(pair)) + 1 if len(pair) else pair
    start = np.flatnonzero(known & (run >= b.length.min()))
    words = np.stack([np.where(run[start] > k, number[start + k], 0) for k in range(width)], axis=1)
    return Shard(words, w.text[start] + first_text, start - w.first()[w.text[start]])


def occurrences(shard: Shard, b: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """(window, suffix) of every place where a window occurs: two binary searches per window in the suffix array."""
    width = b.windows.shape[1]
    order = np.lexsort([shard.words[:, k] for k in range(width - 1, -1, -1)])
    array = shard.words[order]

    def bound(after: bool) -> np.ndarray:
        low = np.zeros(len(b.windows), dtype=np.int64)
        high = np.full(len(b.windows), len(array), dtype=np.int64)
        for _ in range(int(len(array)).bit_length()):
            open_ = low < high
            middle = (low + high) >> 1
            suffix = array[np.minimum(middle, len(array) - 1)]
            less, same = np.zeros(len(low), dtype=bool), np.ones(len(low), dtype=bool)
            for k in range(width):
                used = same & (k < b.length)
                less |= used & (suffix[:, k] < b.windows[:, k])
                same = np.where(used, suffix[:, k] == b.windows[:, k], same)
            right = open_ & (less | (same if after else False))
            low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
        return low

    first, last = bound(False), bound(True)
    n = last - first
    window = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return window, order[place]


def spans_of(start: np.ndarray, end: np.ndarray) -> list[dict]:
    """Spans joined where they touch or overlap; starts are in order."""
    out: list[dict] = []
    for a, z in zip(start.tolist(), end.tolist()):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(z, out[-1]["end"])
        else:
            out.append({"start": a, "end": z})
    return out


def runs_of(window: np.ndarray, start: np.ndarray, b: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, n_words, item, item_start) of a text's longest runs, each window taken at every place that holds it.

    Windows that follow each other in the text and in one item are one run. A pair of places begins a run if the window
    before it in the item isn't before it in the text, and ends it likewise; begins and ends of a diagonal (start less
    place in the item) alternate. Only these are kept, pairs are looked at in parts.
    """
    key = np.sort(start * len(b.windows) + window)
    n = b.offset[window + 1] - b.offset[window]
    upto = np.cumsum(n)
    first, last, lo = [], [], 0
    while lo < len(window):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - n[lo] + PAIRS_TOGETHER, side="right")))
        hit = np.repeat(np.arange(lo, hi), n[lo:hi])
        place = np.arange(len(hit)) - (upto - n)[hit] + (upto - n)[lo] + b.offset[window[hit]]
        lo = hi
        for kept, beside, step in ((first, b.before[place], -1), (last, b.after[place], 1)):
            wanted = (start[hit] + step) * len(b.windows) + beside
            found = np.searchsorted(key, wanted)
            edge = (beside < 0) | (key[np.minimum(found, len(key) - 1)] != wanted)
            at = place[edge]
            kept.append(np.stack([b.holders[at], start[hit][edge] - b.at[at], start[hit][edge], b.length[window[hit]][edge]]))
    head, tail = np.concatenate(first, axis=1), np.concatenate(last, axis=1)
    head, tail = head[:, np.lexsort(head[2::-1])], tail[:, np.lexsort(tail[2::-1])]
    return head[2], tail[2] + tail[3] - head[2], head[0], head[2] - head[1]


def describe(shard: Shard, b: Benchmark, out: dict[int, tuple]) -> None:
    """Per text with matches: (spans, items, matches), into ``out``."""
    if not len(shard.text):
        return
    window, suffix = occurrences(shard, b)
    if not len(window):
        return
    text, start = shard.text[suffix], shard.position[suffix]
    order = np.lexsort([start, text])
    window, text, start = window[order], text[order], start[order]
    end = start + b.length[window]
    cut = np.append(np.flatnonzero(np.diff(text, prepend=-1)), len(text))
    for a, z in zip(cut[:-1], cut[1:]):
        run_start, n_words, item, there = runs_of(window[a:z], start[a:z], b)
        found = [
            {"start": int(s), "n_words": int(n), "item": i, "item_start": int(t)}
            for s, n, i, t in dict.fromkeys(zip(run_start, n_words, [b.items[i] for i in item], there))
        ]
        found.sort(key=lambda m: (m["start"], -m["n_words"], m["item"] is None, m["item"] or "", m["item_start"]))
        out[int(text[a])] = (
            spans_of(start[a:z], end[a:z]), sorted({b.items[i] for i in np.unique(item) if b.items[i] is not None}), found
        )


def searched(texts: list, b: Benchmark) -> pd.DataFrame:
    """The fields of ``MATCHES`` for some texts: shards of suffixes are sorted and searched one after the other."""
    n_words, parts, size, out = [], [], 0, {}

    def flush() -> None:
        nonlocal parts, size
        if parts:
            describe(Shard.joined(parts), b, out)
        parts, size = [], 0

    for lo, hi in W.groups(texts):
        w = W.words(texts[lo:hi], W.ALNUM)
        n_words.append(w.per_text())
        if len(b.windows) and len(w.hash):
            parts.append(suffixes(w, b, lo))
            size += len(parts[-1].text)
            if size >= SHARD_SUFFIXES:
                flush()
    flush()
    found = [out.get(i, ([], [], [])) for i in range(len(texts))]
    return pd.DataFrame({
        "n_words": np.concatenate(n_words) if n_words else np.zeros(0, dtype=np.int64),
        "spans": [f[0] for f in found], "items": [f[1] for f in found], "matches": [f[2] for f in found],
    })


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> list[Benchmark]:
    """The benchmark in blocks of about ``block_words`` words; no item is divided."""
    rows = benchmark.select(column(id_col).alias("i"), column(text_col).alias("t"))
    total = rows.agg(F.sum(F.regexp_count("t", F.lit(WORD)))).first()[0] or 0
    n = max(1, -(-total // block_words))
    blocks = []
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()
        blocks.append(Benchmark.of([r["i"] for r in part], [r["t"] for r in part], window))
    return blocks


def _search(block: Benchmark):
    @F.pandas_udf(MATCHES.removeprefix("struct<").removesuffix(">"))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield searched(texts.tolist(), block)

    return found


def _joined_spans(spans: Column) -> Column:
    """Sorted spans joined where they touch or overlap."""
    none = F.array().cast("array<struct<start: long, end: long>>")
    last = lambda done: F.element_at(done, -1)

    def step(done: Column, s: Column) -> Column:
        joined = F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end"))
        apart = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["end"] < s["start"])
        return F.when(apart, F.concat(done, F.array(s))).otherwise(
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
        )

    return F.aggregate(F.array_sort(spans), none, step)


def find_matches(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with ``contamination``: n_words, spans, items, matches.

    Words are runs of digits, ASCII letters and characters beyond ASCII, A-Z lower-cased. A window is ``window``
    consecutive words of an item, or a shorter item whole. ``spans`` are the words of the document inside any
    occurrence of a window, ``items`` the ids (as strings, in order) of all items with a window that occurs, ``matches``
    the longest verbatim runs with their places in document and item, for every item and every place in it.

    Every batch of documents is a shard or several: the suffixes of their words that can begin a window are sorted to
    the window's length, and every window of the benchmark is found by binary search. A benchmark beyond
    ``block_words`` words is searched in blocks; one block at a time is in memory. No rows are moved.

    Null and empty texts have no words and no matches; items without words are ignored; an item without an id marks
    words but isn't listed; repeated items count once. Ties don't matter. An empty benchmark finds nothing. Other
    columns are kept; ``contamination`` is replaced.
    """
    text = column(text_col)
    parts = [_search(b)(text) for b in benchmark_blocks(benchmark, item_col, item_text_col, window, block_words)]
    if len(parts) == 1:
        return docs.withColumn("contamination", parts[0])
    names = unused(docs, *[f"_found{i}" for i in range(len(parts))])
    every = {n: F.concat(*[F.col(c)[n] for c in names]) for n in ("spans", "items", "matches")}
    return docs.withColumns(dict(zip(names, parts))).withColumn("contamination", F.struct(
        F.col(names[0])["n_words"].alias("n_words"), _joined_spans(every["spans"]).alias("spans"),
        F.array_sort(F.array_distinct(every["items"])).alias("items"), F.array_sort(F.array_distinct(every["matches"])).alias("matches"),
    )).drop(*names)


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any match, with their own columns."""
    text = column(options.pop("text_col", "text")).alias("_text")
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("_row"), text)
    clean = find_matches(rows, benchmark, text_col="_text", **options).filter(F.size("contamination.spans") == 0)
    return clean.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
