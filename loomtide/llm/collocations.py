"""Phrase collocations by Toivonen's method: a sample proposes frequent phrases, a full pass counts them and their border.

A phrase can only be frequent if its first and its last words without the other end are. What a sample finds frequent
is proposed. A full pass counts the proposed phrases and their negative border: phrases that are not proposed although
both of their parts are. A border phrase that turns out frequent is a failure of the sample. Every frequent phrase that
was not proposed holds a failure (the shortest such part of it is one), so failures start an expansion pass, which
counts every phrase that holds one and whose other parts can be frequent; after it the result is closed.

Proposed phrases, and those of the expansion, are counted by their words. The border is far larger, and of its phrases
only those matter that are frequent, so it is counted by 64-bit hashes: two phrases that share one can only make a
failure too many. Proposed phrases grow with the corpus; tasks look them up in a bitmap of bounded size, where a chance
hit counts a phrase more than needed and changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomtide.llm.ranks import column, stored
from loomtide.llm.words import STEP, mixed, words

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
COVERED_PERCENT = 80
#: One row in so many proposes phrases, those found this share of the expected times there.
SAMPLE_ONE_IN = 8
SAMPLE_SHARE = 0.6
#: Characters of texts whose phrases a task adds up together; a longer text is a block of its own.
BLOCK_CHARS = 1 << 22
#: The bitmap has about 16 bits per proposed phrase, up to 2**24 numbers of 64 bits (128 MB, 67 million phrases).
MAX_BITMAP = 24
#: Pieces of a language's candidates that are ranked apart before their best ones meet.
TOP_SLICES = 64

#: Characters that end a piece, and those that only separate words.
ENDS = b".,;:!?\n\x0b\x0c\r"
BLANK = b" \t"
WORD = np.array([b not in ENDS + BLANK for b in range(256)], dtype=bool)
END = np.array([b in ENDS for b in range(256)], dtype=bool)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: ``phrase`` is the language, a line feed and the words joined by spaces, or null for what is counted by hash only.
COUNTS = "h long, phrase string, count long"
SHIFTS = (0, 6, 12, 18)


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "replace"), digest_size=8).digest(), "little"))


def has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the bitmap: four bits of one number each."""
    width = np.uint64(64 - (len(bitmap) - 1).bit_length())
    mask = np.zeros(len(h), dtype=np.uint64)
    for shift in SHIFTS:
        mask |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
    return bitmap[h >> width] & mask == mask


def _among(bitmap: np.ndarray, h: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Which of the valid phrases may be in the bitmap."""
    at = np.flatnonzero(valid)
    out = np.zeros(len(valid), dtype=bool)
    out[at[has(bitmap, h[at])]] = True
    return out


def _rows(h: np.ndarray, phrases: list | None, count: np.ndarray) -> pa.RecordBatch:
    phrase = pa.nulls(len(h), pa.string()) if phrases is None else pa.array(phrases, pa.string())
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), phrase, pa.array(count.astype(np.int64))], names=["h", "phrase", "count"])


def block_counts(
    texts: list, langs: list, max_words: int, proposed: np.ndarray | None, failed: np.ndarray | None
) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of some texts. See ``counted``."""
    found = words(texts, WORD)
    own = {lang: lang_hash(lang) for lang in set(langs)}
    in_lang = np.array([own[lang] for lang in langs], dtype=np.uint64)
    if proposed is not None and failed is None:
        total = dict.fromkeys(own, 0)
        for lang, n in zip(langs, found.per_text().tolist()):
            total[lang] += n
        yield _rows(np.zeros(len(total), dtype=np.uint64), [lang + "\n" for lang in total], np.array(list(total.values())))
    if not len(found.start):
        return
    ends = np.cumsum(END[found.buffer], dtype=np.int32)
    # words that the next one follows within the same piece; texts are laid end to end with a line feed between them
    followed = ends[found.start[1:]] == ends[found.end[:-1] - 1]
    low = found.buffer.tobytes().translate(LOWER)
    first = mixed(found.hash ^ in_lang[found.text])

    def by_words(at: np.ndarray, n: int) -> pa.RecordBatch:
        key, where, count = np.unique(h[at], return_index=True, return_counts=True)
        phrases = []
        for i in at[where].tolist():
            spans = zip(found.start[i : i + n].tolist(), found.end[i : i + n].tolist())
            phrases.append(langs[found.text[i]] + "\n" + b" ".join([low[a:b] for a, b in spans]).decode())
        return _rows(key, phrases, count)

    def by_hash(at: np.ndarray) -> pa.RecordBatch:
        key, count = np.unique(h[at], return_counts=True)
        return _rows(key, None, count)

    def of_parts(parts: np.ndarray, n: int) -> np.ndarray:
        """Phrases in one piece of which both parts are marked."""
        return parts[:-1] & parts[1:] & followed if n == 2 else parts[:-1] & parts[1:]

    # phrases whose parts are proposed, and (in the expansion) those whose parts can be frequent or hold a failure
    h, inner, room = first, np.ones(len(first), dtype=bool), np.ones(len(first), dtype=bool)
    for n in range(1, max_words + 1):
        if n > 1:
            h = mixed(h[:-1] * STEP + first[n - 1 :])
            inner = of_parts(known, n)
        if proposed is None:
            known = inner
            yield by_hash(np.flatnonzero(inner))
            continue
        known = _among(proposed, h, inner)
        if failed is None:
            yield by_words(np.flatnonzero(known), n)
            yield by_hash(np.flatnonzero(inner & ~known))
            continue
        if n > 1:
            room = of_parts(ok, n)
        holds = _among(failed, h, room)
        ok = holds | _among(proposed, h, room)
        if n > 1:
            holds = room & (holds | before[:-1] | before[1:])
            ok |= holds
        before = holds
        yield by_words(np.flatnonzero(holds & ~known), n)


def counted(rows: DataFrame, max_words: int, proposed=None, failed=None) -> DataFrame:
    """Counts of phrases by language: ``h``, ``phrase``, ``count``; ``rows`` has ``lang`` and ``text``.

    ``proposed`` and ``failed`` are broadcast bitmaps. Without either, as for the sample, every phrase is counted by hash.
    With ``proposed``, phrases whose parts are both proposed (single words always) are counted: the proposed ones by
    their words, the others by hash; and all words of a language, as an empty phrase. With ``failed`` too, phrases are
    counted by their words that hold a failed one and whose parts are proposed or hold one as well, if they were not
    counted so before.

    A task adds up blocks of about four million characters before rows leave it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [m.value if m is not None else None for m in (proposed, failed)]
        langs, texts, size = [], [], 0
        for found in batches:
            for lang, text in zip(found.column(0).to_pylist(), found.column(1)):
                text = text.as_py()
                if not text:
                    continue
                langs.append(lang)
                texts.append(text)
                size += len(text)
                if size >= BLOCK_CHARS:
                    yield from block_counts(texts, langs, max_words, *maps)
                    langs, texts, size = [], [], 0
        if texts:
            yield from block_counts(texts, langs, max_words, *maps)

    # blocks are summed up already, and most of the border is seen once: another sum before the rows move gains little
    return rows.mapInArrow(count, COUNTS).repartition("h").groupBy("h", "phrase").agg(F.sum("count").alias("count"))


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The hashes (``h``) as a bitmap of numbers of 64 bits, for every four hashes one, at most ``2 ** MAX_BITMAP``.

    Bits are put together by Spark; at most one row per number of the bitmap reaches the driver, however many phrases
    there are.
    """
    width = min(MAX_BITMAP, max(10, (hashes.count() // 2).bit_length()))
    bits = [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", s).bitwiseAND(63).cast("int"))
        for s in SHIFTS
    ]
    mask = bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])
    cells = hashes.select(F.shiftrightunsigned("h", 64 - width).alias("at"), mask.alias("mask"))
    cells = cells.groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << width, dtype=np.uint64)
    out[cells.column("at").to_numpy()] = cells.column("mask").to_numpy().view(np.uint64)
    return out


def frequent_phrases(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS, one_in: int = SAMPLE_ONE_IN,
) -> DataFrame:
    """Every phrase of up to ``max_words`` words found at least ``min_count`` times in a language, with its count.

    ``lang``, ``words``, ``phrase`` (words joined by one space), ``count``; a row with no words holds the number of all
    words of the language. A-Z are lower-cased, texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into
    words at spaces and tabs; a phrase lies within one piece, and occurrences may overlap. A null language is ``und``,
    a null text has no words, repeated rows count each time. An empty table gives no rows. Other columns are ignored.

    The sample decides which phrases are counted early, never a count: it may hold any rows, or none. Texts are read once
    for the sample, once to count, and once more if the sample failed.
    """
    spark = docs.sparkSession
    lang = F.coalesce(column(lang_col).cast("string"), F.lit("und")).alias("lang")
    drawn = docs.filter(F.pmod(F.xxhash64(column(id_col), column(text_col)), F.lit(one_in)) == 0)
    rows, drawn = (d.select(lang, column(text_col).alias("text")) for d in (docs, drawn))
    often = max(2, int(min_count / one_in * SAMPLE_SHARE))
    sampled = stored(counted(drawn, max_words).filter(F.col("count") >= often).select("h"), "proposed-phrases")
    proposed = spark.sparkContext.broadcast(bitmap(sampled))
    enough = F.col("count") >= min_count
    found = stored(counted(rows, max_words, proposed).filter(enough | F.col("phrase").endswith("\n")), "phrases")
    failures = found.filter("phrase is null").select("h")
    found = found.filter("phrase is not null")
    if not failures.isEmpty():
        failed = spark.sparkContext.broadcast(bitmap(failures))
        found = found.unionByName(stored(counted(rows, max_words, proposed, failed).filter(enough), "expanded-phrases"))
    text = F.substring_index("phrase", "\n", -1)
    return found.select(
        F.expr("left(phrase, length(phrase) - length(substring_index(phrase, '\\n', -1)) - 1)").alias("lang"),
        F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).alias("words"), text.alias("phrase"), "count",
    )


def _decimal(col: str) -> Column:
    return F.col(col).cast("decimal(20,0)")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS, top: int = TOP, one_in: int = SAMPLE_ONE_IN,
) -> DataFrame:
    """The best phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Candidates are the frequent phrases (``frequent_phrases``, also for nulls, repeats and empty tables) of two or more
    words. Cut after its first k words, a candidate found ``a`` times whose ends are found ``l`` and ``r`` times scores
    ``floor(2000000 a / (l + r))``; its lowest cut counts, of equal ones that with the smallest k. A candidate is left
    out if a longer one that holds its words in a row is found at least 0.8 times as often. Ties in score are broken by
    ``a``, then by the bytes of the phrase. Products are decimals, so large counts don't overflow.

    The ends of frequent phrases are frequent, so their counts are joined from the same table. Each language is ranked
    in slices first: no task sorts all candidates of a large one.
    """
    found = frequent_phrases(docs, lang_col, text_col, id_col, min_count, max_words, one_in)
    counts = found.filter(F.col("words") > 0)
    words = F.split("phrase", " ")
    many = counts.filter(F.col("words") > 1).select("lang", "words", "phrase", F.col("count").alias("a"))

    def run(start: Column, length: Column) -> Column:
        return F.array_join(F.slice(words, start, length), " ")

    cut = F.explode(F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.struct(k.alias("k"), run(F.lit(1), k).alias("front"), run(k + 1, F.col("words") - k).alias("rest")),
    )).alias("cut")
    fronts = counts.select("lang", F.col("phrase").alias("front"), F.col("count").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("count").alias("r"))
    cuts = many.select("lang", "phrase", "words", "a", cut).select("lang", "phrase", "words", "a", "cut.*")
    cuts = cuts.join(fronts, ["lang", "front"]).join(rests, ["lang", "rest"])
    score = F.call_function("div", _decimal("a") * F.lit(2_000_000), _decimal("l") + _decimal("r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low"))

    held = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: run(i, n)),
    ))).alias("phrase")
    longer = many.filter(F.col("words") > 2).select("lang", F.col("a").alias("most"), held)
    longer = longer.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (_decimal("most") * 100 < _decimal("a") * COVERED_PERCENT)
    ).select("lang", "phrase", "a", "low.l", "low.r", "low.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    sliced = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SLICES))).orderBy(*order)
    best = kept.withColumn("rank", F.row_number().over(sliced)).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = found.filter(F.col("words") == 0).select("lang", F.col("count").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
