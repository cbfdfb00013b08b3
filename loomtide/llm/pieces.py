"""SentencePiece encoding and decoding by a table of distinct marked words.

A model whose pieces never cross a white space marker splits every marked word (a run of markers and what follows up to
the next marker) by itself. So each distinct marked word is segmented once, whatever the number of its occurrences, and
its ids are joined back by position.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from loomtide.llm.ranks import column
from loomtide.session import parallelism

MARKER = "▁"
MARKED = re.compile(f"{MARKER}+[^{MARKER}]*")
CROSSES = re.compile(f"[^{MARKER}]{MARKER}")
#: Marked words of one block: the texts that share a list of distinct words. A longer text is a block of its own.
BLOCK_WORDS = 1 << 21
#: Buckets of marked words. A block's words of one bucket are one row; a task holds the ids of one bucket at a time, a
#: 1024th of all distinct words.
BUCKETS = 1 << 10
#: Between the words of a row: a byte that UTF-8 never has.
BETWEEN = b"\xff"
#: Marked words segmented by one call.
SEGMENTED_TOGETHER = 4096


def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def checked_model(path: str) -> bytes:
    """The model's bytes. Raises ``ValueError`` if its pieces can cross a marker or its texts don't begin with one."""
    with open(path, "rb") as file:
        model = file.read()
    pieces = processor(model)
    crossing = [p for p in map(pieces.id_to_piece, range(pieces.get_piece_size())) if CROSSES.search(p)]
    if crossing:
        raise ValueError(f"pieces cross a white space marker: {crossing[:3]}")
    if pieces.normalize("a b") != f"{MARKER}a{MARKER}b":
        raise ValueError("the model does not mark the beginning of a text and its spaces")
    return model


def packed(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes as they need: seven bits a byte, the lowest first, the eighth bit says that more follow."""
    n = 1 + (numbers >= 1 << 7).astype(np.int64) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    start = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), dtype=np.uint8)
    for k in range(4):
        at = np.flatnonzero(n > k)
        more = (n[at] > k + 1).astype(np.uint8) << 7
        out[start[at] + k] = ((numbers[at] >> (7 * k)) & 127).astype(np.uint8) | more
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    end = np.flatnonzero(raw < 128)
    start = np.append(0, end[:-1] + 1) if len(end) else end
    out = np.zeros(len(end), dtype=np.int64)
    for k in range(4):
        at = np.flatnonzero(start + k <= end)
        out[at] |= (raw[start[at] + k] & 127).astype(np.int64) << (7 * k)
    return out


class _Words(dict):
    """Numbers of a block's marked words, in the order of their first sight."""

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


def _block(rows: pa.Table, codes: list[np.ndarray], words: _Words, block: int) -> Iterator[pa.RecordBatch]:
    """The block's rows with their word numbers in place of texts, then its distinct words, one row per bucket.

    Words found more than once are numbered by falling frequency, so that common ones take one byte, the others after
    them in the order of their buckets. A bucket's row so has the numbers of the former, which stand first, and only the
    first number of the latter.
    """
    every = np.concatenate(codes)
    seen = np.bincount(every, minlength=len(words))
    names = [w.encode() for w in words]
    bucket = np.array([zlib.crc32(w) % BUCKETS for w in names], dtype=np.int32)
    place = np.lexsort((seen == 1, bucket))
    rank = np.empty(len(names), dtype=np.int64)
    order = np.concatenate([np.argsort(-seen, kind="stable")[: int((seen > 1).sum())], place[seen[place] == 1]])
    rank[order] = np.arange(len(order))
    new = [pa.field("block", pa.int64()), pa.field("codes", pa.binary()), pa.field("bucket", pa.int32()), pa.field("words", pa.binary())]
    schema = pa.schema([*rows.schema, *new])
    n = rows.num_rows
    held = pa.Table.from_arrays([
        *rows.columns, pa.array(np.full(n, block)), pa.array([zlib.compress(packed(rank[c]), 1) for c in codes], pa.binary()),
        pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
    ], schema=schema)
    yield from held.to_batches()
    bounds = np.append(np.flatnonzero(np.diff(bucket[place], prepend=-1)), len(names)).tolist()
    runs = [place[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    numbers = []
    for run in runs:
        often = rank[run[seen[run] > 1]]
        numbers.append(packed(np.append(often, rank[run[len(often)]] if len(often) < len(run) else 0)))
    m = len(runs)
    listed = pa.Table.from_arrays([
        *[pa.nulls(m, f.type) for f in rows.schema], pa.array(np.full(m, block)), pa.array(numbers, pa.binary()),
        pa.array(bucket[np.array([r[0] for r in runs], dtype=np.int64)]),
        pa.array([zlib.compress(BETWEEN.join([names[i] for i in r.tolist()]), 1) for r in runs], pa.binary()),
    ], schema=schema)
    yield from listed.to_batches()


def split_blocks(model: bytes):
    """Texts (the last column) to blocks of word numbers and distinct marked words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, task = processor(model), TaskContext.get().partitionId()
        # blocks are numbered apart from buckets, with which they share a column
        words, codes, held, size, block = _Words(), [], [], 0, (task + 1) << 32
        for batch in batches:
            rows, lo = batch.select(list(range(batch.num_columns - 1))), 0
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                text = text.as_py()
                found = MARKED.findall(pieces.normalize(text)) if text else []
                codes.append(np.fromiter(map(words.__getitem__, found), dtype=np.int64, count=len(found)))
                size += len(found)
                if size >= BLOCK_WORDS:
                    held.append(rows.slice(lo, i + 1 - lo))
                    yield from _block(pa.Table.from_batches(held), codes, words, block)
                    words, codes, held, size, block, lo = _Words(), [], [], 0, block + 1, i + 1
            if lo < rows.num_rows:
                held.append(rows.slice(lo))
        if codes:
            yield from _block(pa.Table.from_batches(held), codes, words, block)

    return split


def segment_words(model: bytes):
    """Marked words, sorted by bucket, to the number of ids of each and the ids: each distinct word of a bucket is
    segmented once, whatever the number of blocks that hold it."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = processor(model)
        kind = _kind(pieces)
        # a word is segmented behind another one, whose ids are cut off: a text can't begin with any word as it is
        anchor = len(pieces.encode("a"))
        known: dict[bytes, np.ndarray] = {}
        held: set[bytes] = set()
        open_bucket = None
        for batch in batches:
            buckets = batch.column("bucket").to_pylist()
            rows = [zlib.decompress(x).split(BETWEEN) for x in batch.column("words").to_pylist()]
            missing = [w for w in dict.fromkeys(w for row in rows for w in row) if w not in known]
            for i in range(0, len(missing), SEGMENTED_TOGETHER):
                some = missing[i : i + SEGMENTED_TOGETHER]
                for word, ids in zip(some, pieces.encode(["a" + w.decode() for w in some], num_threads=1)):
                    known[word] = np.array(ids[anchor:], dtype=kind)
            lengths, ids = [], []
            for row in rows:
                parts = [known[w] for w in row]
                lengths.append(zlib.compress(packed(np.array([len(x) for x in parts], dtype=np.int64)), 1))
                ids.append(zlib.compress(np.concatenate(parts).tobytes(), 1))
            # only words of the last bucket can come again
            last = buckets[-1] if buckets else open_bucket
            again = {w for b, row in zip(buckets, rows) if b == last for w in row}
            if last == open_bucket:
                again.update(held)
            known, held, open_bucket = {w: known[w] for w in again}, again, last
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("codes"), pa.array(lengths, pa.binary()), pa.array(ids, pa.binary())],
                names=["block", "codes", "lengths", "ids"],
            )

    return segment


def _kind(pieces: sentencepiece.SentencePieceProcessor) -> str:
    return "<u2" if pieces.get_piece_size() <= 1 << 16 else "<u4"


def join_block(kind: str, kept: int):
    """Rows of one block (the first ``kept`` columns) with the ids of their words, joined by position."""

    def join(rows: pa.Table, words: pa.Table) -> pa.Table:
        sizes = [unpacked(zlib.decompress(x)) for x in words.column("lengths").to_pylist()]
        numbers = []
        for n, x in zip(map(len, sizes), words.column("codes").to_pylist()):
            *often, first = unpacked(x).tolist()
            numbers.append(np.append(often, np.arange(first, first + n - len(often))))
        size, code = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (sizes, numbers))
        flat = np.frombuffer(b"".join(zlib.decompress(x) for x in words.column("ids").to_pylist()), dtype=kind)
        start, length = np.empty_like(code), np.empty_like(code)
        start[code], length[code] = np.cumsum(size) - size, size
        out, ends = [], [0]
        for data in rows.column("codes").to_pylist():
            codes = unpacked(zlib.decompress(data))
            n = length[codes]
            at = np.repeat(start[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append(flat[at].astype(np.int32))
            ends.append(ends[-1] + len(at))
        ids = np.concatenate(out) if out else np.zeros(0, dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(ids))
        return pa.Table.from_arrays([*rows.columns[:kept], lists], names=[*rows.schema.names[:kept], "ids"])

    return join


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the text replaced by the ids that the SentencePiece model gives it, without begin or end ids.

    ``model_path`` is read by the driver; it must name a model whose pieces don't cross white space markers (else
    ``ValueError``). Texts are encoded whole. A null or empty text has no ids (an empty list). Rows are kept as they
    are, repeated ones too; other columns are kept, one named like ``ids_col`` is replaced. An empty table gives an
    empty one.

    A task splits its texts into marked words and gives each block of about two million words a list of distinct words,
    in buckets by a hash. The lists move by bucket, where each distinct word is segmented once, also if every block holds
    it. They come back by block, where ids are joined to the word numbers of each text. A word is moved at most once per
    block and texts only as numbers; no group is larger than a block, which only a single longer text can pass.
    """
    model = checked_model(model_path)
    kept = [c for c in docs.columns if c not in (text_col, ids_col)]
    types = {f.name: f.dataType for f in docs.schema}
    names = [f"c{i}" for i in range(len(kept))]
    own = [StructField(n, types[c], True) for n, c in zip(names, kept)] + [StructField("one", IntegerType())]
    own += [StructField("block", LongType()), StructField("codes", BinaryType())]
    rows = docs.select(*[column(c).alias(n) for c, n in zip(kept, names)], F.lit(1).alias("one"), column(text_col).alias("text"))
    lists = rows.mapInArrow(
        split_blocks(model), StructType([*own, StructField("bucket", IntegerType()), StructField("words", BinaryType())])
    )
    dest = F.coalesce(F.col("bucket").cast("long"), F.col("block")).alias("dest")
    sent = lists.select("*", dest).repartition(parallelism(docs.sparkSession), "dest")
    # both parts come from one shuffle: a condition that could be moved below it would make it two
    never = F.spark_partition_id() < 0
    listed = sent.filter(F.col("bucket").isNotNull() | never).sortWithinPartitions("bucket")
    ids = [StructField(c, BinaryType()) for c in ("codes", "lengths", "ids")]
    back = listed.mapInArrow(
        segment_words(model), StructType([StructField("block", LongType()), *ids])
    )
    texts = sent.filter(F.col("bucket").isNull() | never)
    found = texts.groupBy("dest").cogroup(back.groupBy("block")).applyInArrow(
        join_block(_kind(processor(model)), len(own) - 2), StructType([*own[:-2], StructField("ids", ArrayType(IntegerType()))])
    )
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, kept)], F.col("ids").alias(ids_col))


def decode(ids: Column, model_path: str) -> Column:
    """The text that the model's ids stand for; a null list is an empty text."""
    model = checked_model(model_path)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = processor(model)
        for lists in batches:
            yield pd.Series([pieces.decode(x.tolist()) if x is not None and len(x) else "" for x in lists], dtype=object)

    return decoded(ids)
