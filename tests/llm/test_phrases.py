"""Collocations, filter orders and SentencePiece encoding against brute force, edge rows included."""

from __future__ import annotations

import collections
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loomtide.llm import audit, collocations, pieces
from loomtide.llm.queries import op12, op13
from tests.llm.conftest import clash, sentence

MODEL = public_tokenizers.path("piece_bpe_32k.model")

# --- collocations


def phrases_of(rows, max_words):
    """Counts of (lang, phrase) by plain loops, and words per language."""
    counts, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, max_words + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    return counts, total


def best_phrases(rows, min_count, max_words, top):
    counts, total = phrases_of(rows, max_words)
    often = {k: a for k, a in counts.items() if a >= min_count}
    out = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        inside = (
            q for (other, q) in often
            if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        )
        if any(100 * often[lang, q] >= 80 * a for q in inside):
            continue
        cuts = [(often[lang, p[:k]], often[lang, p[k:]]) for k in range(1, len(p))]
        score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {
        (lang, rank): (p.decode(), -a, l, r, total[lang], -score)
        for lang, found in out.items() for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1)
    }


@pytest.fixture(scope="module")
def chatter(spark):
    rng = random.Random(4)
    words = ["of", "the", "New", "york", "é", "a_b", "漢字", "x" * 50, "city", "Hall"]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words[: rng.randint(2, 10)]) + rng.choice(["", "", "", ".", ",", "\n", "\t", "  ", "\r\n"]) for _ in range(rng.randint(0, 40)))
        rows.append((i, rng.choice(["en", "en", "en", "fr", None, "und"]), text))
    rows += [(500, "en", None), (501, "en", ""), (None, None, None), (502, "en", " \t. \n"), (503, "fr", "new york " * 3000)]
    rows += [(504, "fr", "one two three four five six")] * 40
    return rows, spark.createDataFrame(rows, "doc_id long, lang string, text string")


@pytest.mark.parametrize("one_in,block", [(1, 1 << 22), (8, 2000), (1 << 40, 500)])
def test_collocations_are_those_of_brute_force(spark, monkeypatch, chatter, one_in, block):
    monkeypatch.setattr(collocations, "BLOCK_CHARS", block)
    monkeypatch.setattr(collocations, "TOP_SLICES", 3)
    rows, df = chatter
    want = best_phrases([r[1:] for r in rows], 30, 4, 25)
    got = collocations.collocations(clash(df), top=25, one_in=one_in).collect()
    assert {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got} == want
    assert len(got) == len(want) and len({lang for lang, _ in want}) == 3


def test_a_bad_sample_only_costs_passes(spark, monkeypatch, chatter):
    """Without a sample every frequent word is a failure; with all rows as the sample no expansion is needed."""
    passes = []
    plain = collocations.counted
    monkeypatch.setattr(collocations, "counted", lambda *a: passes.append(a[1:]) or plain(*a))
    _, df = chatter
    wanted = {(r["lang"], r["phrase"]): r["count"] for r in collocations.frequent_phrases(df, one_in=1).collect()}
    assert len(passes) == 2
    assert {(r["lang"], r["phrase"]): r["count"] for r in collocations.frequent_phrases(df, one_in=1 << 40).collect()} == wanted
    assert len(passes) == 2 + 3


def test_a_full_bitmap_counts_more_and_finds_the_same(spark, monkeypatch, chatter):
    _, df = chatter
    want = sorted(collocations.frequent_phrases(df).collect())
    plain = collocations.bitmap
    monkeypatch.setattr(collocations, "bitmap", lambda h: plain(h) | np.uint64(0xFFFFFFFFFFFFFFFF))
    assert sorted(collocations.frequent_phrases(df).collect()) == want


def test_collocations_of_nothing_and_of_large_counts(spark, chatter):
    _, df = chatter
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.filter("text is null or text = ''")).count() == 0
    huge = spark.sql("select 6000000000000000000L as a, 7000000000000000000L as l, 8000000000000000000L as r")
    score = F.call_function("div", collocations._decimal("a") * F.lit(2_000_000), collocations._decimal("l") + collocations._decimal("r"))
    assert huge.select(score).first()[0] == 2_000_000 * 6 // 15


# --- filter orders


def orders_by_hand(docs, labels):
    """Every order applied to the documents themselves."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        f = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        fails.append((lang or "", f, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        shapley = collections.Counter()
        own = [f for f in fails if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                shapley[x] += len(gone)
                redundant = sum(f[1][x] for f in own) - len(gone)
                alone = sum(f[1][x] and sum(f[1].values()) == 1 for f in own)
                out[part, order, step] = [len(left), len(gone), redundant, alone, sum(g[2] for g in gone), sum(g[3] for g in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (7, 1, 0), (9, 0, 1), (None, 1, 1), (99, 1, 1), (16, None, 1), (21, 1, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_orders_are_those_of_brute_force(spark, edge, labelled):
    words = " ".join(f"w{i}" for i in range(120))
    more = spark.createDataFrame(
        [(50, words, "en", "a", 1), (51, words, None, "a", 1), (51, words, "", "a", 1), (52, words + " $", "fr", "a", 1),
         (49, words.upper(), "fr", "a", 1), (53, "word " * 200, "fr", "a", 1)], edge.schema,
    )
    docs = edge.unionByName(more)
    want = orders_by_hand([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], labelled[0])
    got = audit.audit(audit.mask_cells(clash(docs), labelled[1])).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in NUMBERS) for r in got} == want
    assert len(got) == len(want) == 3 * 600


def test_orders_of_nothing_and_without_labels(spark, edge, labelled):
    assert audit.audit(audit.mask_cells(edge.limit(0), labelled[1])).count() == 0
    rows = audit.audit(audit.mask_cells(edge, labelled[1].limit(0))).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(rows) == (0, 0)


def test_other_numbers_of_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 0, 0), ("p", 2, 1, 0, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): r for r in audit.audit(cells, "AB").collect()}
    assert {k: (r["kept"], r["removed"], r["redundant"], r["shapley"]) for k, r in got.items()} == {
        ("AB", 1): (6, 2, 0, 2), ("AB", 2): (5, 1, 2, 4), ("BA", 1): (5, 3, 0, 4), ("BA", 2): (5, 0, 2, 2),
    }


def test_audit_query_adds_up(spark, small):
    """Whatever the order, the last step leaves the documents that fail nothing."""
    rows = op12(spark, small).filter("step = 5").groupBy("part").agg(F.min("kept").alias("lo"), F.max("kept").alias("hi")).collect()
    assert rows and all(r["lo"] == r["hi"] for r in rows)


# --- pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


ODD = [
    "Hello  world", " ", "   ", "a ", " a", "▁", "a▁b", "▁▁a ▁", "\n", "a\n b \n", "a\x00b", "\x00", "🙂🙂x", "　x\xa0y", "ﬁ Ⅷ é é",
    "<s> </s> <unk> <0x0A>", "\r\n\r\n};\r", "​﻿", "�", "日本語 テキスト", "a" * 5000, " " * 300, "ab " * 2000,
]


@pytest.mark.parametrize("block", [1 << 21, 5])
def test_ids_are_those_of_the_library(spark, monkeypatch, edge, library, block):
    monkeypatch.setattr(pieces, "BLOCK_WORDS", block)
    more = spark.createDataFrame([(100 + i, t, None, "odd", i) for i, t in enumerate(ODD)], edge.schema)
    docs = clash(edge.unionByName(more)).withColumn("ids", F.lit("clash")).withColumn("block", F.lit(1)).withColumn("word", F.lit("w"))
    encoded = pieces.encode(docs, MODEL)
    assert encoded.columns == [c for c in docs.columns if c not in ("text", "ids")] + ["ids"]
    got = encoded.withColumn("decoded", pieces.decode(F.col("ids"), MODEL)).select("doc_id", "n_chars", "source", "ids", "decoded").collect()
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "")
        want.append((r["doc_id"], r["n_chars"], r["source"], ids, library.decode(ids)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_query_of_pieces(spark, small, library, documents):
    got = {r["doc_id"]: r["n_tokens"] for r in op13(spark, small).collect()}
    assert got == {r["doc_id"]: len(library.encode(r["text"] or "")) for r in documents.collect()}


def test_encoding_of_nothing(spark, edge):
    assert pieces.encode(edge.limit(0), MODEL).count() == 0
    only = edge.select("text").filter("text is null or text = ''")
    assert [r["ids"] for r in pieces.encode(only, MODEL).collect()] == [[]] * only.count()
    assert spark.range(1).select(pieces.decode(F.lit(None).cast("array<int>"), MODEL)).first()[0] == ""


def test_a_model_that_crosses_markers_is_refused(monkeypatch):
    monkeypatch.setattr(pieces, "CROSSES", re.compile("▁t"))
    with pytest.raises(ValueError):
        pieces.checked_model(MODEL)


def test_packed_numbers_come_back():
    rng = random.Random(1)
    numbers = np.array([0, 127, 128, 16383, 16384, 2097151, 2097152, 2**28 - 1] + [rng.randrange(1 << rng.randint(1, 28)) for _ in range(999)])
    assert (pieces.unpacked(pieces.packed(numbers)) == numbers).all()
    assert len(pieces.unpacked(pieces.packed(numbers[:0]))) == 0
