"""Mixing, shards, archives, near duplicates, page text and the pipeline against brute force, edge rows included."""

from __future__ import annotations

import collections
import hashlib
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtide.llm import decontam, mixing, neardup, pages, quality, ranks, sharding, warc
from loomtide.llm.queries import op1, op2, op6, op7, op8
from loomtide.session import shared_folder
from tests.llm.conftest import CLASHING, clash, sentence
from tests.llm.test_texts import LOWER, WORD, contaminated, pairs, repetition

# --- ranks


@pytest.mark.parametrize("weight", [None, "w"])
def test_ranks_are_those_of_a_sort(spark, monkeypatch, weight):
    monkeypatch.setattr(ranks, "CELL_ROWS", 8)
    monkeypatch.setattr(ranks, "CELLS_TOGETHER", 4)
    rng = random.Random(1)
    rows = [(rng.choice("aaaab"), rng.getrandbits(60), i, rng.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k long, i long, w long")
    got = {r["i"]: r for r in ranks.ranked(df, "k", ["i"], "g", weight).collect()}
    for g in "ab":
        before = 0
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3])
        for at, (_, _, i, w) in enumerate(own):
            assert (got[i]["_rank"], got[i]["_of"]) == (at, len(own))
            if weight:
                assert (got[i]["_before"], got[i]["_weight_of"]) == (before, sum(r[3] for r in own))
            before += w
    assert ranks.ranked(df.limit(0), "k", ["i"], "g").count() == 0


# --- mixing


def test_targets_share_the_excess():
    got = mixing.targets({"a": 100, "b": 1, "c": 50, None: 10}, mixing.repeating_weights([None, "c", "a", "b"]))
    assert mixing.repeating_weights([None, "c", "a", "b"]) == {"a": 1, "b": 2, "c": 3, None: 1}
    assert sum(got.values()) == 161 and got["b"] == 3 and got[None] == 30
    assert got["a"] == Fraction(128, 4) and got["c"] == Fraction(128 * 3, 4)
    assert mixing.targets({"a": 0}, {"a": 1}) == {"a": 0} and mixing.targets({}, {}) == {}


def test_splits_follow_the_hypergeometric_law():
    rng = np.random.default_rng(3)
    draws = np.array([mixing.split(np.array([60, 30, 10]), 20, rng) for _ in range(3000)])
    assert (draws.sum(axis=1) == 20).all() and (draws <= [60, 30, 10]).all()
    assert np.allclose(draws.mean(axis=0), [12, 6, 2], atol=0.15)
    var = 20 * 0.6 * 0.4 * 80 / 99
    assert abs(draws[:, 0].var() - var) < 0.15 * var
    big = mixing.split(np.array([10**12, 10**11]), 5 * 10**11, rng)
    assert big.sum() == 5 * 10**11 and abs(big[0] / 5e11 - 10 / 11) < 1e-4


def test_leaves_take_every_block_once():
    tree = mixing.Tree([1000, 3, 0, 250], 37, 5)
    seen = [set(), set(), set(), set()]
    for leaf in reversed(range(37)):
        first, counts = tree.leaf(leaf)
        assert counts.sum() == tree.start(leaf + 1) - tree.start(leaf)
        for s in range(4):
            own = set(range(first[s], first[s] + counts[s]))
            assert not own & seen[s]
            seen[s] |= own
    assert [len(s) for s in seen] == [1000, 3, 0, 250]
    again = mixing.Tree([1000, 3, 0, 250], 37, 5)
    assert [a.tolist() for a in again.leaf(11)] == [a.tolist() for a in tree.leaf(11)]


@pytest.mark.parametrize("cut_last", [True, False])
def test_mix_meets_its_targets(edge, cut_last):
    found = mixing.mix(clash(edge), cut_last=cut_last, shard_blocks=5)
    rows = found.rows().collect()
    largest, taken = collections.Counter(), collections.Counter()
    for r in edge.collect():
        largest[r["source"]] = max(largest[r["source"]], len(WORD.findall(r["text"] or "")))
    for r in rows:
        taken[r["doc"]["source"]] += r["n_words"]
    for s in found.sources:
        near = 1 if cut_last else largest[s.name] / 2 + 1
        assert abs(taken[s.name] - s.target) <= near
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) and len(v) <= 5 for v in by_shard.values())
    docs = [(r["doc"]["doc_id"], r["size"], r["taken"]) for r in found.taken().collect()]
    assert len(docs) == edge.count() and all(t <= 3 * n for _, n, t in docs)
    assert sum(t for *_, t in docs) == sum(taken.values())
    again = mixing.mix(clash(edge), cut_last=cut_last, shard_blocks=5)
    key = lambda r: (r["shard"], r["slot"], str(r["doc"]["doc_id"]), r["n_words"])
    assert sorted(map(key, rows)) == sorted(map(key, again.rows().collect()))
    assert mixing.mix(edge.limit(0)).rows().count() == 0 and mixing.mix(edge.limit(0)).taken().count() == 0


def test_mixed_documents_are_whole(edge):
    docs = clash(edge)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    texts = {(r["doc_id"], r["text"]) for r in edge.collect()}
    assert all((r["doc_id"], r["text"]) in texts for r in got.select("doc_id", "text").collect())


def test_op1(spark, small, documents):
    rows = op1(spark, small).join(documents.select("doc_id", "source", "text"), "doc_id").collect()
    sizes = collections.Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
    aims, taken = mixing.targets(sizes, mixing.repeating_weights(list(sizes))), collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == float(aims[r["source"]])
        taken[r["source"]] += r["taken"]
    assert len(rows) == documents.count() and all(0 <= aims[s] - taken[s] < 1 for s in sizes)


# --- shards


def test_interleaved_shards(edge, monkeypatch):
    monkeypatch.setattr(ranks, "CELL_ROWS", 2)
    docs = clash(edge)
    got = sharding.interleave(docs, 4)
    assert set(got.columns) == set(docs.columns)
    rows = got.select("doc_id", "source", "shard", "slot").collect()
    assert len(rows) == edge.count()
    slots, mixture = collections.defaultdict(list), collections.Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        mixture[r["source"], r["shard"]] += 1
    assert set(slots) == {0, 1, 2, 3} and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for s in {r["source"] for r in rows}:
        n = [mixture[s, k] for k in range(4)]
        assert max(n) - min(n) <= 2
    assert sharding.interleave(docs.limit(0), 4).count() == 0


SHARDS_SQL = """
with docs as (select doc_id, text, source, ('0x' || substr(md5(concat('shards|', doc_id)), 1, 15))::bigint as k from documents),
within_source as (
    select *, row_number() over (partition by source order by k, doc_id) - 1 as r, count(*) over (partition by source) as n from docs
),
ordered as (
    select *, count(*) over () as total,
           row_number() over (order by floor((r + 0.5::double) / n * 1099511627776::double)::bigint, source nulls last, r) - 1 as p
    from within_source
)
select doc_id, coalesce(strlen(text), 0) + 1 as size, (p * 16) // total as shard,
       p - ((p * 16) // total * total + 15) // 16 as slot
from ordered
"""


def test_op6_is_what_sql_says(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    got = pairs(op6(spark, small), "doc_id", "size", "shard", "slot")
    assert sorted(got) == sorted(con.execute(SHARDS_SQL).fetchall())


# --- archives


@pytest.fixture(scope="module")
def web(spark):
    big = "<p>" + "text é " * 40
    rows = [
        (1, "http://a.example/x?y=1", big), (2, "http://a.example/", big), (3, None, big), (5, "https://b.example", "<p>small"), (4, "u", "<p>small"),
        (6, "http://a.example/n", None), (7, "http://a.example/e", ""), (8, "http://x/\r\nEvil: 1", "a\r\n\r\nb" * 50 + "\r\n\r\n"),
        (9, "http://a.example/l", "z" * 2_500_000), (None, "http://n.example/", big), (10, "http://a.example/r", big + "r"), (10, "http://a.example/r", big + "r"),
        (11, "http://a.example/q", "é" * 50), (12, "http://a.example/q", "é" * 50), (13, "p", "é" * 49 + "x"), (14, "p", "é" * 49 + "x"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def captured(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        payload = (text or "").encode()
        if len(payload) >= 100 and i is not None:
            groups[payload].append(i)
    out = []
    for i, text in rows:
        payload = (text or "").encode()
        first = min(groups.get(payload, [None]))
        again = first is not None and first != i
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark, web):
    path = shared_folder(spark, "warc-test")
    warc.write_warc(clash(web), path, records_per_file=4)
    got = [tuple(r) for r in warc.page_captures(warc.assemble(warc.read_warc(spark, path))).collect()]
    assert sorted(got, key=str) == captured(pairs(web, "page_id", "html"))
    captures = warc.assemble(warc.read_warc(spark, path, keep_payload=True)).collect()
    assert len(captures) == web.count()
    for c in captures:
        assert len(c["requests"]) == len(c["metadata"]) == 1 and c["requests"][0]["concurrent_to"] == [c["capture_id"]]
        assert c["requests"][0]["block"].startswith("GET /")
        if c["main"]["type"] == "response":
            assert c["main"]["digest_ok"] and hashlib.sha256(c["main"]["payload"]).hexdigest() == c["main"]["payload_digest"]
    empty = shared_folder(spark, "warc-empty")
    warc.write_warc(web.limit(0), empty)
    assert warc.page_captures(warc.assemble(warc.read_warc(spark, empty))).count() == 0


def test_records_of_other_writers(spark):
    record = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <%s>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n"
    raw = b"".join(record % (kind, name, b"".join(b"WARC-Concurrent-To: <%s>\r\n" % c for c in to), len(block), block) for kind, name, to, block in [
        (b"request", b"q1", [b"r1", b"r2"], b"GET / HTTP/1.1\r\n\r\n"), (b"response", b"r1", [], b"HTTP/1.1 200 OK\r\n\r\nbody"),
        (b"response", b"r2", [], b"HTTP/1.1 200 OK"), (b"metadata", b"m9", [b"gone"], b"page-id: 4\r\n"), (b"metadata", b"m8", [], b"page-id: x\r\n"),
        (b"warcinfo", b"w", [], b""),
    ])
    rows = [warc.parsed(head, block, False) for head, block in warc.raw_records(raw)]
    assert [r["record_id"] for r in rows] == ["<q1>", "<r1>", "<r2>", "<m9>", "<m8>", "<w>"]
    got = {c["capture_id"]: c for c in warc.assemble(spark.createDataFrame(rows, warc.RECORDS)).collect()}
    assert set(got) == {"<r1>", "<r2>", "<gone>", "<m8>"}
    assert len(got["<r1>"]["requests"]) == len(got["<r2>"]["requests"]) == 1 and got["<r2>"]["main"]["payload_bytes"] == 0
    assert got["<gone>"]["main"] is None and got["<gone>"]["metadata"][0]["page_id"] == 4 and got["<r1>"]["metadata"] == []


def test_op7(spark, small):
    rows = pairs(spark.read.parquet(f"{small}/pages.parquet"), "page_id", "html")
    assert sorted((tuple(r) for r in op7(spark, small).collect()), key=str) == captured(rows)


# --- near duplicates


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def clusters(rows, k, threshold=80):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and rows[i][0] is not None and rows[j][0] is not None and 5 * min(len(s), len(sets[j])) >= 4 * max(len(s), len(sets[j])):
                both = len(s & sets[j])
                if both and 100 * both >= threshold * (len(s) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def chains(spark):
    """Groups whose members are linked only along a chain, a star of near copies, and pairs just at and below 0.8."""
    rows, n = [], 1000
    for g in range(6):
        base = sentence(500 + g, 200).split()
        for step in range(8):
            rows.append((n := n + 1, " ".join(base[step * 9 :] + sentence(700 + g * 10 + step, step * 9).split())))
    star = sentence(800, 300).split()
    for i in range(150):
        words = list(star)
        words[i * 2 % 300] = f"w{i}"
        rows.append((n := n + 1, " ".join(words)))
    for g in range(20):  # 90 of 110 words in one run: similarity near the threshold, on either side
        w = sentence(900 + g, 130).split()
        rows += [((n := n + 1), " ".join(w[:100])), ((n := n + 1), " ".join(w[5 + g % 8 : 105 + g % 8]))]
    rng = random.Random(4)
    rng.shuffle(rows)
    return spark.createDataFrame([(d * 7919 % 100_003, t) for d, t in rows], "doc_id long, text string")


@pytest.mark.parametrize("k", [2, 5])
def test_components_against_brute_force(spark, edge, k):
    docs = chains(spark).union(edge.select("doc_id", "text"))
    got = neardup.near_duplicates(clash(docs), shingle=k).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == clusters(pairs(docs, "doc_id", "text"), k)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert neardup.near_duplicates(docs.limit(0), shingle=k).count() == 0


def test_what_the_first_round_leaves_is_compared_whole(spark, monkeypatch):
    """With tiny cells and a first round that finds only every third link, the components are the same."""
    docs = chains(spark)
    monkeypatch.setattr(neardup, "CELL_NODES", 3)
    some = neardup.NearDuplicates.first_links
    monkeypatch.setattr(neardup.NearDuplicates, "first_links", lambda self: some(self).filter("pmod(b, 3) = 0"))
    got = sorted((tuple(r)[:3] for r in neardup.near_duplicates(docs, shingle=2).collect()), key=str)
    assert got == clusters(pairs(docs, "doc_id", "text"), 2)


def test_odd_sketches_estimate_high_similarities():
    for shared in (0.8, 0.9, 0.97):
        errors = []
        for seed in range(12):
            w = sentence(seed, 2000).split()
            cut = int(len(w) * (1 - shared) / (1 + shared))
            frame = neardup.signatures([" ".join(w[: len(w) - cut]), " ".join(w[cut:])], 1)
            a, b = (np.array([frame[f"s{i}"][r] for i in range(8)], dtype=np.int64).view(np.uint8) for r in (0, 1))
            differ = np.unpackbits(a ^ b).sum()
            estimate = 1 + neardup.SKETCH_BITS / (4 * neardup.SAMPLES) * np.log(1 - 2 * differ / neardup.SKETCH_BITS)
            s, t = set(w[: len(w) - cut]), set(w[cut:])
            errors.append(estimate - len(s & t) / len(s | t))
        assert abs(np.mean(errors)) < 0.04


def test_components_of_chains(spark):
    rng = random.Random(2)
    names = [rng.getrandbits(62) for _ in range(600)]
    edges = [(a, b) if a < b else (b, a) for a, b in zip(names[:400], names[1:400])] + [(names[400], n) if names[400] < n else (n, names[400]) for n in names[401:]]
    got = neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    by = {r["node"]: r["comp"] for r in got}
    assert len(by) == 600 and len({by[n] for n in names[:400]}) == 1 and len({by[n] for n in names[400:]}) == 1
    assert by[names[0]] != by[names[500]]


def test_without_near_duplicates(edge):
    docs = clash(edge)
    got = neardup.without_near_duplicates(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    want = {d for d, _, c in clusters(pairs(edge, "doc_id", "text"), 5) if d is not None and d == c}
    assert sorted(d for d in ids if d is not None) == sorted(want) and ids.count(None) == 2


def test_op8(spark, small, documents):
    got = sorted((tuple(r)[:3] for r in op8(spark, small).collect()), key=str)
    assert got == clusters(pairs(documents, "doc_id", "text"), 2)


def test_rows_are_kept_by_id_and_text(spark):
    a, b, c, d = (sentence(900 + i, 60) for i in range(4))
    near = a.split()
    rows = [(1, a), (1, b), (2, c), (3, " ".join([*near[:30], "other", *near[31:]])), (4, b), (1, a), (5, None), (5, ""), (5, None), (None, d), (None, d)]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = neardup.without_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(pairs(got, "doc_id", "text"), key=str) == sorted([(1, a), (1, b), (2, c), (5, None), (5, ""), (None, d), (None, d)], key=str)
    assert neardup.without_near_duplicates(df.limit(0)).count() == 0


# --- page text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li>Home</ul></nav><div class="cookie-notice">We use</div><!-- <p>gone</p> -->
<main><article class="post"><header><h2>A &amp; b</h2></header><p>One<br>two <b>bold &lt;x&gt;</b>
 three<p>Four<ul><li>a<li>b</ul><aside>side</aside><form><p>f</form><div id="comments"><p>c</div>
<table><tr><td>1<td>2<tr><td>3</table><p>5 < 6 &eacute;&#233;&#x1F642;</p><div hidden>h</div></article></main><footer>F</footer>"""


def test_large_draws_follow_the_law():
    import math

    import numpy as np

    rng, n = np.random.default_rng(1), 4000
    rare = np.array([mixing.split(np.array([3, 10**10]), 2 * 10**9, rng)[0] for _ in range(n)])
    for k in range(4):  # as good as binomial at this size
        assert abs((rare == k).mean() - math.comb(3, k) * 0.2**k * 0.8 ** (3 - k)) < 0.03
    small = np.array([mixing.large_draw(30, 50, 20, 0, 20, rng) for _ in range(n)])
    for k in range(21):
        assert abs((small == k).mean() - math.comb(30, k) * math.comb(50, 20 - k) / math.comb(80, 20)) < 0.03
    big = np.array([mixing.split(np.array([10**9, 10**9]), 10**9, rng)[0] for _ in range(20)])
    assert abs(big - 5 * 10**8).max() < 6 * 11_181


def test_page_text():
    want = "A & b\n\nOne two bold <x> three\n\nFour\n\na\n\nb\n\n1\n\n2\n\n3\n\n5 < 6 éé🙂"
    assert pages.main_text(pages.parsed(PAGE), frozenset()) == want
    assert pages.main_text(pages.parsed("<p>a<p>b <i>c"), frozenset()) == "a\n\nb c"
    for odd in (None, "", "<", "<p", "<p class='x", "</p></div>", "<!--", "<script>x", "&amp", "<a <b>"):
        assert isinstance(pages.main_text(pages.parsed(odd), frozenset()), str)


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [(i, f"http://s.example/{i}", f"<body><div class=lead>Welcome</div><div class=body><p>{sentence(i, 20)}</div><div class=lead2>Bye</div>") for i in range(20)]
    rows += [(100 + i, f"http://t.example/{i}", f"<body><div class=lead>Welcome</div><p>{sentence(i, 5)}") for i in range(3)]
    rows += [(200, None, "<p>x"), (201, "no url", None), (202, "http://s.example/a", f"<article><p>{'Welcome'}</article>"), (202, "http://s.example/a", "")]
    df = clash(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = pages.extract(df)
    assert set(got.columns) == {*df.columns}
    texts = collections.defaultdict(set)
    for r in got.collect():
        texts[r["page_id"]].add(r["main_text"])
    assert all(texts[i] == {sentence(i, 20)} for i in range(20))
    assert texts[101] == {"Welcome\n\n" + sentence(1, 5)}
    assert texts[200] == {"x"} and texts[201] == {""} and texts[202] == {"Welcome", ""}
    assert pages.extract(df.limit(0)).count() == 0


def test_style_tree_judges_inside_articles_and_on_few_pages(spark):
    def page(i, tail="", around="article"):
        return f"<body><{around}><h1>{sentence(i, 4)}</h1><p>{sentence(500 + i, 20)}<p>By the staff{tail}<div><p>Get our letter</div></{around}>"

    text = lambda i: sentence(i, 4) + "\n\n" + sentence(500 + i, 20)
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(12)]
    rows += [(100 + i, f"http://m.example/{i}", page(100 + i, around="main")) for i in range(12)]
    rows += [(200 + i, f"http://few.example/{i}", f"<div class=lead>Welcome</div><div class=body><p>{sentence(i, 9)}</div>") for i in range(5)]
    # one article at many addresses, and one site with few: nothing is repeated there
    rows += [(300 + i, f"http://copies.example/{i}", f"<nav>{i}</nav>" + page(300)) for i in range(20)]
    rows += [(400 + i, f"http://little.example/{i}", page(400 + i)) for i in range(4)]
    got = {r[0]: r[1] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "main_text").collect()}
    whole = lambda i: text(i) + "\n\nBy the staff\n\nGet our letter"
    assert all(got[i] == text(i) for i in [*range(12), *range(100, 112)])
    assert all(got[200 + i] == sentence(i, 9) for i in range(5))
    assert all(got[300 + i] == whole(300) for i in range(20)) and all(got[i] == whole(i) for i in range(400, 404))


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r[0]: r[1] for r in pages.extract(df).select("page_id", "main_text").collect()}


def test_no_page_loses_all_its_text(spark):
    real = {i: f"{sentence(i, 8)}\n\n{sentence(50 + i, 30)}" for i in range(5)}
    rows = [(100 + i, f"http://gone.example/x{i}", "<html><body><div><p>Not found</p><p>Go home</p></div></body></html>") for i in range(60)]
    rows += [(i, f"http://gone.example/{i}", f"<html><body><div><p>{sentence(i, 8)}</p><p>{sentence(50 + i, 30)}</p></div></body></html>") for i in real]
    rows += [(200 + i, f"http://same.example/{i}", f"<body><div class=text><p>{sentence(7, 30)}</p></div></body>") for i in range(10)]
    got = extracted(spark, rows)
    assert {i: got[i] for i in real} == real
    assert all(got[100 + i] == "Not found\n\nGo home" for i in range(60)) and all(got[200 + i] == sentence(7, 30) for i in range(10))


def test_names_of_real_text_keep_it():
    text = lambda page: pages.main_text(pages.parsed(page), frozenset())
    assert text('<article><h2 id="search-algorithms">A</h2><h2 id="comments">B</h2><h2 id="form-and-function">C</h2><p>d</article>') == "A\n\nB\n\nC\n\nd"
    assert text('<article><section id="alert-rules"><p>a</section><div class="side-by-side"><p>b</div><div class="entry social-science"><p>c</div></article>') == "a\n\nb\n\nc"
    assert text('<body><div class="content login-optional"><p>a</div></body>') == "a"
    assert text('<body><div class="login"><p>a</div></body>') == "a"  # nothing else is left
    for name in ("ad-slot", "site-header", "main-nav", "left sidebar", "cookie-consent-banner", "related-posts", "share-buttons", "comments-area", "page-footer", "widget_search"):
        assert text(f'<body><p>a</p><div class="{name}"><p>b</div></body>') == "a", name
    assert text('<body><div id="comments"><p>only readers</div></body>') == ""


def test_deep_pages_take_time_and_memory_by_their_length():
    import time
    import tracemalloc

    page = "".join(f"<div><b>word{i} " for i in range(20_000)) + "</i>" * 20_000
    start = time.perf_counter()
    tree = pages.parsed(page)
    rows = pages.observed(tree)
    low = frozenset(r[0] for r in rows[5000:5002])
    kept = pages.main_text(tree, low)
    assert time.perf_counter() - start < 4
    assert len(tree.blocks) == 20_000 and kept.startswith("word0\n\nword1\n\n") and len(rows) == 40_000
    assert kept.endswith("word17498")  # the branch that is low, and all that is in it
    tracemalloc.start()
    pages.observed(pages.parsed(page))
    assert tracemalloc.get_traced_memory()[1] < 100 * 2**20
    tracemalloc.stop()


def test_style_tree_against_brute_force(spark):
    """Entropies of branches from the texts and layouts themselves, written as strings."""
    import math

    def page(i):
        extra = "<p>two</p>" if i % 3 else ""
        return f"<body><div class=top><p>hello {i % 2}</p></div><div class=body><p>{sentence(i // 2, 6)}</p>{extra}</div><div class=end><p>bye</p></div></body>"

    rows = [(i, "http://h.example/", page(i)) for i in range(24)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["branch"]: (r["n_pages"], r["presentation"], r["content"]) for r in pages.style_tree(df).collect()}
    layouts, texts = collections.defaultdict(dict), collections.defaultdict(dict)
    for _, _, page_html in rows:
        parts = re.findall(r"<div class=(\w+)>(.*?)</div>", page_html)
        key = page_html
        for name, inside in parts:
            ps = re.findall("<p>(.*?)</p>", inside)
            layouts[f"/body/div.{name}"][key] = "p" if ps else ""
            texts[f"/body/div.{name}"][key] = "\n".join(ps)
            layouts[f"/body/div.{name}/p"][key], texts[f"/body/div.{name}/p"][key] = "", "\n".join(ps)
        layouts["/body"][key], texts["/body"][key] = "|".join(n for n, _ in parts), page_html

    def entropy(values):
        n, of = len(values), collections.Counter(values)
        return 1.0 if n <= 1 else sum(-c / n * math.log2(c / n) for c in of.values()) / math.log2(n)

    want = {}
    for path in layouts:
        h = 1
        for name in path.strip("/").split("/"):
            h = pages._mix(h, pages._digest(name))
        want[pages._signed(h)] = (len(texts[path]), entropy(list(layouts[path].values())), entropy(list(texts[path].values())))
    assert got.keys() == want.keys()
    for branch, (n, presentation, content) in want.items():
        assert got[branch] == (n, pytest.approx(presentation), pytest.approx(content))


def test_op2_gives_the_articles(spark, small):
    import html

    source = {r["page_id"]: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = op2(spark, small).collect()
    assert len(rows) == len(source)
    for r in rows:
        article = source[r["page_id"]]["html"].split("<article>")[1].split("</article>")[0]
        parts = [re.sub(r"\s+", " ", html.unescape(p)).strip() for p in re.split(r"</?(?:h1|p|b|br)>", article)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


# --- pipeline


def test_stages_against_brute_force(spark, small, documents):
    names = documents.columns
    items = pairs(spark.read.parquet(f"{small}/benchmark.parquet"), "item_id", "text")
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before = pairs(docs, "doc_id", "text")
        out = ranks.stored(stage(spark, docs, small), "stage-test")
        after = pairs(out, "doc_id", "text")
        if name == "quality":
            assert sorted(after) == sorted(r for r in before if repetition(r[1])[6])
        elif name == "near_duplicates":
            kept = {d for d, _, c in clusters(before, 5) if d == c}
            assert sorted(after) == sorted(r for r in before if r[0] in kept) and len(after) < len(before)
        elif name == "decontamination":
            dirty = {d for d, _, hit, _ in contaminated(before, items) if hit}
            assert dirty and sorted(after) == sorted(r for r in before if r[0] not in dirty)
        elif name == "mixture":
            source = dict(pairs(docs, "doc_id", "source"))
            sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
            for d, t in before:
                sizes[source[d]] += len(WORD.findall(t))
                largest[source[d]] = max(largest[source[d]], len(WORD.findall(t)))
            for d, t in after:
                taken[source[d]] += len(WORD.findall(t))
            aims = mixing.targets(sizes, mixing.repeating_weights(list(sizes)))
            assert set(after) <= set(before) and max(collections.Counter(after).values()) <= 3
            assert all(abs(taken[s] - aims[s]) <= largest[s] / 2 + 1 for s in sizes)
        else:
            n = collections.Counter(r["shard"] for r in out.collect())
            assert sorted(after) == sorted(before) and max(n.values()) - min(n.values()) <= 1 and len(n) == 16
        if name != "shards":
            assert out.columns == names
        docs = out


def test_stages_bear_edge_rows(spark, small, edge):
    for docs in (clash(edge), edge.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = ranks.stored(stage(spark, docs, small), "stage-edge")
        assert {"shard", "slot"} <= set(docs.columns)
