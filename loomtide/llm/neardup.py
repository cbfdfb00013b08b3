"""Near duplicates: MinHash bands find candidates, odd sketches rule most out, whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtide.llm import words as W
from loomtide.llm.ranks import column, stored, unused

SHINGLE = 5
THRESHOLD = 80
#: MinHash samples in bands of ROWS. A pair of similarity 0.8 shares no band with a chance of 5e-8.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch. A pair is ruled out if the estimate is so far below the threshold (more than 5 deviations).
SKETCH_BITS = 512
SKETCH_SLACK = 0.25
#: Nodes and shingles on each side of a cell in which two components are compared.
CELL_NODES = 64
CELL_SHINGLES = 40_000
#: Shingles that are permuted together, to stay in the processor's cache.
CHUNK = 1 << 15

_FLIP = W.mixed(np.arange(1000, 1000 + SAMPLES, dtype=np.uint64))
_TIMES = W.mixed(np.arange(5000, 5000 + SAMPLES, dtype=np.uint64)) | np.uint64(1)

SIGNATURE = (
    "n long, node long, bands array<long>, "
    + ", ".join(f"s{i} long" for i in range(SKETCH_BITS // 64))
)


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of k words of each text; of fewer words, the hash of them all."""
    out = []
    for lo, hi in W.groups(texts):
        w = W.words(texts[lo:hi])
        own = np.flatnonzero(W.inside_text(w.text, k))
        hashes, text = W.window_hashes(w.hash, k)[own], w.text[own]
        cut = np.searchsorted(text, np.arange(w.n_texts + 1))
        first = w.first()
        for a, b in zip(cut[:-1], cut[1:]):
            hashes[a:b].sort()
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        hashes, text = hashes[new], text[new]
        cut = np.searchsorted(text, np.arange(w.n_texts + 1))
        for i in range(w.n_texts):
            n = first[i + 1] - first[i]
            if 0 < n < k:
                out.append(W.window_hashes(w.hash[first[i] : first[i + 1]], int(n)) ^ _FLIP[n])
            else:
                out.append(hashes[cut[i] : cut[i + 1]])
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each set (none is empty) under each permutation: an array of sets x samples."""
    out = np.empty((len(sets), SAMPLES), dtype=np.uint64)
    lo = 0
    while lo < len(sets):
        hi, size = lo + 1, len(sets[lo])
        while hi < len(sets) and size + len(sets[hi]) <= CHUNK:
            size += len(sets[hi])
            hi += 1
        every = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0] + [len(s) for s in sets[lo : hi - 1]])
        for k in range(SAMPLES):
            out[lo:hi, k] = np.minimum.reduceat((every ^ _FLIP[k]) * _TIMES[k], starts)
        lo = hi
    return out


def signatures(texts: list, k: int) -> pd.DataFrame:
    """The columns of ``SIGNATURE``: size, digest, band keys and odd sketch of the shingle set of each text.

    An odd sketch has one bit per residue class of the samples, flipped by each sample that falls on it, so that the
    XOR of two sketches is the sketch of the samples in which they differ.
    """
    sets = shingle_sets(texts, k)
    n = np.array([len(s) for s in sets], dtype=np.int64)
    full = np.flatnonzero(n)
    node = np.zeros(len(sets), dtype=np.int64)
    sketch = np.zeros((len(sets), SKETCH_BITS // 64), dtype=np.int64)
    bands: list = [[]] * len(sets)
    if len(full):
        some = [sets[i] for i in full]
        starts = np.cumsum([0] + [len(s) for s in some[:-1]])
        digest = np.add.reduceat(W.mixed(np.concatenate(some) ^ W.SALT), starts)
        node[full] = W.mixed(digest + n[full].astype(np.uint64) * W.STEP).view(np.int64)
        least = minhashes(some)
        keys = np.zeros((len(some), BANDS), dtype=np.uint64)
        for r in range(ROWS):
            keys = W.mixed(keys * W.STEP + least[:, r::ROWS])
        keys ^= _FLIP[:BANDS]
        keys = W.mixed(keys).view(np.int64)
        bit = (W.mixed(least ^ _TIMES) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
        flat = bit + np.arange(len(some))[:, None] * SKETCH_BITS
        odd = np.bincount(flat.ravel(), minlength=len(some) * SKETCH_BITS) & 1
        sketch[full] = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(some), -1)
        for i, j in enumerate(full):
            bands[j] = keys[i]
    frame = pd.DataFrame({"n": n, "node": pd.array(np.where(n > 0, node, 0), dtype="Int64"), "bands": bands})
    frame.loc[n == 0, "node"] = pd.NA
    for i in range(sketch.shape[1]):
        frame[f"s{i}"] = sketch[:, i]
    return frame


def linked(a: list, b: list, k: int, threshold: int) -> list[bool]:
    """Whether the shingle sets of each pair of texts are similar: 100 * intersection >= threshold * union."""
    different = list(dict.fromkeys([*a, *b]))
    sets = dict(zip(different, shingle_sets(different, k)))
    out = []
    for x, y in zip(a, b):
        s, t = sets[x], sets[y]
        both = len(np.intersect1d(s, t, assume_unique=True))
        out.append(bool(both) and 100 * both >= threshold * (len(s) + len(t) - both))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b): everything reachable has one ``comp``.

    Each round every node goes to its smallest neighbour, itself included, and edges are drawn between the targets.
    Node numbers are hashes, so a round takes away a good share of the nodes of every component, chains as well, and
    a star is done in one.
    """
    steps = []
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m"))
        up = stored(up.select("node", F.least("node", "_m").alias("parent")), "component-step")
        steps.append(up)
        at = [up.select(F.col("node").alias(f"_n{x}"), F.col("parent").alias(f"_p{x}")) for x in "ab"]
        moved = edges.join(at[0], F.col("a") == F.col("_na")).join(at[1], F.col("b") == F.col("_nb")).filter("_pa <> _pb")
        edges = stored(moved.select(F.least("_pa", "_pb").alias("a"), F.greatest("_pa", "_pb").alias("b")).distinct(), "component-edges")
        if edges.isEmpty():
            break
    out = steps[0].withColumnRenamed("parent", "comp")
    for up in steps[1:]:
        out = out.join(up.select(F.col("node").alias("_n"), "parent"), F.col("comp") == F.col("_n"), "left").select(
            "node", F.coalesce("parent", "comp").alias("comp")
        )
    return out


def _sketches(x: str) -> list[str]:
    return [f"{x}{i}" for i in range(SKETCH_BITS // 64)]


def differing(a: str = "a_", b: str = "b_") -> Column:
    """Bits in which the odd sketches of two nodes differ."""
    bits = [F.bit_count(F.col(a + s).bitwiseXOR(F.col(b + s))) for s in _sketches("s")]
    return sum(bits[1:], bits[0])


def may_link(threshold: int, a: str = "a_", b: str = "b_") -> Column:
    """Whether sizes and odd sketches of two nodes allow the similarity."""
    least = max(0.0, threshold / 100 - SKETCH_SLACK)
    most = SKETCH_BITS / 2 * (1 - exp(-4 * SAMPLES * (1 - least) / SKETCH_BITS))
    small, large = F.least(a + "n", b + "n"), F.greatest(a + "n", b + "n")
    return (100 * small >= threshold * large) & (differing(a, b) <= int(most) + 1)


def block_links(cell: pd.DataFrame, k: int, threshold: int) -> pd.DataFrame:
    """Links between the left (side 0) and right nodes of a cell, as many as join all that they can join.

    Nodes of side 1 are one component already; those of side 2 are alone like those on the left.
    """
    cell = cell.sort_values(["side", "node"])
    sets = dict(zip(cell["node"], shingle_sets(cell["_text"].tolist(), k)))
    left = cell.loc[cell["side"] == 0, "node"].tolist()
    right = cell.loc[cell["side"] > 0, "node"].tolist()
    members = int((cell["side"] == 1).sum())
    found: list[tuple[int, int]] = []
    root: dict[int, int] = {}

    def top(node: int) -> int:
        while root.setdefault(node, node) != node:
            node = root[node]
        return node

    if left and right:
        size = np.array([len(sets[y]) for y in right])
        values = np.concatenate([sets[y] for y in right])
        order = np.argsort(values)
        values, owner = values[order], np.repeat(np.arange(len(right)), size)[order]
        for x in left:
            own = sets[x]
            lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            n = hi - lo
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            both = np.bincount(owner[at], minlength=len(right))
            hits = np.flatnonzero((both > 0) & (100 * both >= threshold * (len(own) + size - both)))
            inside = np.searchsorted(hits, members)
            for j in [*hits[: min(1, inside)], *hits[inside:]]:
                y = right[j]
                host = right[0] if j < members else y  # the component counts as its first member
                if top(x) != top(host):
                    root[top(x)] = top(host)
                    found.append((x, y))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


class NearDuplicates:
    """The steps of ``near_duplicates``; tables in between are written to the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: int) -> None:
        self.shingle, self.threshold = shingle, threshold
        self.docs = docs.select(column(id_col).alias("_id"), column(text_col).alias("_text"))

        @F.pandas_udf(SIGNATURE)
        def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield signatures(texts.tolist(), shingle)

        @F.pandas_udf("boolean")
        def same(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for a, b in batches:
                yield pd.Series(linked(a.tolist(), b.tolist(), shingle, threshold), dtype=bool)

        self.same = same
        self.rows = stored(
            self.docs.select("_id", F.xxhash64("_text").alias("_hash"), signed("_text").alias("_s")).select("_id", "_hash", "_s.*"),
            "signatures",
        )
        self.sets = self.rows.filter("node is not null and _id is not null")
        self.nodes = stored(
            self.sets.groupBy("node").agg(F.min("_id").alias("rep"), F.min("n").alias("n"), *[F.min(s).alias(s) for s in _sketches("s")]),
            "nodes",
        )
        in_bands = self.sets.select(F.explode("bands").alias("bucket"), "node")
        shared = in_bands.groupBy(F.col("bucket").alias("_b")).agg(
            F.min("node").alias("_lo"), F.max("node").alias("_hi"), F.count("*").alias("_rows")
        )
        shared = stored(shared.filter("_lo < _hi").select("_b", "_rows"), "shared-buckets")
        #: The nodes of each bucket that several nodes share, with the bucket's number of rows.
        self.members = stored(
            in_bands.join(shared, F.col("bucket") == F.col("_b")).groupBy("bucket", "node").agg(F.min("_rows").alias("rows")),
            "bucket-members",
        )

    def described(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with the columns of both nodes, where the similarity is possible."""
        for x in "ab":
            side = self.nodes.select(*[F.col(c).alias(f"{x}_{c}") for c in ("node", "n", *_sketches("s"))])
            pairs = pairs.join(side, F.col(x) == F.col(f"{x}_node"))
        return pairs.filter(may_link(self.threshold))

    def texts(self, nodes: DataFrame, everywhere: bool = False) -> DataFrame:
        """(node, _text) of some nodes, a text for each; ``everywhere``: of a part of the corpus that grows with it."""
        wanted = nodes.distinct().join(self.nodes.select("node", F.col("rep").alias("_id")), "node")
        wanted = wanted.join(self.rows.select("node", "_id", "_hash"), ["node", "_id"]).distinct()
        wanted = stored(wanted.select("node", F.col("_id").alias("_wid"), F.col("_hash").alias("_whash")), "wanted")
        # the wanted rows grow with the corpus, so this is a merge join at every size
        texts = self.docs.join(
            wanted.hint("merge") if everywhere else wanted, (F.col("_id") == F.col("_wid")) & (F.xxhash64("_text") == F.col("_whash"))
        )
        return stored(texts.select("node", "_text").dropDuplicates(["node"]), "texts")

    def confirmed(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs that the whole shingle sets confirm."""
        for x in "ab":
            side = texts.select(F.col("node").alias(f"{x}_node"), F.col("_text").alias(f"{x}_text"))
            pairs = pairs.join(side, F.col(x) == F.col(f"{x}_node"))
        return pairs.filter(self.same("a_text", "b_text")).select("a", "b")

    def first_links(self) -> DataFrame:
        """Each node's links to the heaviest and to the most similar head of its buckets, if the sets confirm them.

        A node's weight is the number of rows in its buckets, the head of a bucket its heaviest node: of a group of near
        copies, the one with the fewest changes, to which most others are similar enough. The most similar head, by the
        sketches, takes up nodes that are far from it.
        """
        weight = self.members.groupBy(F.col("node").alias("_n")).agg(F.sum("rows").alias("_weight"))
        weighed = self.members.join(weight, F.col("node") == F.col("_n"))
        heads = weighed.groupBy(F.col("bucket").alias("_b")).agg(F.max(F.struct("_weight", "node")).alias("_head"))
        heads = stored(heads.select("_b", F.col("_head.node").alias("a"), F.col("_head._weight").alias("weight")), "heads")
        stars = self.members.join(heads, F.col("bucket") == F.col("_b")).filter("a <> node")
        stars = self.described(stars.select("a", F.col("node").alias("b"), "weight").distinct())
        chosen = stored(stars.groupBy("b").agg(
            F.min(F.struct(differing().alias("_d"), "a"))["a"].alias("_near"), F.max(F.struct("weight", "a"))["a"].alias("_heavy")
        ), "chosen-heads")
        #: The heaviest head of each node that has one it may be linked to.
        self.heaviest = chosen.select("b", "_heavy")
        pairs = chosen.select(F.explode(F.array_distinct(F.array("_near", "_heavy"))).alias("a"), "b")
        pairs = stored(pairs, "candidates")
        self.fetched = self.texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), everywhere=True)
        return stored(self.confirmed(pairs, self.fetched), "links")

    def other_links(self, comps: DataFrame) -> DataFrame:
        """Links between components of which nodes share a bucket; all that are needed to join what can be joined.

        A node of the smaller of two components is compared with all of the larger, in cells of bounded size. A node that
        is alone is at home with the component of its heaviest head, so that its cells hold the other nodes at home there
        as well; only lone nodes with different homes are compared in pairs. So the work grows with the nodes that the
        first round has left over, not with the square of a group of copies.
        """
        homes = self.heaviest.join(comps.select(F.col("node").alias("_n"), F.col("comp").alias("home")), F.col("_heavy") == F.col("_n"))
        at = self.nodes.select("node").join(comps.select(F.col("node").alias("_n"), "comp"), F.col("node") == F.col("_n"), "left")
        at = at.join(homes.select("b", "home"), F.col("node") == F.col("b"), "left").select(
            F.col("node").alias("_n"), F.coalesce("comp", "node").alias("comp"), F.col("comp").isNull().alias("alone"),
            F.coalesce("comp", "home", "node").alias("home"),
        )
        at = stored(at, "placed")
        placed = self.members.select("bucket", "node").join(at, F.col("node") == F.col("_n")).drop("_n")
        open_ = placed.groupBy(F.col("bucket").alias("_b")).agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo < _hi")
        open_ = stored(open_.select("_b"), "open-buckets")
        placed = stored(placed.join(open_, F.col("bucket") == F.col("_b")).drop("_b"), "open-members")

        data = self.nodes.select(F.col("node").alias("_n"), "n", *_sketches("s"))
        alone = placed.filter("alone").select("bucket", "node", "home").join(data, F.col("node") == F.col("_n")).drop("_n")
        alone = stored(alone, "alone")
        a, b = (alone.select(*[F.col(c).alias(f"{x}_{c}") for c in alone.columns]) for x in ("a", "b"))
        apart = (F.col("a_node") < F.col("b_node")) & (F.col("a_home") != F.col("b_home"))
        pairs = a.join(b, (F.col("a_bucket") == F.col("b_bucket")) & apart & may_link(self.threshold))
        pairs = stored(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), "pairs")

        sizes = comps.groupBy(F.col("comp").alias("_c")).agg(F.count("*").alias("size"))
        sized = placed.join(sizes, F.col("comp") == F.col("_c"), "left").select("bucket", "node", "comp", F.coalesce("size", F.lit(1)).alias("size"))
        larger = sized.filter("size > 1").select(F.col("bucket").alias("_b"), F.col("comp").alias("into"), F.col("size").alias("_size")).distinct()
        order = F.struct("size", "comp") < F.struct("_size", "into")
        visits = stored(
            sized.join(larger, (F.col("bucket") == F.col("_b")) & (F.col("comp") != F.col("into")) & order).select("node", "into").distinct(),
            "visits",
        )
        hosts = at.select(F.col("_n").alias("node"), F.col("home").alias("into"), F.when(F.col("alone"), 2).otherwise(1).alias("side"))
        hosts = stored(hosts.join(visits.select("into").distinct(), "into", "left_semi"), "visited")
        visits = visits.withColumn("side", F.lit(0))
        sides = []
        for side, rows in ((0, visits), (1, hosts)):
            shingles = rows.join(data.select("_n", "n"), F.col("node") == F.col("_n"))
            cuts = F.ceil(F.greatest(F.count("*") / CELL_NODES, F.sum("n") / CELL_SHINGLES)).cast("int")
            sides.append(shingles.groupBy(F.col("into").alias("_c")).agg(cuts.alias(f"_cuts{side}")))
        grid = stored(sides[0].join(sides[1], "_c"), "grid")
        cells = []
        for side, rows in ((0, visits), (1, hosts)):
            own, across = (F.col(f"_cuts{x}") for x in (side, 1 - side))
            part = F.pmod(F.xxhash64("node"), own).cast("int").alias(f"_at{side}")
            every = F.explode(F.sequence(F.lit(0), across - 1)).alias(f"_at{1 - side}")
            cut = rows.join(grid, F.col("into") == F.col("_c")).select("into", "node", "side", part, every)
            cells.append(cut.select("into", "_at0", "_at1", "side", "node"))
        nodes = [visits.select("node"), hosts.select("node"), pairs.select(F.col("a").alias("node")), pairs.select("b")]
        wanted = nodes[0].union(nodes[1]).union(nodes[2]).union(nodes[3]).distinct()
        texts = self.fetched.union(self.texts(wanted.join(self.fetched.select("node"), "node", "left_anti")))
        filled = cells[0].union(cells[1]).join(texts.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n")
        k, threshold = self.shingle, self.threshold
        across = filled.groupBy("into", "_at0", "_at1").applyInPandas(lambda cell: block_links(cell, k, threshold), "a long, b long")
        return stored(self.confirmed(pairs, texts).unionByName(across), "more-links")

    def labels(self) -> DataFrame:
        """(node, comp, component_id) for every set of shingles; different components may have one smallest id."""
        links = self.first_links()
        comps = stored(components(links), "components")
        more = self.other_links(comps)
        if not more.isEmpty():
            comps = stored(components(links.unionByName(more)), "components")
        nodes = self.nodes.select("node", "rep")
        joined = nodes.join(comps.select(F.col("node").alias("_n"), "comp"), F.col("node") == F.col("_n"), "left")
        joined = joined.select("node", "rep", F.coalesce("comp", "node").alias("comp"))
        least = joined.groupBy(F.col("comp").alias("_c")).agg(F.min("rep").alias("component_id"))
        return joined.join(stored(least, "component-ids"), F.col("comp") == F.col("_c")).select("node", "comp", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD,
) -> DataFrame:
    """Per row of ``docs``: the id, ``n_shingles``, ``component_id`` and ``kept``.

    Words have no ASCII white space, A-Z is lower-cased. A document's set are the distinct runs of ``shingle`` words of
    its whole text; with fewer words, all of them as one. Documents are linked if 100 * intersection >= threshold *
    union; ``component_id`` is the smallest id that links lead to, ``kept`` whether the row has it.

    Equal sets are one node. Nodes that share one of 32 bands of MinHash values are candidates; a pair at the threshold
    shares none with a chance of 5e-8. First each node is tried against two heads of its buckets, and components
    are formed. Then what shares a bucket across components is compared, all of it, in cells of bounded size. A group of
    near copies so costs one comparison per member, and one per member for each cell of nodes that the first round left
    over. Odd sketches, parity bitmaps of the MinHash values whose XOR counts their differences, rule out the pairs
    that are clearly apart; the others are decided on their full sets.

    Null and empty texts, and texts of white space, have no set and are linked with nothing. A row without an id is
    linked with nothing: its ``component_id`` is null and it is kept. Rows that repeat an id are linked by each text's
    set; a component's smallest id may then be kept in several rows. Ties don't matter. An empty table gives an empty
    one. Sets are compared by a 64-bit digest when they are made nodes.
    """
    work = NearDuplicates(docs, id_col, text_col, shingle, threshold)
    labels = stored(work.labels().select(F.col("node").alias("_n"), "component_id"), "labels")
    found = work.sets.select("_id", "n", "node").join(labels, F.col("node") == F.col("_n")).select("_id", "n", "component_id")
    rest = work.rows.filter("node is null or _id is null").select("_id", "n", F.col("_id").alias("component_id"))
    return found.unionByName(rest).select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each component of ``near_duplicates``.

    A row is known by its id and its text: rows that repeat an id but not the text are judged by their own texts, and all
    of them stay if nothing resembles them. Of a component the row with the smallest id stays, of several with that id
    the one whose text has the smallest hash, of equal rows one. Rows without an id stay; so do rows without a set of
    shingles, of equal ones one.
    """
    work = NearDuplicates(docs, id_col, text_col, shingle, threshold)
    labels = stored(work.labels().select(F.col("node").alias("_n"), "comp"), "labels")
    first = work.sets.join(labels, F.col("node") == F.col("_n")).groupBy("comp").agg(
        F.min(F.struct("_id", "_hash")).alias("_first")
    ).select(F.col("_first._id").alias("_id"), F.col("_first._hash").alias("_hash"))
    alone = work.rows.filter("node is null and _id is not null").select("_id", "_hash")
    again = work.rows.filter("_id is not null").groupBy("_id", "_hash").count().filter("count > 1")
    again = again.select(F.col("_id").alias("_ai"), F.col("_hash").alias("_ah"))
    kept = first.unionByName(alone).distinct().join(again, (F.col("_id") == F.col("_ai")) & (F.col("_hash") == F.col("_ah")), "left")
    name, text, key = unused(docs, "_kept", "_text_hash", "_key")
    kept = stored(kept.select(F.col("_id").alias(name), F.col("_hash").alias(text), F.col("_ai").isNotNull().alias("several")), "kept-rows")
    # a null text hashes like a number, so every row has a key; only rows that are there several times are brought together
    here = F.xxhash64(column(text_col))
    same = (column(id_col) == F.col(name)) & (here == F.col(text))
    own = docs.filter(column(id_col).isNotNull())
    once = own.join(kept.filter(~F.col("several")).drop("several"), same, "left_semi")
    several = own.join(kept.filter("several").drop("several"), same, "left_semi")
    several = several.withColumn(key, here).dropDuplicates([id_col, key]).drop(key)
    return once.unionByName(several).unionByName(docs.filter(column(id_col).isNull()))
