"""Toxicity: logistic regression trained by FTRL-proximal over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtide.llm import words as W
from loomtide.llm.ranks import column

#: Hashed feature space; the model holds one weight per slot at most, whatever the corpus is.
BITS = 20
#: Labelled rows that a fit takes at most, spread over the rows by a hash of their id.
MAX_TRAINING_ROWS = 16_000
#: Score from which a text counts as toxic.
THRESHOLD = 0.3

_KINDS = W.mixed(np.arange(11, 14, dtype=np.uint64))


def features(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text) of every word, pair of neighbours and pair with one word between them."""
    slots, texts = [], []
    for kind, gap in enumerate((0, 1, 2)):
        first = w.hash[: max(0, len(w.hash) - gap)]
        key = first if gap == 0 else first * W.STEP + w.hash[gap:]
        own = np.ones(len(key), dtype=bool) if gap == 0 else W.inside_text(w.text, gap + 1)
        slots.append((W.mixed(key ^ _KINDS[kind]) >> np.uint64(64 - BITS)).astype(np.int64)[own])
        texts.append(w.text[: len(key)][own])
    return np.concatenate(slots), np.concatenate(texts)


def distinct_features(texts: list) -> list[np.ndarray]:
    """Distinct slots of each text."""
    out = []
    for lo, hi in W.groups(texts):
        w = W.words(texts[lo:hi])
        slot, text = features(w)
        both = np.unique((text << BITS) | slot)
        cut = np.searchsorted(both >> BITS, np.arange(w.n_texts + 1))
        low = (both & ((1 << BITS) - 1)).astype(np.int32)
        out += [low[a:b] for a, b in zip(cut[:-1], cut[1:])]
    return out


@dataclass
class Ftrl:
    """FTRL-proximal with a rate of its own for each coordinate; L1 leaves few weights that aren't zero."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 1.0

    def __post_init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.where(np.abs(z) > self.l1, z - np.sign(z) * self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, slots: np.ndarray, label: int) -> None:
        at = np.append(slots, 1 << BITS)  # the last coordinate is the intercept
        w = self.weights(at)
        gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + gradient * gradient


@dataclass
class Model:
    """Slots whose weight isn't zero, in order, their weights, and the intercept."""

    slots: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list) -> np.ndarray:
        dense = np.zeros(1 << BITS, dtype=np.float64)
        dense[self.slots] = self.weights
        out = []
        for lo, hi in W.groups(texts):
            w = W.words(texts[lo:hi])
            slot, text = features(w)
            hit = np.flatnonzero(dense[slot])
            both = np.unique((text[hit] << BITS) | slot[hit])
            total = np.bincount(both >> BITS, weights=dense[both & ((1 << BITS) - 1)], minlength=w.n_texts)
            out.append(1.0 / (1.0 + np.exp(-np.clip(total + self.intercept, -35, 35))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_rows: int = MAX_TRAINING_ROWS, passes: int = 4,
) -> Model:
    """Weights learnt from at most ``max_rows`` labelled documents, those with the smallest hash of their id.

    Only the text is an input. The sample is chosen among the labels, so it is small before it meets the documents and
    no text is moved but its own. Rows without id or label, and labels without a document, are left out; a null or
    empty text has the intercept only. A repeated id is learnt from as often as it is there, within the bound. Without
    labelled rows every weight is zero and the intercept stays at even odds. Features are made in parallel; one task
    learns from them in a fixed order, so reruns agree.
    """
    sample = labels.select(
        F.xxhash64(F.lit("order"), column(id_col)).alias("_o"), column(id_col).alias("_id"), column(label_col).cast("int").alias("_y")
    ).dropna(subset=["_id", "_y"]).orderBy("_o", "_id", "_y").limit(max_rows)
    rows = docs.select(column(id_col).alias("_did"), column(text_col).alias("_t")).join(
        F.broadcast(sample), F.col("_did") == F.col("_id")
    ).withColumn("_p", F.xxhash64("_t"))

    @F.pandas_udf("array<int>")
    def slots_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(distinct_features(texts.tolist()))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        model = Ftrl()
        if frames:
            # a repeated row may be there more often than the bound says: at most max_rows are used
            every = pd.concat(frames).sort_values(["_o", "_p", "_y"], kind="stable").head(max_rows)
            for _ in range(passes):
                for slots, label in zip(every["_s"], every["_y"]):
                    model.learn(slots, label)
        at = np.arange((1 << BITS) + 1)
        w = model.weights(at)
        keep = np.flatnonzero(w)
        yield pd.DataFrame({"slot": keep, "weight": w[keep]})

    sample = rows.select("_o", "_p", "_y", slots_of("_t").alias("_s")).repartition(1)
    found = sample.mapInPandas(learn, "slot long, weight double").orderBy("slot").toPandas()
    is_bias = found["slot"] == 1 << BITS
    rest = found[~is_bias]
    return Model(
        rest["slot"].to_numpy(np.int64), rest["weight"].to_numpy(np.float64), float(found.loc[is_bias, "weight"].sum())
    )


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic) of the whole text and ``predicted`` (1 at the threshold or above).

    A null or empty text gets the score of the intercept. Other columns are kept; ``score`` and ``predicted`` are
    replaced.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts.tolist()))

    return docs.withColumn("score", scored(column(text_col))).withColumn(
        "predicted", (F.col("score") >= F.lit(threshold)).cast("int")
    )
