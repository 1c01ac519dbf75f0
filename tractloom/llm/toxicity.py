"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each has a logistic model over hashed words and the probabilities of
the categories before it. For training these probabilities are out of fold: every labelled document gets them from
models that have not seen it, so later models learn from probabilities as uncertain as those they will meet.

The models are fitted on the driver with numpy from at most `MAX_ROWS` labelled rows, the smallest by a hash of their
id; features are counted in the tasks and only hashed counts travel. Scoring covers every document whole, in batches.

Nulls and odd input: null texts have no words and get the models' base rates; labels that are null count as 0;
labelled ids without a document are ignored, those with several documents teach each of them; without labelled rows
every probability is 0; repeated rows score alike; empty tables stay empty. Texts of any length are read whole, within
their own row. A probability at the threshold is toxic. Result columns replace input columns of the same name; all
others pass through, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractloom.llm.common import col, unpacked, whole

#: Labelled rows used for fitting, at most.
MAX_ROWS = 20_000
FEATURES = 1 << 18
#: Words whose share among positive rows is this many standard errors from that among negative ones count.
TELLING = 4.0
FOLDS = 5
EPOCHS = 12
RATE = 0.5
DECAY = 1e-6
SEED = 7
THRESHOLD = 0.5


def hashed_words(text: bytes | None) -> np.ndarray:
    """Hashes of the distinct words, ASCII case and punctuation at their edges aside."""
    words = {w.strip(b".,;:!?\"'()") for w in text.lower().split()} if text else set()
    words.discard(b"")
    return np.fromiter({zlib.crc32(w) % FEATURES for w in words}, np.int64)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _features(text: pd.Series) -> pd.Series:
    return pd.Series([np.sort(hashed_words(t)).astype(np.int32) for t in text])


def features(text: Column) -> Column:
    return _features(F.coalesce(text, F.lit("")).cast("binary"))


@dataclass
class Linear:
    """A logistic model: a bias, a weight for each feature, and one for each earlier category."""

    bias: float
    weights: np.ndarray
    earlier: np.ndarray

    def scores(self, rows: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        sums = np.array([self.weights[r].sum() for r in rows]) if rows else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.bias + sums + before @ self.earlier, -30, 30)))


def telling(rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Which features occur in positive and negative rows at rates that chance does not explain."""
    many, few = (
        np.bincount(np.concatenate([r for r, t in zip(rows, target, strict=True) if t == y]), minlength=FEATURES)
        for y in (0, 1)
    )
    n0, n1 = (target == 0).sum(), (target == 1).sum()
    share = (many + few) / (n0 + n1)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n0 + 1 / n1))
    return np.abs(few / n1 - many / n0) >= TELLING * error


def fit(rows: list[np.ndarray], before: np.ndarray, target: np.ndarray) -> Linear:
    """Adagrad on the log loss over the telling features, a fixed order of the rows in every epoch."""
    rate = np.clip(target.mean() if len(target) else 0, 1e-4, 1 - 1e-4)
    model = Linear(float(np.log(rate / (1 - rate))), np.zeros(FEATURES), np.zeros(before.shape[1]))
    if not len(rows) or target.min() == target.max():
        return model
    kept = telling(rows, target)
    rows = [r[kept[r]] for r in rows]
    seen, seen_bias, seen_before = np.full(FEATURES, 1e-3), 1e-3, np.full(before.shape[1], 1e-3)
    order = np.random.default_rng(SEED)
    sizes = np.array([len(r) for r in rows])
    for _ in range(EPOCHS):
        shuffled = order.permutation(len(rows))
        for at in range(0, len(rows), 64):
            batch = shuffled[at : at + 64]
            error = model.scores([rows[i] for i in batch], before[batch]) - target[batch]
            slots = np.concatenate([rows[i] for i in batch])
            per_word = np.repeat(error, sizes[batch])
            used, where = np.unique(slots, return_inverse=True)
            slope = np.bincount(where, per_word, len(used)) + DECAY * model.weights[used]
            seen[used] += slope**2
            model.weights[used] -= RATE * slope / np.sqrt(seen[used])
            seen_bias += error.sum() ** 2
            model.bias -= RATE * error.sum() / np.sqrt(seen_bias)
            slope = error @ before[batch]
            seen_before += slope**2
            model.earlier -= RATE * slope / np.sqrt(seen_before)
    return model


def fit_chain(rows: list[np.ndarray], targets: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """One model for each column of `targets`; what later ones see of earlier ones is predicted out of fold."""
    n, categories = targets.shape
    before = np.zeros((n, 0))
    chain = []
    for c in range(categories):
        chain.append(fit(rows, before, targets[:, c]))
        if c + 1 == categories:
            break
        out = np.zeros(n)
        for fold in range(FOLDS):
            inside, outside = np.flatnonzero(folds == fold), np.flatnonzero(folds != fold)
            model = fit([rows[i] for i in outside], before[outside], targets[outside, c])
            out[inside] = model.scores([rows[i] for i in inside], before[inside])
        before = np.column_stack([before, out])
    return chain


def chain_scores(chain: list[Linear], rows: list[np.ndarray]) -> np.ndarray:
    before = np.zeros((len(rows), 0))
    for model in chain:
        before = np.column_stack([before, model.scores(rows, before)])
    return before


def fitted_chain(
    docs: DataFrame, labels: DataFrame, categories: list[Column], text: str, doc_id: str, max_rows: int = MAX_ROWS
) -> list[Linear]:
    """The chain for these 0/1 categories, fitted on labelled documents."""
    key = F.pmod(F.xxhash64(col(doc_id)), F.lit(1 << 40))
    marks = labels.select(
        col(doc_id).alias("id"), F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in categories]).alias("y"),
        key.alias("k"),
    )
    few = marks.filter("id IS NOT NULL").orderBy("k", "id", "y").limit(max_rows)
    texts = docs.select(col(doc_id).alias("id"), col(text).alias("t"))
    # At most max_rows labels, so they may be copied to the tasks.
    chosen = texts.join(F.broadcast(few), "id").select("id", "k", "y", features(F.col("t")).alias("x"))
    got = chosen.orderBy("k", "id", "y", "x").limit(max_rows).toArrow().combine_chunks()
    if not got.num_rows:
        return [Linear(-30.0, np.zeros(FEATURES), np.zeros(c)) for c in range(len(categories))]
    x = got["x"].chunk(0)
    ends = x.offsets.to_numpy()
    rows = np.split(x.values.to_numpy().astype(np.int64), ends[1:-1])
    folds = got["k"].to_numpy() % FOLDS
    targets = np.array(got["y"].to_pylist(), float)
    return fit_chain(rows, targets, folds)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    text: str = "text",
    doc_id: str = "doc_id",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """All columns, a probability for each category (p_<name>), in the order of the chain, and `toxic`.

    `toxic`: the last category's probability is at least 0.5. Result columns replace input columns of the same name.
    """
    names = list(categories)
    chain = fitted_chain(docs, labels, list(categories.values()), text, doc_id, max_rows)
    # A fixed number of models of a fixed size, as plain arrays.
    shared = docs.sparkSession.sparkContext.broadcast([(m.bias, m.weights, m.earlier) for m in chain])

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(list(chain_scores([Linear(*m) for m in shared.value], [hashed_words(t) for t in texts])))

    scored = docs.select(whole(docs).alias("d"), score(F.coalesce(col(text), F.lit("")).cast("binary")).alias("p"))
    added = [f"p_{n}" for n in names]
    shown = scored.select("d", *[F.col("p")[i].alias(a) for i, a in enumerate(added)])
    return unpacked(shown.withColumn("toxic", F.col(added[-1]) >= THRESHOLD), "d", docs.columns, [*added, "toxic"])
