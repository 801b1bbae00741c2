"""Toxicity by a classifier chain (operator 3)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import chunks, coded, hashed, save, starts

#: Labelled documents that the chain is fitted on, about: beyond it a hash of the id picks as many.
TRAINING_ROWS = 8_000
FEATURES = 1 << 18
FOLDS = 3
#: The chain: a category's model also gets the probabilities of the categories before it.
CATEGORIES = ("low_quality", "toxic")
PREFIXES = (4, 5, 6)
CHUNK_CHARS = 500_000
#: Learning rate, L1 and L2 of the linear models, their passes over the sample and rows a step.
RATE, L1, L2, PASSES, STEP_ROWS = 0.5, 5.0, 0.1, 15, 100

_words = re.compile(r"[^\W\d_]+").findall


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text, one after the other, and their number per text.

    A text's features are its words in lower case (runs of letters) and their beginnings of 4, 5 and 6 letters,
    hashed to FEATURES numbers. A text without letters has none.
    """
    codes, distinct, counts = coded([_words(t.lower()) for t in texts])
    forms = [[w] + ["^" + w[:n] for n in PREFIXES if len(w) >= n] for w in distinct]
    form_codes, form_distinct, form_counts = coded(forms)
    number = (hashed(form_distinct) % np.uint64(FEATURES)).astype(np.int64)[form_codes]
    doc = np.repeat(np.arange(len(texts)), counts)
    pair = np.unique(doc * max(len(distinct), 1) + codes)
    doc, word = pair // max(len(distinct), 1), pair % max(len(distinct), 1)
    size = form_counts[word]
    at = starts(form_counts)[:-1][word]
    shift = np.repeat(at - starts(size)[:-1], size) + np.arange(int(size.sum()))
    pair = np.unique(np.repeat(doc, size) * FEATURES + number[shift])
    return pair % FEATURES, np.bincount(pair // FEATURES, minlength=len(texts))


class Linear:
    """A logistic model over sparse 0/1 features and a few dense ones, fitted by proximal steps per coordinate."""

    def __init__(self, n_dense: int):
        self.weight = np.zeros(FEATURES + n_dense + 1)

    def margin(self, index: np.ndarray, counts: np.ndarray, dense: np.ndarray) -> np.ndarray:
        total = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=self.weight[index], minlength=len(counts))
        return total + dense @ self.weight[FEATURES:-1] + self.weight[-1]

    def probability(self, index, counts, dense) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(index, counts, dense), -35, 35)))

    def fit(self, index: np.ndarray, counts: np.ndarray, dense: np.ndarray, label: np.ndarray) -> Linear:
        z, n = np.zeros_like(self.weight), np.zeros_like(self.weight)
        at, order = starts(counts), np.random.default_rng(0)
        for _ in range(PASSES):
            for rows in np.array_split(order.permutation(len(counts)), max(1, len(counts) // STEP_ROWS)):
                size = counts[rows]
                part = index[np.repeat(at[rows] - starts(size)[:-1], size) + np.arange(int(size.sum()))]
                error = self.probability(part, size, dense[rows]) - label[rows]
                used, back = np.unique(part, return_inverse=True)
                gradient = np.r_[np.bincount(back, weights=np.repeat(error, size), minlength=len(used)), error @ dense[rows], error.sum()]
                used = np.r_[used, np.arange(FEATURES, len(self.weight))]
                grown = n[used] + gradient**2
                z[used] += gradient - (np.sqrt(grown) - np.sqrt(n[used])) / RATE * self.weight[used]
                n[used] = grown
                shrunk = np.sign(z[used]) * np.maximum(np.abs(z[used]) - L1, 0)
                self.weight[used] = -shrunk / (np.sqrt(grown) / RATE + L2)
        return self


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit_chain(index: np.ndarray, counts: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int) -> list[Linear]:
    """One model per column of labels, in order.

    A later model gets the log odds of the earlier categories. For its training they come from models that were
    fitted without the row's fold, so they are as uncertain as those of new documents.
    """
    dense = np.zeros((len(counts), 0))
    models = []
    row = np.repeat(np.arange(len(counts)), counts)
    for k in range(labels.shape[1]):
        models.append(Linear(k).fit(index, counts, dense, labels[:, k]))
        if k + 1 < labels.shape[1]:
            out = np.zeros(len(counts))
            for f in range(folds):
                held = fold == f
                model = Linear(k).fit(index[~held[row]], counts[~held], dense[~held], labels[~held, k])
                out[held] = model.probability(index[held[row]], counts[held], dense[held])
            dense = np.c_[dense, logit(out)]
    return models


class Chain:
    """The fitted models; weights that are 0 are left out when it is sent to the tasks."""

    def __init__(self, categories: tuple[str, ...], sparse: list[tuple[np.ndarray, np.ndarray]]):
        self.categories, self.sparse = categories, sparse

    def models(self) -> list[Linear]:
        out = []
        for k, (at, value) in enumerate(self.sparse):
            model = Linear(k)
            model.weight[at] = value
            out.append(model)
        return out

    def learned(self) -> bool:
        """Whether the last model has any weight. Without one all its probabilities are 0.5, which tells nothing of a text."""
        return len(self.sparse[-1][0]) > 0


def train(labelled: DataFrame, categories: tuple[str, ...] = CATEGORIES, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> Chain:
    """Fits the chain in one task on the bounded rows given: an id, a text and a 0/1 column per category.

    Rows with a null label are left out. Without rows all weights are 0 and all probabilities 0.5; score() then
    calls nothing toxic.
    """

    def sparse(batches):
        for batch in batches:
            for part, texts in chunks(batch, text_col, CHUNK_CHARS):
                index, counts = features(texts)
                lists = pa.ListArray.from_arrays(pa.array(starts(counts), pa.int32()), pa.array(index, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("_order"), part.column("_fold"), lists, *(part.column(c) for c in categories)], ["_order", "_fold", "index", *categories])

    def fit(batches):
        rows = pd.concat(list(batches), ignore_index=True) if (batches := list(batches)) else None
        models = [Linear(k) for k in range(len(categories))]
        if rows is not None and len(rows):
            rows = rows.sort_values("_order", kind="stable")  # the steps don't depend on where rows were written
            index = np.concatenate([np.asarray(x, dtype=np.int64) for x in rows["index"]])
            models = fit_chain(index, rows["index"].map(len).to_numpy(), rows[list(categories)].to_numpy(dtype=float), rows["_fold"].to_numpy(), folds)
        for k, model in enumerate(models):
            at = np.flatnonzero(model.weight)
            yield pd.DataFrame({"category": k, "at": at, "value": model.weight[at]})

    rows = labelled.dropna(subset=list(categories))
    fold = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("fold")), F.lit(folds)).cast("int")
    rows = rows.select(F.xxhash64(F.col(id_col).cast("string")).alias("_order"), fold.alias("_fold"), text_col, *(F.col(c).cast("int").alias(c) for c in categories))
    rows = save(rows.mapInArrow(sparse, "_order long, _fold int, index array<int>, " + ", ".join(f"`{c}` int" for c in categories)), "toxicity-sample")
    found = rows.coalesce(1).mapInPandas(fit, "category int, at long, value double").toPandas()
    return Chain(tuple(categories), [(g["at"].to_numpy(), g["value"].to_numpy()) for k in range(len(categories)) for g in [found[found["category"] == k]]])


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, low_quality, toxic) of about `bound` labelled documents at most, picked by a hash of the id.

    An id that is labelled more than once takes its largest toxic and smallest quality, an id with several documents its
    smallest text: repeated rows don't enlarge the sample. The picked labels are broadcast: their number is bounded.
    """
    one = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("_q"), F.max("toxic").alias("_t")).where(F.col("_q").isNotNull() & F.col("_t").isNotNull())
    n = one.count()
    share = min(1.0, bound / n) if n else 1.0
    picked = one.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20)))
    picked = picked.select(id_col, (F.col("_q") == 0).cast("int").alias("low_quality"), F.col("_t").cast("int").alias("toxic"))
    found = docs.select(id_col, text_col).join(F.broadcast(picked), id_col)
    return found.groupBy(id_col, "low_quality", "toxic").agg(F.min(text_col).alias(text_col)).select(id_col, text_col, "low_quality", "toxic")


def score(docs: DataFrame, chain: Chain, threshold: float = 0.4, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns of `keep`, p_<category> ..., is_toxic): is_toxic where the last probability reaches the threshold.

    A chain whose last model learned nothing, as without usable labels, rejects nothing: is_toxic is false for all.
    A null or empty text has no features: its probabilities come from the constants alone. Repeated rows give
    repeated rows, and whole texts are used.
    """
    columns = list(dict.fromkeys([id_col, *keep]))
    names = [f"p_{c}" for c in chain.categories]
    learned = chain.learned()

    def run(batches):
        models = chain.models()
        for batch in batches:
            for part, texts in chunks(batch, text_col, CHUNK_CHARS):
                index, counts = features(texts)
                dense, out = np.zeros((len(texts), 0)), []
                for model in models:
                    out.append(model.probability(index, counts, dense))
                    dense = np.c_[dense, logit(out[-1])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *map(pa.array, out), pa.array((out[-1] >= threshold) & learned)], [*columns, *names, "is_toxic"])

    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), *(f"`{n}` double" for n in names), "is_toxic boolean"])
    return docs.select(*dict.fromkeys([*columns, text_col])).mapInArrow(run, kinds)
