"""Language identification with hyperdimensional profiles (operator 4)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import chunks

#: Length of the random vectors, and of n-grams.
DIMENSIONS = 1024
ORDER = 3
#: Letter classes: 0 stands for all that isn't a letter; a to z have their own, other letters share the rest.
CLASSES = 64
#: Documents, and characters, whose vectors are computed together.
BLOCK_DOCS = 256
CHUNK_CHARS = 500_000
#: N-gram vectors that a task remembers.
REMEMBERED = 16_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_vectors(seed: int = 7) -> np.ndarray:
    """A random vector of +1 and -1 for each letter class, permuted (rotated) for each place of an n-gram."""
    base = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(CLASSES, DIMENSIONS))
    return np.stack([np.roll(base, ORDER - 1 - place, axis=1) for place in range(ORDER)])


@lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """The class of each code point of the Basic Multilingual Plane; letters beyond it are looked up one by one."""
    return np.fromiter((_class(chr(p)) if not 0xD800 <= p <= 0xDFFF else 0 for p in range(0x10000)), dtype=np.int64, count=0x10000)


def _class(char: str) -> int:
    if not char.isalpha():
        return 0
    low = char.lower()[0]
    if "a" <= low <= "z":
        return 1 + ord(low) - ord("a")
    return 27 + ord(low) * 2654435761 % (1 << 32) % (CLASSES - 27)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text number and the code of every n-gram of letter classes, and the letters of each text.

    A run of other characters counts as one boundary, and so do the ends of a text; n-grams with a boundary in
    the middle are left out.
    """
    joined = "".join(t + "\n" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    classes = letter_classes()[np.minimum(points, 0xFFFF)]
    for p in np.unique(points[points > 0xFFFF]):
        classes[points == p] = _class(chr(p))
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    letters = np.bincount(owner[classes > 0], minlength=len(texts))
    first = np.r_[True, classes[1:] != 0] | np.r_[True, classes[:-1] != 0]
    classes, owner = np.r_[0, classes[first], 0], np.r_[-1, owner[first], -1]
    code = (classes[:-2] * CLASSES + classes[1:-1]) * CLASSES + classes[2:]
    middle = classes[1:-1] > 0
    return owner[1:-1][middle], code[middle], letters


def vectors_of(codes: np.ndarray) -> np.ndarray:
    """The n-gram vectors: the product (binding) of the permuted vectors of the letters."""
    place = letter_vectors()
    out = place[0][codes // CLASSES**2].copy()
    out *= place[1][codes // CLASSES % CLASSES]
    out *= place[2][codes % CLASSES]
    return out


class Memory:
    """N-gram vectors that a task has computed before, one byte a place."""

    def __init__(self) -> None:
        self.row = np.full(CLASSES**ORDER, -1, dtype=np.int32)
        self.known = np.zeros((0, DIMENSIONS), dtype=np.int8)

    def get(self, codes: np.ndarray) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.__init__()
        new = codes[self.row[codes] < 0]
        if len(new):
            self.row[new] = len(self.known) + np.arange(len(new))
            self.known = np.concatenate([self.known, vectors_of(new)])
        return self.known[self.row[codes]].astype(np.float32)


def bundle(texts: list[str], memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """The sum of each text's n-gram vectors, and each text's letters."""
    owner, code, letters = ngrams(texts)
    seen, back = np.unique(code, return_inverse=True)
    counts = np.bincount(owner * len(seen) + back, minlength=len(texts) * len(seen)).reshape(len(texts), len(seen)) if len(seen) else np.zeros((len(texts), 0))
    return counts.astype(np.float32) @ memory.get(seen), letters


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, list[float]]]:
    """The prototype of each language: the bundle of all n-grams of all its texts, as (lang, vector).

    Tasks count n-grams per language; only these counts are shuffled, and one vector per language is returned.
    Rows with a null language or text are left out; no rows give no prototypes.
    """

    def count(batches):
        for batch in batches:
            for part, texts in chunks(batch, text_col, CHUNK_CHARS):
                langs = pd.factorize(np.array(part.column(lang_col).to_pylist(), dtype=object))
                owner, code, _ = ngrams(texts)
                key, n = np.unique(langs[0][owner] * CLASSES**ORDER + code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs[1][key // CLASSES**ORDER], pa.string()), pa.array(key % CLASSES**ORDER, pa.int32()), pa.array(n)], ["lang", "code", "n"])

    def prototype(key, rows):
        total = np.zeros(DIMENSIONS)
        for i in range(0, len(rows), 4096):
            part = rows.iloc[i : i + 4096]
            total += part["n"].to_numpy(dtype=float) @ vectors_of(part["code"].to_numpy(dtype=np.int64)).astype(float)
        return pd.DataFrame({"lang": [key[0]], "vector": [total.tolist()]})

    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col), F.col(lang_col))
    counts = known.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").applyInPandas(prototype, "lang string, vector array<double>").collect()
    return sorted((r["lang"], list(r["vector"])) for r in rows)


def predict(docs: DataFrame, prototypes: list[tuple[str, list[float]]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, has_letters, columns of `keep`): the language whose prototype has the largest cosine with the text's vector.

    The score is that cosine (negative ones: 0). A text that is null, empty or without a letter, or any text when no
    prototype was learned, is `und` with score 0. Equal cosines: the first language by name. Whole texts are
    used; repeated rows give repeated rows.
    """
    names = [n for n, _ in prototypes]
    matrix = np.array([v for _, v in prototypes], dtype=np.float64).reshape(len(names), DIMENSIONS)
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = (matrix / np.where(norm > 0, norm, 1)).astype(np.float32)
    columns = [id_col, *keep]

    def run(batches):
        memory = Memory()
        for batch in batches:
            for part, texts in chunks(batch, text_col, CHUNK_CHARS):
                best, score, letters = [], [], []
                for i in range(0, len(texts), BLOCK_DOCS):
                    vectors, n = bundle(texts[i : i + BLOCK_DOCS], memory)
                    size = np.linalg.norm(vectors.astype(np.float64), axis=1)
                    cosine = vectors @ matrix.T / np.where(size > 0, size, 1)[:, None] if names else np.zeros((len(vectors), 1))
                    best.append(cosine.argmax(axis=1))
                    score.append(cosine.max(axis=1))
                    letters.append(n)
                best, score, letters = (np.concatenate(x) for x in (best, score, letters))
                known = (letters > 0) & bool(names)
                lang = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = np.where(known, np.clip(score, 0, 1), 0.0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(lang, pa.string()), pa.array(score), pa.array(letters > 0)], [*columns, "lang_pred", "score", "has_letters"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*dict.fromkeys([*columns, text_col])).mapInArrow(run, f"{kinds}, lang_pred string, score double, has_letters boolean")


def identify(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Learns from the rows that fulfil `training` and predicts all rows."""
    return predict(docs, train(docs.where(training), text_col, lang_col), id_col, text_col, keep)
