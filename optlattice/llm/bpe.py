"""BPE encoding and decoding of whole texts (operator 1)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import _merge
from ._shared import WHITE_SPACE, Remembered, chunks, coded, finder, ragged_take, run_sums, starts

#: The pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a task remembers.
KNOWN_WORDS = 150_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Bpe:
    """A byte-level vocabulary: encodes texts to ids and decodes ids to texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.byte_id = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.table = _merge.PairTable([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), [vocab[a + b] for a, b in merges])
        to_byte = {c: b for b, c in enumerate(alphabet)}
        content = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        ordered = [content.get(i, b"") for i in range(max(content) + 1)]
        self.token_bytes = np.frombuffer(b"".join(ordered), dtype=np.uint8)
        self.token_size = np.array([len(x) for x in ordered], dtype=np.int64)
        self.token_start = starts(self.token_size)[:-1]
        self.split = regex.compile(PATTERN).findall
        self.segments = finder(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.known = Remembered(self._encode_segments, KNOWN_WORDS)

    def _encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each segment: its parts between special tokens are split by the pattern and merged."""
        parts, special, owner = [], [], []
        for i, s in enumerate(segments):
            for p in self.special_split(s) if self.special_split else [s]:
                if p in self.special:
                    parts.append(b"")
                    special.append(self.special[p])
                    owner.append(i)
                elif p:
                    found = self.split(p)
                    parts += [x.encode("utf-8", "replace") for x in found]
                    special += [-1] * len(found)
                    owner += [i] * len(found)
        special, owner = np.array(special, dtype=np.int64), np.array(owner, dtype=np.int64)
        counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        flat = self.byte_id[np.frombuffer(b"".join(parts), dtype=np.uint8)]
        flat, counts = _merge.merge(flat, counts, self.table)
        alone = special >= 0
        if alone.any():
            flat = np.insert(flat, starts(counts)[:-1][alone], special[alone])
            counts = counts + alone
        return flat, np.bincount(owner, weights=counts, minlength=len(segments)).astype(np.int64)

    def _segments_of(self, text: str) -> list[str]:
        found = self.segments(text)
        if self.special and any(s in text for s in self.special):
            # the text on either side of a special token is split on its own
            found = [x for p in self.special_split(text) if p for x in ([p] if p in self.special else self.segments(p))]
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of each text's ids."""
        codes, distinct, counts = coded([self._segments_of(t) for t in texts])
        flat, begin, size = self.known.get(distinct)
        return ragged_take(flat, begin[codes], size[codes]), run_sums(size[codes], counts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that aren't UTF-8 become U+FFFD, unknown ids become nothing."""
        ids = np.where((ids >= 0) & (ids < len(self.token_size)), ids, -1)
        size = np.where(ids >= 0, self.token_size[ids], 0)
        out = ragged_take(self.token_bytes, self.token_start[ids], size).tobytes()
        at = starts(run_sums(size, counts))
        return [out[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text; a null or empty text has none. Rows, repeated ones too, map one to one."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for part, texts in chunks(batch, text_col):
                ids, counts = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays([part.column(id_col), _lists(ids, counts)], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids); null ids give an empty text."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            ids, counts = _flat(batch.column(ids_col))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(bpe.decode(ids, counts), pa.string())], [id_col, "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): both directions on every whole text, in one pass over the input.

    A null or empty text has no tokens and decodes to the empty text. Ties don't arise; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        shown = [b"%d," % i for i in range(len(bpe.token_size))]
        shown_size = np.fromiter(map(len, shown), dtype=np.int64)
        shown_flat, shown_start = np.frombuffer(b"".join(shown), dtype=np.uint8), starts(shown_size)[:-1]
        for batch in batches:
            for part, texts in chunks(batch, text_col):
                ids, counts = bpe.encode(texts)
                line = ragged_take(shown_flat, shown_start[ids], shown_size[ids]).tobytes()
                at = starts(run_sums(shown_size[ids], counts))
                sha = [hashlib.sha256(line[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                back = [hashlib.sha256(t.encode()).hexdigest() for t in bpe.decode(ids, counts)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(counts), pa.array(sha), pa.array(back)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts(counts), pa.int32()), pa.array(flat, pa.int32()))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    counts = np.asarray(pa.compute.list_value_length(lists).fill_null(0), dtype=np.int64)
    return np.asarray(lists.flatten().fill_null(-1), dtype=np.int64), counts
