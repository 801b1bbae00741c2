"""Token counts of whole texts with a piece vocabulary (operator 6)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import _merge
from ._shared import chunks, coded, finder, run_sums

SPACE = "▁"
KNOWN_WORDS = 300_000


class PieceCounter:
    """Counts the pieces of texts under a BPE piece model with byte fallback.

    Pre-tokens begin at a run of spaces: no piece has a space behind another character, so no merge crosses there.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        text = {model.id_to_piece(i): i for i in ids}
        if any(SPACE in p.lstrip(SPACE) for p in text):
            raise ValueError("pieces with a space behind another character aren't supported")
        if model.normalize("  a ﬁ ") != SPACE * 3 + "a ﬁ" + SPACE:
            raise ValueError("only models that leave text as it is and add a space before it are supported")
        order = {i: r for r, i in enumerate(sorted(ids, key=lambda i: (-model.get_score(i), i)))}
        left, right, rank, merged = [], [], [], []
        for piece, i in text.items():
            for cut in range(1, len(piece)):
                a, b = text.get(piece[:cut]), text.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(order[i])
                    merged.append(i)
        self.table = _merge.PairTable(left, right, rank, merged)
        self.char = {p: i for p, i in text.items() if len(p) == 1}
        self.segments = finder(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
        self.known: dict[str, int] = {}

    def _count_segments(self, segments: list[str]) -> np.ndarray:
        """Symbols that survive the merges; an unknown character counts as its bytes."""
        flat = "".join(segments).replace(" ", SPACE)
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        distinct, back = np.unique(points, return_inverse=True)
        chars = [chr(p) for p in distinct]
        symbol = np.array([self.char.get(c, -1) for c in chars], dtype=np.int64)
        fallback = np.array([0 if c in self.char else len(c.encode("utf-8", "replace")) for c in chars], dtype=np.int64)
        size = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        _, counts = _merge.merge(symbol[back], size, self.table)
        return counts + run_sums(fallback[back] - (symbol[back] < 0), size)

    def count(self, texts: list[str]) -> np.ndarray:
        codes, distinct, counts = coded([self.segments(" " + t) if t else [] for t in texts])
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        new = [s for s in distinct if s not in self.known]
        if new:
            self.known.update(zip(new, self._count_segments(new).tolist(), strict=True))
        each = np.fromiter((self.known[s] for s in distinct), dtype=np.int64, count=len(distinct))
        return run_sums(each[codes], counts)


@lru_cache(maxsize=2)
def load(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text; a null or empty text has none of either. One pass, no shuffle.

    Ties don't arise; repeated rows give repeated rows; other columns are not read.
    """

    def run(batches):
        counter = load(path)
        for batch in batches:
            for part, texts in chunks(batch, text_col):
                n = counter.count(texts)
                size = pa.compute.binary_length(part.column(text_col)).fill_null(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(id_col), size, pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
