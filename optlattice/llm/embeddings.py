"""Near-duplicate vectors by a subspace pigeonhole join (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ._shared import forget, save
from .components import components

#: Dimensions of a block; vectors of a tile at most, and their bytes; tiles of a file.
BLOCK_DIMS, TILE, TILE_BYTES, FILE_TILES = 16, 4096, 4 << 20, 16
#: Rows of a tile, and of the other one, that are compared at a time: their distances stay in a core's cache.
STRIP, COLUMNS = 256, 512
#: What rounding may add to squared distances that are computed in single precision.
SLACK = 1e-5
#: Links that a task holds until it ties them, and rows that it returns at a time.
HELD, RETURNED = 1 << 20, 100_000


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random rotation: it spreads a difference between two vectors evenly over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int) -> list[slice]:
    edges = np.linspace(0, dim, max(1, -(-dim // BLOCK_DIMS)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def budgets(dim: int, threshold: float) -> list[float]:
    """Each block's share of the largest squared distance of linked unit vectors, 2 - 2 * threshold, by its dimensions.

    Some block of every linked pair keeps within its budget, or the sum would be larger.
    """
    return [(2 - 2 * threshold) * (b.stop - b.start) / dim for b in blocks_of(dim)]


def _unit(x: np.ndarray) -> np.ndarray:
    """Each row at length 1, with the same bits wherever it stands; not finite if it holds what isn't, or only zeros."""
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(axis=1)[:, None]  # neither overflows nor vanishes when squared
        return x / np.linalg.norm(x, axis=1)[:, None] + 0.0  # -0.0 is 0.0


def _kind(vectors: DataFrame, vector_col: str) -> str:
    """Numpy's name of the components' type: floats stay floats, all others are doubles."""
    return "<f4" if isinstance(getattr(vectors.schema[vector_col].dataType, "elementType", None), FloatType) else "<f8"


def _keyed(vectors: DataFrame, id_col: str, vector_col: str, whole: bool = False) -> DataFrame:
    """(id, key) of every row, with `whole` (id, key, vec): vec is its vector as it stands, as bytes.

    The key is a digest of the vector at length 1, so that vectors of one direction share it; null where the vector can't be used.
    """
    kind = _kind(vectors, vector_col)

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            size = np.asarray(pa.compute.list_value_length(lists).fill_null(0), dtype=np.int64)
            flat = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
            begin = np.r_[0, np.cumsum(size)][:-1]
            key, vec = np.full(len(size), None, dtype=object), np.full(len(size), None, dtype=object)
            for dim in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == dim)
                x = flat[begin[rows][:, None] + np.arange(dim)]
                unit = _unit(x)
                good = np.isfinite(unit).all(axis=1)
                key[rows[good]] = [hashlib.blake2b(v, digest_size=16).digest() for v in unit[good]]
                if whole:
                    vec[rows[good]] = [v.tobytes() for v in x[good].astype(kind)]
            out = {"id": batch.column("id"), "key": pa.array(key, pa.binary())} | ({"vec": pa.array(vec, pa.binary())} if whole else {})
            yield pa.RecordBatch.from_pydict(out)

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(run, "id long, key binary" + (", vec binary" if whole else ""))


def _tiles(same: DataFrame, kind: str) -> DataFrame:
    """(tile, dim, reps, w, vecs): every vector in one tile, a row of up to TILE vectors of one dimension that lie together."""

    def run(batches):
        held: dict[int, list[pa.RecordBatch]] = {}

        def cut(size: int, all_rows: bool):
            most = min(TILE, max(1, TILE_BYTES // size))
            if all_rows or sum(b.num_rows for b in held[size]) >= most:
                rows = pa.Table.from_batches(held[size]).combine_chunks()
                end = rows.num_rows if all_rows else rows.num_rows // most * most
                for k in range(0, end, most):
                    part = rows.slice(k, min(most, end - k))
                    numbers = [pa.array([np.asarray(part.column(c)).astype("<i8").tobytes()], pa.binary()) for c in ("rep", "w")]
                    vecs = pa.array([b"".join(part.column("vec").to_pylist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([size // np.dtype(kind).itemsize], pa.int32()), *numbers, vecs], ["dim", "reps", "w", "vecs"])
                held[size] = rows.slice(end).to_batches()

        for batch in batches:
            sizes = np.asarray(pa.compute.binary_length(batch.column("vec")))
            for size in np.unique(sizes).tolist():
                held.setdefault(size, []).append(batch.filter(pa.array(sizes == size)))
                yield from cut(size, False)
        for size in held:
            yield from cut(size, True)

    return same.select("rep", "w", "vec").mapInArrow(run, "dim int, reps binary, w binary, vecs binary").withColumn("tile", F.monotonically_increasing_id())


class _Tile:
    """A tile's vectors at length 1 and, for each block, their order by the first coordinate and what distances are products of."""

    def __init__(self, vecs: bytes, dim: int, kind: str):
        self.x = _unit(np.frombuffer(vecs, kind).reshape(-1, dim).astype(np.float64))
        turned, self.blocks = (self.x @ rotation(dim)).astype(np.float32), []
        for b in blocks_of(dim):
            order = np.argsort(turned[:, b.start])
            low = turned[order, b]
            norm, one = (low.astype(np.float64) ** 2).sum(axis=1).astype(np.float32)[:, None], np.ones((len(low), 1), dtype=np.float32)
            self.blocks.append((order, low[:, 0].copy(), np.hstack([-2 * low, norm, one]), np.ascontiguousarray(np.hstack([low, one, norm]).T)))


def _places(mask: np.ndarray) -> np.ndarray:
    """Where a mask without many true values has them, as places of the flat mask; eight values are looked at together."""
    flat = mask.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    at = (8 * np.flatnonzero(flat.view(np.uint64) != 0)[:, None] + np.arange(8)).ravel()
    return at[flat[at]]


def compare(left: _Tile, right: _Tile, dim: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of linked vectors of two tiles, or of one with itself (then i < j), each pair once.

    In every block strips of one tile are compared with the range of the other one that can be within the budget. The
    cosine of pairs within the budget of any block is computed in double precision.
    """
    same = left is right
    near = np.zeros((len(left.x), len(right.x)), dtype=bool)
    for (order, lead, rows, _), (other, its_lead, _, columns), budget in zip(left.blocks, right.blocks, budgets(dim, threshold), strict=True):
        limit = np.float32(budget + SLACK)  # a double would make doubles of all distances
        for k in range(0, len(rows), STRIP):
            strip = rows[k : k + STRIP]
            begin = max(int(np.searchsorted(its_lead, lead[k] - np.sqrt(limit))), k if same else 0)
            end = int(np.searchsorted(its_lead, lead[k + len(strip) - 1] + np.sqrt(limit), "right"))
            for c in range(begin, end, COLUMNS):
                distance = strip @ columns[:, c : min(end, c + COLUMNS)]
                at = _places(distance <= limit)
                if len(at):
                    i, j = np.divmod(at, distance.shape[1])
                    i, j = order[k + i], other[c + j]
                    if same:
                        i, j = np.minimum(i, j), np.maximum(i, j)
                    near[i, j] = True
    if same:
        np.fill_diagonal(near, False)
    for k in range(0, len(near), STRIP):
        strip = near[k : k + STRIP]
        at = _places(strip)
        if len(at) > strip.size // 16:
            at = at[(left.x[k : k + STRIP] @ right.x.T).ravel()[at] >= threshold]
            i, j = np.divmod(at, strip.shape[1])
            yield k + i, j
            continue
        for p in range(0, len(at), 20_000):
            i, j = np.divmod(at[p : p + 20_000], strip.shape[1])
            found = (left.x[k + i] * right.x[j]).sum(axis=1) >= threshold
            yield k + i[found], j[found]


def _tie(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the components of each u and v; root holds the least place of every place's component."""
    while len(u):
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root[:] = root[root]


class _Links:
    """What a task keeps of its links: each vector's linked weight, and a tree of each component of its vectors."""

    def __init__(self):
        self.begin: dict[int, int] = {}
        self.reps, self.weight, self.linked, self.root = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def place(self, tile: int, reps: bytes, w: bytes) -> int:
        """Where the tile's vectors begin among those of the task."""
        if tile not in self.begin:
            n = self.begin[tile] = len(self.reps)
            self.reps, self.weight = np.r_[self.reps, np.frombuffer(reps, "<i8")], np.r_[self.weight, np.frombuffer(w, "<i8")]
            self.linked = np.r_[self.linked, np.zeros(len(self.reps) - n, dtype=np.int64)]
            self.root = np.r_[self.root, np.arange(n, len(self.reps))]
        return self.begin[tile]

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        for a, b in ((u, v), (v, u)):
            if len(a):
                least = a.min()
                more = np.bincount(a - least, weights=self.weight[b]).astype(np.int64)
                self.linked[least : least + len(more)] += more
        self.held.append((u, v))
        if sum(len(a) for a, _ in self.held) >= HELD:
            self.tie()

    def tie(self) -> None:
        if self.held:
            _tie(self.root, *(np.concatenate(x) for x in zip(*self.held, strict=True)))
            self.held = []

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(a, b, n): vector a's linked weight n, with b = -1; and, with n = 0, an edge (a, b) of a tree."""
        self.tie()
        some, far = np.flatnonzero(self.linked), np.flatnonzero(self.root != np.arange(len(self.root)))
        a, b = self.reps[np.r_[some, far]], np.r_[np.full(len(some), -1), self.reps[self.root[far]]]
        out = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.r_[self.linked[some], np.zeros(len(far), dtype=np.int64)])], ["a", "b", "n"])
        for k in range(0, len(a), RETURNED):
            yield out.slice(k, RETURNED)


def _linked(tiles: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Each pair of tiles meets once: (a, b, n) as of _Links.rows, from each task that compares some of them.

    Tasks read the pairs of the saved table's partitions; no copy of a vector is shuffled. Of both orders of a pair the
    sum of the tiles' numbers chooses one, which shares the pairs out evenly.
    """

    def run(batches):
        links, last = _Links(), (None, None)
        for batch in batches:
            for r in batch.to_pylist():
                dim, u, v = r["dim_a"], links.place(r["tile_a"], r["reps_a"], r["w_a"]), links.place(r["tile_b"], r["reps_b"], r["w_b"])
                if last[0] != r["tile_a"]:
                    last = r["tile_a"], _Tile(r["vecs_a"], dim, kind)
                left = last[1]
                for i, j in compare(left, left if u == v else _Tile(r["vecs_b"], dim, kind), dim, threshold):
                    links.add(u + i, v + j)
        yield from links.rows()

    a, b = (tiles.toDF(*(f"{c}_{side}" for c in tiles.columns)) for side in "ab")
    below, even = F.col("tile_a") < F.col("tile_b"), (F.col("tile_a") + F.col("tile_b")) % 2 == 0
    once = (F.col("dim_a") == F.col("dim_b")) & ((F.col("tile_a") == F.col("tile_b")) | (below == even))
    return a.hint("shuffle_replicate_nl").join(b, once).mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept): vectors with cosine >= threshold are linked; all such pairs are found.

    n_links counts the other vectors that are linked directly, component_id is the smallest id reachable by
    links, kept tells if it is the vector's own. A vector that is null, empty, zero or holds a null or
    non-finite component is linked with nothing, as are vectors of different dimensions. Ids are integers. Rows that share
    an id are vectors of their own where they differ, and one vector where they are equal: a repeat isn't another vector,
    and has the same figures. A row with a null id is linked with nothing and has a null component and kept = false. An
    empty table gives no rows.

    Distinct vectors are numbered representatives with a weight, the number of their ids. Pairs are never emitted, only
    their numbers and enough edges to connect them. Each vector is written a few times, whatever the table's size.
    """
    kind = _kind(vectors, vector_col)
    keys = save(_keyed(vectors, id_col, vector_col), "embeddings-keys")
    usable = "id is not null and key is not null"
    counts = keys.where(usable).distinct().groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("w"))
    one = _keyed(vectors, id_col, vector_col, whole=True).where(usable).groupBy("key").agg(F.first("vec").alias("vec"))
    same = save(counts.join(one, "key").withColumn("rep", F.monotonically_increasing_id()), "embeddings-distinct")  # numbers hold once they are written
    tiles = save(_tiles(same, kind), "embeddings-tiles", file_rows=FILE_TILES)
    found = save(_linked(tiles, kind, threshold), "embeddings-links", batch_rows=1)
    forget(tiles)
    links = save(found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n")), "embeddings-counts")
    labels = save(components(found.where("n = 0")), "embeddings-labels")
    forget(found)
    per_rep = same.select("key", "rep", "w", "first").join(links, "rep", "left").join(labels, F.col("rep") == labels["id"], "left").withColumn("group", F.coalesce("component", "rep"))
    least = per_rep.groupBy("group").agg(F.min("first").alias("least"))
    per_rep = per_rep.join(least, "group").select("key", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), "least")
    rows = keys.join(per_rep, "key", "left")
    named = F.col("id").isNotNull()
    component = F.when(named, F.coalesce("least", "id"))
    return rows.select(F.col("id").alias(id_col), F.when(named, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
