"""Vectors are sent and written a bounded number of times, whatever the number of tiles; tiles are compared whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from optlattice.llm import embeddings


def written(spark, begin=0):
    """The newest stage, and the bytes that the stages from begin on shuffled and wrote."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    stages = [found.apply(i) for i in range(found.size())]
    return max((s.stageId() for s in stages), default=0), sum(s.shuffleWriteBytes() + s.outputBytes() for s in stages if s.stageId() >= begin)


def test_no_vector_is_sent_to_every_tile(spark, monkeypatch):
    """Each of 1,000 vectors of 256 bytes was sent to some 60 tiles in each of two blocks."""
    monkeypatch.setattr(embeddings, "TILE", 16)
    x = np.random.default_rng(5).normal(size=(1000, 32))
    x[500:510] = x[:10] + 0.1 * x[600:610]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").cache()
    assert d.count() == 1000
    begin, _ = written(spark)
    got = {r.vec_id: r for r in embeddings.near_duplicates(d).collect()}
    assert 0 < written(spark, begin + 1)[1] < 1000 * 256 * 8
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert [got[i].n_links for i in range(1000)] == want.tolist() and want.sum() >= 20
    assert got[503].component_id == 3 and not got[503].kept


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_tiles_are_compared_whole(monkeypatch, spread):
    """With large and small groups of near copies, in one tile and between two; the products of whole strips and of single pairs."""
    monkeypatch.setattr(embeddings, "STRIP", 7)
    monkeypatch.setattr(embeddings, "COLUMNS", 11)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3, 40))[rng.integers(0, 3, 130)] + spread * rng.normal(size=(130, 40))
    a, b = (embeddings._Tile(v.astype("<f4").tobytes(), 40, "<f4") for v in (x[:60], x[60:]))
    for left, right in ((a, b), (a, a)):
        pairs = [(int(i), int(j)) for u, v in embeddings.compare(left, right, 40, 0.9) for i, j in zip(u, v, strict=True)]
        want = {(int(i), int(j)) for i, j in np.argwhere(left.x @ right.x.T >= 0.9) if left is not right or i < j}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 50


def test_equal_vectors_have_equal_keys_in_any_batch(spark):
    x = np.random.default_rng(7).normal(size=(50, 100))
    assert all((embeddings._unit(x)[k] == embeddings._unit(x[k : k + 1])[0]).all() for k in range(50))
    d = spark.createDataFrame([(i, v) for i, v in enumerate([*x.tolist(), x[0].tolist(), (2 * x[0]).tolist()])], "vec_id long, embedding array<double>")
    alone = embeddings._keyed(d.repartition(52, "vec_id"), "vec_id", "embedding").withColumnRenamed("key", "alone")
    both = embeddings._keyed(d.coalesce(1), "vec_id", "embedding").join(alone, "id")
    assert both.where("key = alone").count() == 52 and both.select(F.countDistinct("key")).first()[0] == 50
