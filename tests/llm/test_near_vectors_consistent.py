"""Links and components of near vectors follow from one set of pairs, also over several regions and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitwise.llm import near_vectors as N


def vectors(n, centres, width, noise, seed):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, width))
    x = c[rng.integers(0, centres, n)] + rng.normal(size=(n, width)) * noise
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), "x", 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, node string, m int")


def checked(rows, x, threshold=0.95):
    """Recall of directed links; every contradiction fails."""
    n, by_id = len(x), {r["vec_id"]: r for r in rows}
    assert len(rows) == len(by_id) == n
    true = x @ x.T >= threshold - 1e-12
    np.fill_diagonal(true, False)
    links = np.array([by_id[i]["n_links"] for i in range(n)])
    component = np.array([by_id[i]["component_id"] for i in range(n)])
    size = np.bincount(component, minlength=n)[component]
    assert ((links == 0) == (size == 1)).all()
    assert links.sum() % 2 == 0 and (links <= true.sum(1)).all() and (component <= np.arange(n)).all()
    assert all(by_id[i]["kept"] == (component[i] == i) for i in range(n))
    label = np.arange(n)
    for i in range(n):  # components of brute force hold those found
        seen = np.flatnonzero(true[i])
        if len(seen):
            old = np.unique(np.append(label[seen], label[i]))
            label[np.isin(label, old)] = old[0]
    assert (label[component] == label).all()
    return links.sum() / max(1, true.sum())


@pytest.mark.parametrize("least_recall", [0.95, 0.0])
def test_several_regions_and_blocks(spark, least_recall):
    x = vectors(1200, 40, 16, 0.055, 1)
    rows = N.classes(frame(spark, x), shard_rows=100, region_rows=300 if least_recall else 150, block_rows=100, least_recall=least_recall).collect()
    recall = checked(rows, x)
    assert recall >= (0.94 if least_recall else 0.5) and abs(recall - rows[0]["audit_recall"]) < 0.08


def test_the_exact_way_finds_every_link(spark):
    x = vectors(500, 20, 8, 0.08, 2)
    rows = N.classes(frame(spark, x), shard_rows=60, region_rows=100, block_rows=40, overlap=5, max_overlap=4).collect()
    assert checked(rows, x) == 1


def test_bound_of_a_share():
    assert N.least_share(1.0, 100) == pytest.approx(100 / (100 + 1.645**2)) and N.least_share(0.96, 200) < 0.95 < N.least_share(0.96, 20000) < 0.96


def test_empty_table_and_clashing_columns(spark):
    empty = frame(spark, np.ones((1, 3))).where("vec_id > 5")
    assert N.classes(empty).collect() == []
    odd = empty.unionByName(spark.createDataFrame([(1, None, "x", 0), (2, [0.0, 0.0], "x", 0), (3, [1.0, None], "x", 0), (4, [1.0, float("nan")], "x", 0), (5, [1.0, 1.0], "x", 0), (5, [2.0, 2.0], "y", 1), (None, [1.0, 1.0], "x", 0)], empty.schema))
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in N.classes(odd).collect())
    assert got == [(0, 2, 5, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 2, 5, True), (5, 2, 5, True)]
