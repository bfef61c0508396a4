"""Pairs of similar vectors, exactly, and the merging of units that two signals call the same.

Pairs are found by blocks of rows that meet in one task, with two exact bounds before any full product:
rows of a large block are dealt to cells by their nearest pivot, and two cells meet only if, for every pivot, their
ranges of angles to it come within acos(threshold) of each other; inside a task, vectors are split along the pivots'
span and what is left of them, and |rest of a| * |rest of b| + the product inside the span bounds the product."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import draw, unit
from .components import components, written
from .leakage import vector_mean

#: Rows whose directions span the bound, cells by nearest pivot, rows of a chunk. They bound what is sent to tasks and what meets in one.
N_SPAN, N_PIVOTS, CHUNK_ROWS = 48, 16, 2048
SLACK = 1e-9


def _pivots(rows: DataFrame, key: str, vector: str, n: int) -> np.ndarray:
    """The vectors of the n first rows in an order drawn by key, as many as have the length of the first."""
    found = rows.where(F.size(vector) > 0).orderBy(draw(17, F.col(key), 1 << 31), key).limit(n).select(vector).collect()
    return np.array([r[0] for r in found if len(r[0]) == len(found[0][0])], float) if found else np.empty((0, 0))


def _span(pivots: np.ndarray) -> np.ndarray:
    """Orthonormal directions of the pivots, one a column."""
    return np.linalg.qr(pivots.T)[0] if pivots.size else np.empty((pivots.shape[1] if pivots.ndim == 2 else 0, 0))


def compare(a: np.ndarray, b: np.ndarray, span: np.ndarray, threshold: float, same: bool, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places and products of the pairs above the threshold (i < j if both sides are the same rows), and how many full products were taken."""
    in_a, in_b = a @ span, b @ span
    rest_a, rest_b = (np.sqrt(np.maximum((x * x).sum(1) - (y * y).sum(1), 0)) for x, y in ((a, in_a), (b, in_b)))
    found, n_full = [], 0
    for start in range(0, len(a), step):
        stop = min(start + step, len(a))
        open_ = in_a[start:stop] @ in_b.T + np.outer(rest_a[start:stop], rest_b) > threshold - SLACK
        if same:
            open_ &= np.arange(start, stop)[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(open_)
        n_full += len(i)
        if 4 * len(i) > open_.size:
            sims = (a[start:stop] @ b.T)[i, j]
        else:
            sims = np.einsum("ij,ij->i", a[start:stop][i], b[j])
        above = sims > threshold
        found.append((i[above] + start, j[above], sims[above]))
    i, j, sims = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
    return i, j, sims, n_full


def forest(a: np.ndarray, b: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Places of the edges of a maximum spanning forest of (a, b): at every threshold they have the components of all edges."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    root, kept = list(range(len(nodes))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    x, y = ends[: len(a)].tolist(), ends[len(a) :].tolist()
    for e in np.argsort(-sims, kind="stable").tolist():
        p, q = find(x[e]), find(y[e])
        if p != q:
            root[p] = q
            kept.append(e)
            if len(kept) == len(nodes) - 1:
                break
    return np.array(sorted(kept), np.int64)


def _placed(rows: DataFrame, key: str, vector: str, block: str | None, threshold: float, chunk_rows: int, n_pivots: int, n_span: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Rows with their chunk (block, cell, part), the pairs of chunks that may hold a pair, and the span."""
    held = rows.select(F.col(key).alias("k"), F.col(vector).alias("v"), (F.col(block).cast("string") if block else F.lit("")).alias("block"))
    sampled = _pivots(held, "k", "v", max(n_span, n_pivots))
    span, pivots = _span(sampled[:n_span]), sampled[:n_pivots]
    length = sampled.shape[1] if sampled.size else 0
    pivots = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300) if pivots.size else pivots

    @F.pandas_udf("array<double>")
    def angles(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_list()) if len(vectors) else np.empty((0, length))
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return pd.Series(list(np.arccos(np.clip(x / np.where(norm > 0, norm, 1) @ pivots.T, -1, 1))))

    held = held.where(F.size("v") == length)
    n_blocks = held.groupBy("block").agg(F.count(F.lit(1)).alias("rows"))
    near = held.withColumn("angles", angles("v")).join(n_blocks, "block")
    cell = F.when(F.col("rows") > chunk_rows, F.array_position("angles", F.array_min("angles")).cast("int")).otherwise(0)
    celled = written(near.withColumn("cell", cell))
    parts = celled.groupBy("block", "cell").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("parts"))
    chunked = celled.join(parts, ["block", "cell"]).withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
    chunked = chunked.select("k", "v", "angles", F.struct("block", "cell", "part").alias("chunk"))
    low, high = (F.array(*[f(F.get("angles", i)) for i in range(len(pivots))]) for f in (F.min, F.max))
    chunks = written(chunked.groupBy("chunk").agg(low.alias("low"), high.alias("high")))
    width = math.acos(max(-1.0, min(1.0, threshold))) + 1e-7
    side = lambda s: chunks.select(F.col("chunk").alias(s), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"), F.col("chunk.block").alias("block"))
    apart = F.exists(F.zip_with("low_a", "high_b", lambda x, y: x - y > width), lambda x: x) | F.exists(F.zip_with("low_b", "high_a", lambda x, y: x - y > width), lambda x: x)
    meets = side("a").join(side("b"), "block").where((F.col("a") <= F.col("b")) & ~apart).select("a", "b")
    return chunked.drop("angles"), written(meets), span


def _compared(rows: DataFrame, key: str, vector: str, threshold: float, block: str | None, chunk_rows: int, n_pivots: int, n_span: int, spanning: bool = False) -> DataFrame:
    """(a, b, similarity, n_full): pairs, and a row without a pair for each meeting of chunks with the full products it took.

    With `spanning` a meeting gives the maximum spanning forest of its pairs only."""
    kind = rows.schema[key].dataType.simpleString()
    chunked, meets, span = _placed(rows, key, vector, block, threshold, chunk_rows, n_pivots, n_span)
    left = meets.join(chunked.withColumnRenamed("chunk", "a"), "a").select("a", "b", F.lit(0).alias("side"), "k", "v")
    right = meets.where("a <> b").join(chunked.withColumnRenamed("chunk", "b"), "b").select("a", "b", F.lit(1).alias("side"), "k", "v")

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[pdf["side"] == 0].sort_values("k")
        second = pdf[pdf["side"] == 1]
        same = not len(second)
        second = first if same else second
        i, j, sims, n_full = compare(np.stack(first["v"].to_list()), np.stack(second["v"].to_list()), span, threshold, same)
        x, y = first["k"].to_numpy()[i], second["k"].to_numpy()[j]
        keep = x != y
        x, y, sims = x[keep], y[keep], sims[keep]
        if spanning:
            tree = forest(x, y, sims)
            x, y, sims = x[tree], y[tree], sims[tree]
        turned = x > y
        low, high = np.where(turned, y, x).astype(object), np.where(turned, x, y).astype(object)
        return pd.DataFrame({"a": np.append(low, None), "b": np.append(high, None), "similarity": np.append(sims, np.nan), "n_full": np.append(np.zeros(len(low), np.int64), n_full)})

    keyed = left.unionByName(right).withColumn("meeting", F.struct("a", "b")).drop("a", "b")
    return keyed.groupBy("meeting").applyInPandas(met, f"a {kind}, b {kind}, similarity double, n_full long")


def similarity_pairs(rows: DataFrame, key: str, vector: str, threshold: float, block: str | None = None, chunk_rows: int = CHUNK_ROWS, n_pivots: int = N_PIVOTS, n_span: int = N_SPAN) -> DataFrame:
    """(a, b, similarity) with a < b and dot of unit vectors above the threshold (0 or more), exactly. `block` limits pairs to rows of one block.

    At most two chunks of about chunk_rows rows meet in a task, however large a block is. Null vectors, and those of
    another length than the pivots', are in no pair; zero vectors pass no threshold of 0 or more. Rows of one key are no pair."""
    if threshold < 0:
        raise ValueError("the threshold of similarity_pairs is 0 or more")
    return _compared(rows, key, vector, threshold, block, chunk_rows, n_pivots, n_span).where("a IS NOT NULL").select("a", "b", "similarity")


def similarity_forest(rows: DataFrame, key: str, vector: str, threshold: float, block: str | None = None, chunk_rows: int = CHUNK_ROWS, n_pivots: int = N_PIVOTS, n_span: int = N_SPAN) -> DataFrame:
    """Of the pairs of `similarity_pairs` as many as keep all their components at this and every higher threshold: fewer than the rows of two
    chunks for each meeting of chunks, however many pairs it has."""
    if threshold < 0:
        raise ValueError("the threshold of similarity_forest is 0 or more")
    return _compared(rows, key, vector, threshold, block, chunk_rows, n_pivots, n_span, spanning=True).where("a IS NOT NULL").select("a", "b", "similarity")


def full_products(rows: DataFrame, key: str, vector: str, threshold: float, block: str | None = None, chunk_rows: int = CHUNK_ROWS, n_pivots: int = N_PIVOTS, n_span: int = N_SPAN) -> int:
    """How many pairs of vectors the bounds leave to be multiplied in full."""
    return _compared(rows, key, vector, threshold, block, chunk_rows, n_pivots, n_span).agg(F.sum("n_full")).first()[0] or 0


def merge_edges(units: DataFrame, key: str, vector: str, level: str, similarity: float = 0.90, tolerance: float = 0.15, block: str | None = None) -> DataFrame:
    """(a, b, similarity) of units that are alike in both signals: cosine of at least `similarity`, and levels that
    differ by at most tolerance * max(1, |level of a|), a < b."""
    pairs = similarity_pairs(units.withColumn(vector, unit(F.col(vector))), key, vector, np.nextafter(similarity, -1), block)
    of = lambda side: units.select(F.col(key).alias(side), F.col(level).alias(f"level_{side}"))
    near = F.abs(F.col("level_a") - F.col("level_b")) <= tolerance * F.greatest(F.lit(1.0), F.abs("level_a"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(near).select("a", "b", "similarity", "level_a", "level_b")


def merged_units(units: DataFrame, key: str, vector: str, level: str, similarity: float = 0.90, tolerance: float = 0.15, block: str | None = None) -> DataFrame:
    """(key, root): each unit with the least unit it is joined to by `merge_edges`, directly or over others; itself if alone."""
    edges = merge_edges(units, key, vector, level, similarity, tolerance, block).select("a", "b")
    return components(edges, units.select(F.col(key).alias("node"))).select(F.col("node").alias(key), F.col("component").alias("root"))


def unit_means(frames: DataFrame, by: list[str], vector: str, level: str) -> DataFrame:
    """(by, mean, level, n): a unit's mean vector scaled to length 1, the median of a column of its frames, and how many they are."""
    levels = frames.groupBy(*by).agg(F.median(level).alias("level"), F.count(F.lit(1)).alias("n"))
    means = vector_mean(frames, by, vector).drop("n").withColumn("mean", unit(F.col("mean")))
    return means.join(levels, by)
