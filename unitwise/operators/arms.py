"""Three-frame inputs by arm: which frames accompany a centre, the channels made of them, and what each arm is worth.

An arm is a named rule that gives every triplet's centre two companions. All arms are built over the same centres, so
their results are paired. Rules are looked up by name in `ARMS`; `arm` adds further ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, matrices  # noqa: F401  arrays lets workers have the functions of matrices
from .sequences import clean_companions, random_companions, triplets
from .splits import random_split

#: name -> rule(tagged frames, triplets, folder, index, key, tag, seed) -> (centre, first, second); None: the centre alone.
ARMS: dict[str, Callable[..., DataFrame] | None] = {"single": None}


def arm(name: str):
    """Registers a rule under a name."""

    def add(rule):
        ARMS[name] = rule
        return rule

    return add


@arm("index")
def neighbours(frames, trips, folder, index, key, tag, seed) -> DataFrame:
    """The frames before and after."""
    return trips.select("centre", F.col("before").alias("first"), F.col("after").alias("second"))


@arm("shuffle")
def others(frames, trips, folder, index, key, tag, seed) -> DataFrame:
    """Two frames of the folder outside the triplet, drawn by seed."""
    return random_companions(frames, folder, index, key, seed).select("centre", "first", "second")


@arm("clean")
def same_side(frames, trips, folder, index, key, tag, seed) -> DataFrame:
    """The two nearest frames of the folder on the centre's side of the split."""
    near = clean_companions(frames, folder, index, key, tag).withColumnRenamed(key, "centre")
    return near.join(trips.select("centre"), "centre", "left_semi").select("centre", "first", "second")


def members(frames: DataFrame, names: list[str], folder: str, index: str, key: str, tag: str, seed: int = 0) -> DataFrame:
    """(arm, centre, first, second) of the named arms over the same centres; first and second are null for one channel."""
    trips = triplets(frames, folder, index, key)
    out = None
    for name in names:
        if name not in ARMS:
            raise ValueError(f"no such arm: {name}; known: {', '.join(sorted(ARMS))}")
        none = F.lit(None).cast(frames.schema[key].dataType)
        rows = trips.select("centre", none.alias("first"), none.alias("second")) if ARMS[name] is None else ARMS[name](frames, trips, folder, index, key, tag, seed)
        rows = rows.select(F.lit(name).alias("arm"), "centre", "first", "second")
        out = rows if out is None else out.unionByName(rows)
    return out


def channels(chosen: DataFrame, frames: DataFrame, key: str, vector: str, runs: tuple[str, ...] = ()) -> DataFrame:
    """(runs, arm, centre, channels): the vectors of (first, centre, second), or of the centre alone, as one array each.

    Frames are met once, by key, whatever the number of arms; at most three rows of a centre meet after it."""
    flat = chosen.select(*runs, "arm", "centre", F.posexplode(F.array("first", "centre", "second")).alias("place", "k")).where("k IS NOT NULL")
    met = flat.join(frames.select(F.col(key).alias("k"), F.col(vector).alias("x")), "k")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"])
    return met.groupBy(*runs, "arm", "centre").agg(ordered.alias("channels"))


def _centroids(rows: DataFrame, run: list[str], vector: str) -> DataFrame:
    """(run, class, m): mean vectors by class of each run. Every task sums its rows by run and class first."""
    by = [*run, "class"]
    of = rows.select(*by, vector)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in of.select(*by).schema)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(len(by))), strict=True))
            codes = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            names, code = list(codes), np.fromiter((codes[k] for k in keys), np.int64, len(keys))
            for at, x in matrices.vectors(b.column(len(by))):
                for c in np.unique(code[at]):
                    mine = x[code[at] == c]
                    new = np.stack((np.full(x.shape[1], float(len(mine))), mine.sum(0)))
                    old = held.get(names[c], np.zeros((2, 0)))
                    size = max(old.shape[1], new.shape[1])
                    held[names[c]] = sum(np.pad(z, ((0, 0), (0, size - z.shape[1]))) for z in (old, new))
        if held:
            columns = [pa.array([k[i] for k in held]) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([h[0] for h in held.values()], pa.list_(pa.float64())), pa.array([h[1] for h in held.values()], pa.list_(pa.float64()))], names=[*by, "n", "s"])

    return _means(of.mapInArrow(sums, f"{kinds}, n array<double>, s array<double>"), by)


def _means(partial: DataFrame, by: list[str]) -> DataFrame:
    """(by, m) of counts n and sums s by place."""
    means = partial.select(*by, F.posexplode(F.arrays_zip("n", "s")).alias("pos", "x")).groupBy(*by, "pos").agg((F.sum("x.s") / F.sum("x.n")).alias("m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("m"))


def judged(sided: DataFrame, run: list[str], vector: str = "v") -> DataFrame:
    """Test rows with y_pred, the nearest centroid of the train rows of their run (ties: the first name). Rows of other sides only stay out.

    The centroids, one for each run and class, go to the tasks; `vector` is an array of doubles or of packed channels."""
    model: dict[tuple, list] = {}
    for r in sorted(_centroids(sided.where("side = 'train'"), run, vector).collect(), key=lambda r: r["class"]):
        m = np.array(r["m"], float)
        model.setdefault(tuple(r[c] for c in run), []).append((r["class"], m / (np.linalg.norm(m) or 1.0)))
    keep = [c for c in sided.columns if c != vector]
    rows = sided.where("side = 'test'").select(*keep, vector)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = list(zip(*(b.column(keep.index(c)).to_pylist() for c in run), strict=True))
            codes = {k: i for i, k in enumerate(model)}
            code, found = np.fromiter((codes.get(k, -1) for k in keys), np.int64, len(keys)), np.full(len(keys), None, object)
            names = list(model)
            for at, x in matrices.vectors(b.column(len(keep))):
                for c in np.unique(code[at]):
                    if c >= 0:
                        mine, classes = code[at] == c, model[names[c]]
                        sims = x[mine] @ np.stack([m for _, m in classes]).T
                        found[at[mine]] = np.array([n for n, _ in classes], object)[sims.argmax(1)]
            known = pa.array(code >= 0)
            out = pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(found, pa.string())], names=[*keep, "y_pred"])
            yield out.filter(known)

    return rows.mapInArrow(nearest, f"{kinds}, y_pred string")


def _marked(column: pa.Array, n_runs: int) -> np.ndarray:
    """Rows by runs: whether a list of run numbers names the run."""
    out = np.zeros((len(column), n_runs))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)] = 1
    return out


def judged_once(frames: DataFrame, protocol: str, n_runs: int, vector: str = "v") -> DataFrame:
    """(protocol, run, class, y_pred): as `judged`, of frames that name the runs, numbered from 0, in which they `train` and are `test`.

    A frame comes once for each protocol, whatever the number of runs: its vector is summed for all of them at once."""
    kind = frames.schema[protocol].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            keys, marks = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), _marked(b.column(2), n_runs)
            codes = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            names, code = list(codes), np.fromiter((codes[k] for k in keys), np.int64, len(keys))
            for at, x in matrices.vectors(b.column(3)):
                for c in np.unique(code[at]):
                    mine, own = marks[at][code[at] == c], x[code[at] == c]
                    new = (np.repeat(mine.sum(0)[:, None], x.shape[1], 1), mine.T @ own)
                    old = held.get(names[c], (np.zeros((n_runs, 0)),) * 2)
                    size = max(old[0].shape[1], x.shape[1])
                    held[names[c]] = tuple(np.pad(o, ((0, 0), (0, size - o.shape[1]))) + np.pad(z, ((0, 0), (0, size - x.shape[1]))) for o, z in zip(old, new, strict=True))
        rows = [(*k, r, n[r], s[r]) for k, (n, s) in held.items() for r in np.flatnonzero(n.any(1)).tolist()]
        if rows:
            of, cls, run, n, s = zip(*rows, strict=True)
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(cls), pa.array(run, pa.int32()), pa.array(n, lists), pa.array(s, lists)], names=[protocol, "class", "run", "n", "s"])

    by = [protocol, "run", "class"]
    partial = frames.select(protocol, "class", "train", vector).mapInArrow(sums, f"`{protocol}` {kind}, class string, run int, n array<double>, s array<double>")
    model: dict[tuple, list] = {}
    for r in sorted(_means(partial, by).collect(), key=lambda r: r["class"]):  # a row for a run and class
        m = np.array(r["m"], float)
        model.setdefault((r[protocol], r["run"]), []).append((r["class"], m / (np.linalg.norm(m) or 1.0)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, marks = np.array(b.column(0).to_pylist(), object), _marked(b.column(2), n_runs)
            place, run, found = [], [], []
            for at, x in matrices.vectors(b.column(3)):
                for (name, r), classes in model.items():
                    mine = (of[at] == name) & (marks[at][:, r] > 0)
                    if mine.any():
                        sims = x[mine] @ np.stack([m for _, m in classes]).T
                        place.append(at[mine])
                        run.append(np.full(mine.sum(), r))
                        found.append(np.array([n for n, _ in classes], object)[sims.argmax(1)])
            if place:
                rows = pa.array(np.concatenate(place))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(np.concatenate(run), pa.int32()), b.column(1).take(rows), pa.array(np.concatenate(found), pa.string())], names=[protocol, "run", "class", "y_pred"])

    return frames.select(protocol, "class", "test", vector).mapInArrow(nearest, f"`{protocol}` {kind}, run int, class string, y_pred string")


def random_runs(rows: DataFrame, side: str = "tag") -> DataFrame:
    """(arm, seed, value): accuracy on the random split that each row's tag names."""
    pred = judged(rows.withColumn("side", F.col(side)), ["arm", "seed"])
    return pred.groupBy("arm", "seed").agg(F.avg((F.col("class") == F.col("y_pred")).cast("double")).alias("value"))


def unseen_runs(rows: DataFrame, target: str, val_frac: float = 0.15, unit_col: str = "unit") -> DataFrame:
    """(arm, seed, value): recall on the target unit, held out of training and validation.

    Of the other rows the first int(val_frac * n) in an order drawn by seed are validation, alike in every arm."""
    centres = rows.where(F.col(unit_col) != target).select("seed", "centre").distinct()
    val = random_split(centres, val_frac, "seed", "centre", runs=("seed",), cut="down").where("side = 'test'").select("seed", "centre", F.lit(True).alias("val"))
    sided = rows.join(val, ["seed", "centre"], "left").withColumn("side", F.when(F.col(unit_col) == target, "test").when(F.col("val"), "val").otherwise("train")).drop("val")
    pred = judged(sided, ["arm", "seed"])
    return pred.groupBy("arm", "seed").agg(F.avg((F.col("class") == F.col("y_pred")).cast("double")).alias("value"))


def arm_summary(runs: DataFrame) -> DataFrame:
    """(setting, arm, n, mean, sd, low, high) over seeds; sd is 0 for one seed."""
    return runs.groupBy("setting", "arm").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))


def contrasts(runs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(setting, contrast, n, mean, sd, t) of first - second paired by seed; sd 0 and t null without spread."""
    wanted = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]))
    rows = runs.withColumn("p", wanted).where("arm IN (p.a, p.b)")
    by_seed = rows.groupBy("setting", "p", "seed").agg(F.max(F.when(F.col("arm") == F.col("p.a"), F.col("value"))).alias("x"), F.max(F.when(F.col("arm") == F.col("p.b"), F.col("value"))).alias("y"))
    d = by_seed.where("x IS NOT NULL AND y IS NOT NULL").withColumn("d", F.col("x") - F.col("y"))
    g = d.groupBy("setting", "p").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sd"))
    return g.select("setting", F.concat_ws("-", "p.a", "p.b").alias("contrast"), "n", "mean", "sd", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))).alias("t"))
