"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one node, known by the 64-bit hash of its parts, with a count. Nodes are dealt to overlapping shards:
each to its `overlap` nearest of the centroids that k-means finds on a bounded sample. A shard of more than `block_rows`
nodes is cut into blocks by hash. A block's graph is built by insertion: batches of nodes are searched for, by a beam
from the medoid, in the graph of those before them; what the beam holds is robustly pruned to a few diverse neighbours,
reverse edges are added and pruned again where a list overflows, and a second turn inserts all nodes anew. The adjacency
lists of a node from all its shards are united. Shards of near centroids form regions of some `region_rows` nodes, and
there the united graph is walked over the borders of shards: greedily from the medoid (and from the node's own place)
towards each node, and from there in all directions while similarity stays above the threshold less `slack`. Two blocks of
a region meet in one task, which asks for the nodes of each in the graph of the other and takes a pair that either way
finds, if its cosine, in double precision, reaches the threshold. A pair belongs to the first region that both nodes
share and to no other, so it is one link, counted at both ends and joined in the components, or none at all. A task gives
each node its number of links and the least node of its component there, so rows grow with nodes, never with pairs.

Recall is audited against brute force: links between different vectors are counted for `audit` nodes over all nodes,
and for more of them until `least_links` true links are seen; the lower 95 % bound of that share counts, unless all nodes were
asked. Below `least_recall` the search is repeated with one more
shard for each node, up to `max_overlap`, and then by an exact comparison of all shards that the triangle inequality of
angles does not rule out, block by block.

Vectors that are null, empty, zero, or hold null or non-finite parts link with nothing. Shorter vectors
count as padded with zeros. Rows without an id link like others; `component_id` is the least id that is not null (null
where there is none), and such rows are never `kept` in its place. An empty table gives no rows. Different vectors with
equal hashes would be taken for copies. A group's work is bounded by `region_rows` and `block_rows` squared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship
from .jaccard_join import roots


def prune(x: np.ndarray, own: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of the candidates of the nodes `own` (nearest first; -1 pads) to `degree` neighbours; -1 pads."""
    out = np.full((len(near), degree), -1, np.int64)
    for i in range(0, len(near), 256):
        cand = near[i : i + 256]
        c = x[cand]
        far = 1 - np.einsum("nd,nkd->nk", x[own[i : i + 256]], c)
        alive = (cand >= 0) & (cand != own[i : i + 256, None])
        rows = np.arange(len(cand))
        for r in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            pick = alive.argmax(1)
            out[i : i + 256, r] = np.where(some, cand[rows, pick], -1)
            between = 1 - np.einsum("nd,nkd->nk", c[rows, pick], c)
            alive &= alpha * between > far
            alive[rows, pick] = False
    return out


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def beam(x: np.ndarray, near: np.ndarray, start: int, q: np.ndarray, width: int) -> np.ndarray:
    """The nodes that a beam search from `start` ends with for each query, nearest first; -1 pads."""
    n, rows = len(q), np.arange(len(q))
    pool, sims, open_ = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf), np.zeros((n, width), bool)
    pool[:, 0], sims[:, 0], open_[:, 0] = start, q @ x[start], True
    live = rows
    while len(live):
        pick = np.where(open_[live], sims[live], -np.inf).argmax(1)
        open_[live, pick] = False
        cand = near[pool[live, pick]]
        s = np.einsum("nkd,nd->nk", x[cand], q[live])
        s[(cand < 0) | (cand[:, :, None] == pool[live][:, None, :]).any(2)] = -np.inf
        every, value = np.concatenate((pool[live], cand), 1), np.concatenate((sims[live], s), 1)
        flag = np.concatenate((open_[live], s > -np.inf), 1)
        top = np.argsort(-value, 1, kind="stable")[:, :width]
        pool[live], sims[live] = np.take_along_axis(every, top, 1), np.take_along_axis(value, top, 1)
        open_[live] = np.take_along_axis(flag, top, 1) & (sims[live] > -np.inf)
        live = live[open_[live].any(1)]
    pool[sims == -np.inf] = -1
    return pool


def graph(x: np.ndarray, degree: int = 12, width: int = 32, alpha: float = 1.2, seed: int = 0) -> list[np.ndarray]:
    """Adjacency lists of a block of unit vectors, by insertion in batches that double, in two turns."""
    n, cap = len(x), 3 * degree
    near, size = np.full((n, cap), -1, np.int64), np.zeros(n, np.int64)
    order = np.concatenate(([medoid(x)], np.random.default_rng(seed).permutation(n)))
    order = order[np.sort(np.unique(order, return_index=True)[1])]
    centre = int(order[0])

    def link(own: np.ndarray, found: np.ndarray) -> None:
        kept = prune(x, own, found, degree, alpha)
        a, b = np.repeat(own, degree), kept.reshape(-1)
        a, b = a[b >= 0], b[b >= 0]
        a, b = np.concatenate((a, b)), np.concatenate((b, a))
        for i, j in dict.fromkeys(zip(a.tolist(), b.tolist(), strict=True)):
            if (near[i, : size[i]] == j).any():
                continue
            if size[i] == cap:
                full = near[i][np.argsort(-(x[near[i]] @ x[i]), kind="stable")]
                less = prune(x, np.array([i]), full[None], degree, alpha)[0]
                size[i] = (less >= 0).sum()
                near[i] = -1
                near[i, : size[i]] = less[: size[i]]
            near[i, size[i]] = j
            size[i] += 1

    for turn in range(2):
        done = 1 if turn == 0 else 0
        while done < n:
            own = order[done : done + (min(256, done) if turn == 0 else 256)]
            link(own, beam(x, near, centre, x[own], width))
            done += len(own)
    reached = np.zeros(n, bool)
    lists = [near[i, : size[i]].copy() for i in range(n)]
    _reach(lists, centre, reached)
    for i in range(n):  # what overflowing lists cut off is tied to the medoid
        if not reached[i]:
            lists[centre] = np.append(lists[centre], i)
            _reach(lists, i, reached)
    return lists


def _reach(adjacency: list[np.ndarray], start: int, reached: np.ndarray) -> None:
    front = np.array([start])
    reached[start] = True
    while len(front):
        new = np.unique(np.concatenate([adjacency[i] for i in front.tolist()]))
        front = new[~reached[new]].astype(np.int64)
        reached[front] = True


class Block:
    """Unit vectors with padded adjacency, for range searches."""

    def __init__(self, x: np.ndarray, adjacency: list[np.ndarray]):
        n, width = len(x), max(1, max(map(len, adjacency)))
        self.x = np.vstack((x, np.zeros((1, x.shape[1]))))
        self.next = np.full((n + 1, width), n, np.int64)
        for i, a in enumerate(adjacency):
            self.next[i, : len(a)] = a
        self.n, self.centre = n, medoid(x)

    def walk(self, q: np.ndarray) -> int:
        """The greedy walk from the medoid: the node from which no neighbour is nearer to q."""
        at, best = self.centre, float(self.x[self.centre] @ q)
        while True:
            around = self.next[at]
            s = self.x[around] @ q
            s[around == self.n] = -2
            k = int(s.argmax())
            if s[k] <= best:
                return at
            at, best = int(around[k]), float(s[k])

    def within(self, q: np.ndarray, own: int | None, threshold: float, slack: float) -> np.ndarray:
        """Nodes with cosine to q of at least the threshold, found by widening from the walk's end and the own place."""
        seen = np.zeros(self.n + 1, bool)
        seen[self.n] = True
        front = np.unique([self.walk(q)] if own is None else [self.walk(q), own])
        seen[front] = True
        start = self.next[front].reshape(-1)
        front = np.unique(np.concatenate((front, start[start < self.n])))
        seen[front] = True
        found = []
        while len(front):
            s = self.x[front] @ q
            found.append(front[s >= threshold])
            wide = front[s >= threshold - slack]
            new = np.unique(self.next[wide])
            front = new[~seen[new]]
            seen[front] = True
        return np.concatenate(found)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of unit length; scaled by their largest part first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as rows of `width`, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    for i, (end, k) in enumerate(zip(np.cumsum(sizes), sizes, strict=True)):
        out[i, :k] = flat[end - k : end]
    return out


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Spherical k-means on a sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


VALID = "v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"


_FOUND = "node long, k long, n long, root long"


def _found(node: list, k: list, n: list, root: list) -> pa.Table:
    return pa.table({"node": pa.array(node, pa.int64()), "k": pa.array(k, pa.int64()), "n": pa.array(n, pa.int64()), "root": pa.array(root, pa.int64())})


def _centres(nodes: DataFrame, width: int, shard_rows: int, sample: int, max_centroids: int) -> np.ndarray:
    """Centroids of shards, from a bounded sample of nodes; one that says nothing where one shard holds all."""
    total = nodes.count()
    k = int(min(max_centroids, max(1, total // shard_rows)))
    draw = F.pmod(F.xxhash64("node", F.lit(71)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, total)))
    drawn = nodes.where(draw).select("node", "v").toPandas().sort_values("node") if k > 1 else None
    k = 1 if drawn is None else min(k, len(drawn))
    return np.ones((1, width)) if k <= 1 else centroids(unit(np.array([np.pad(v, (0, width - len(v))) for v in drawn["v"]])), k)


def _blocks(dealt: DataFrame, key: str, rows: int) -> DataFrame:
    """dealt with the number of blocks of its group and its own block, by hash."""
    sizes = dealt.groupBy(key).agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    return dealt.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _search(nodes: DataFrame, c: np.ndarray, width: int, threshold: float, overlap: int, shard_rows: int, region_rows: int, block_rows: int, slack: float) -> DataFrame:
    """(node, k, n, root) rows: links to other vectors, links by count of copies, and the least node of the component in a region."""
    spark = nodes.sparkSession
    n_regions = -(-len(c) * shard_rows // region_rows)
    of = np.zeros(len(c), np.int64) if n_regions <= 1 else (c @ centroids(c, n_regions).T).argmax(1)
    sent = spark.sparkContext.broadcast((c, of))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, of = sent.value
        for b in batches:
            s = unit(matrix(b.column(2), width)) @ c.T if b.num_rows else np.zeros((0, 1))
            own = np.sort(np.argsort(-s, 1, kind="stable")[:, :overlap], 1)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(own), lists), pa.array([np.unique(of[x]) for x in own], lists)], names=["node", "m", "v", "shards", "regions"])

    dealt = nodes.select("node", "m", "v").mapInArrow(deal, "node long, m long, v array<double>, shards array<long>, regions array<long>")
    dealt = materialize(dealt, "vectors-dealt")

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        lists = graph(unit(matrix(table.column("v"), width)))
        return pa.table({"node": ids, "near": pa.array([ids[a] for a in lists], pa.list_(pa.int64()))})

    sharded = _blocks(dealt.select(F.explode("shards").alias("shard"), "node", "v"), "shard", block_rows)
    near = sharded.select("shard", "block", "node", "v").groupBy("shard", "block").applyInArrow(build, "node long, near array<long>")
    united = near.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # one list for a shard of the node
    held = dealt.join(materialize(united, "vectors-graph"), "node").select(F.explode("regions").alias("region"), "node", "m", "v", "regions", "near")
    held = materialize(_blocks(held, "region", region_rows), "vectors-held")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = held.withColumn("other", every)
    met = met.select("region", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), (F.col("block") > F.col("other")).cast("int").alias("role"), "node", "m", "v", "regions", "near")

    def search(table: pa.Table) -> pa.Table:
        ids, role = table.column("node").to_numpy(), table.column("role").to_numpy()
        here, alike = int(table.column("region")[0].as_py()), table.column("first")[0] == table.column("second")[0]
        left = np.flatnonzero(role == 0)
        right = left if alike else np.flatnonzero(role == 1)
        x, near, regions = unit(matrix(table.column("v"), width)), table.column("near").to_pylist(), table.column("regions").to_pylist()
        linked = np.zeros((len(left), len(right)), bool)

        def ask(asking: np.ndarray, inside: np.ndarray, mark: np.ndarray) -> None:
            place = {node: i for i, node in enumerate(ids[inside].tolist())}
            block = Block(x[inside], [np.array([place[j] for j in near[i] if j in place], np.int64) for i in inside.tolist()])
            for i, a in enumerate(asking.tolist()):
                mark[i, block.within(x[a], place.get(int(ids[a])), threshold, slack)] = True

        if len(left) and len(right):
            ask(left, right, linked)
            if alike:
                linked |= linked.T
                np.fill_diagonal(linked, False)
            else:
                ask(right, left, linked.T)
            for r in {r for of in regions for r in of if r < here}:  # pairs of an earlier region
                linked[np.ix_([r in regions[i] for i in left.tolist()], [r in regions[i] for i in right.tolist()])] = False
        return _counted(ids, table.column("m").to_numpy(), left, right, linked, alike)

    return met.groupBy("region", "first", "second").applyInArrow(search, _FOUND)


def _counted(ids: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray, linked: np.ndarray, alike: bool) -> pa.Table:
    """Links, links by copies, and the least node of the component, of each node with a link; `linked` is symmetric if both sides are alike."""
    k, n, label = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), ids.copy()
    for i in range(0, len(left), 256):  # sums of copies as numbers, some rows at a time
        some, rows = linked[i : i + 256], left[i : i + 256]
        k[rows] += some.sum(1)
        n[rows] += some @ m[right]
        if not alike:
            k[right] += some.sum(0)
            n[right] += m[rows] @ some
    open_rows = linked.any(1)
    while open_rows.any():
        rows, cols = np.zeros(len(left), bool), np.zeros(len(right), bool)
        front = np.array([open_rows.argmax()])
        while len(front):
            rows[front] = True
            new = linked[front].any(0) & ~cols
            cols |= new
            front = np.flatnonzero((linked[:, new].any(1)) & ~rows)
        members = np.concatenate((left[rows], right[cols]))
        label[members] = ids[members].min()
        open_rows &= ~rows
    at = np.flatnonzero(k)
    return _found(ids[at].tolist(), k[at].tolist(), n[at].tolist(), label[at].tolist())


def _exact(nodes: DataFrame, c: np.ndarray, width: int, threshold: float, block_rows: int) -> DataFrame:
    """As `_search`, by comparing all blocks of all pairs of shards whose angles allow a link: no link is missed."""
    spark = nodes.sparkSession
    sent = spark.sparkContext.broadcast(unit(c))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = unit(matrix(b.column(2), width)) @ sent.value.T if b.num_rows else np.zeros((0, 1))
            angle = np.arccos(np.clip(s.max(1), -1, 1)) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.argmax(1) if b.num_rows else [], pa.int64()), pa.array(angle, pa.float64())], names=["node", "m", "v", "shard", "angle"])

    dealt = materialize(_blocks(nodes.select("node", "m", "v").mapInArrow(deal, "node long, m long, v array<double>, shard long, angle double"), "shard", block_rows), "vectors-dealt")
    sizes = dealt.groupBy("shard").agg(F.max("angle").alias("radius"), F.max("blocks").alias("blocks"))
    radius = {r["shard"]: r["radius"] for r in sizes.collect()}  # a row for a shard
    used = np.array(sorted(radius), np.int64)
    known = spark.sparkContext.broadcast((unit(c)[used], np.array([radius[s] for s in used.tolist()]), used))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, radius, used = known.value
        for b in batches:
            for i in b.column(0).to_pylist():
                between = np.arccos(np.clip(c[i:] @ c[i], -1, 1)) - radius[i] - radius[i:]
                j = i + np.flatnonzero(between <= np.arccos(min(1.0, threshold)) + 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), used[i])), pa.array(used[j])], names=["s1", "s2"])

    of = lambda s, blocks: sizes.select(F.col("shard").alias(s), F.col("blocks").alias(blocks))
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = spark.range(len(used)).mapInArrow(near, "s1 long, s2 long").join(of("s1", "b1"), "s1").join(of("s2", "b2"), "s2")
    pairs = materialize(pairs.withColumn("p1", parts("b1")).withColumn("p2", parts("b2")).where("s1 < s2 or p1 <= p2").select("s1", "p1", "s2", "p2"), "vectors-pairs")
    side = lambda s, p, role: dealt.join(pairs, (F.col("shard") == F.col(s)) & (F.col("block") == F.col(p))).select("s1", "p1", "s2", "p2", "node", "m", "v", F.lit(role).alias("role"))
    both = side("s1", "p1", 0).unionByName(side("s2", "p2", 1).where("s1 <> s2 or p1 <> p2"))

    def compare(table: pa.Table) -> pa.Table:
        role, ids, m = table.column("role").to_numpy(), table.column("node").to_numpy(), table.column("m").to_numpy()
        x = unit(matrix(table.column("v"), width))
        left, right = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        right = right if len(right) else left
        linked = np.concatenate([x[left[i : i + 512]] @ x[right].T >= threshold for i in range(0, len(left), 512)])
        if right is left:
            linked |= linked.T
            np.fill_diagonal(linked, False)
        return _counted(ids, m, left, right, linked, right is left)

    return both.groupBy("s1", "p1", "s2", "p2").applyInArrow(compare, _FOUND)


def _audit(nodes: DataFrame, counts: DataFrame, width: int, threshold: float, audit: int, least_links: int) -> float:
    """Links found between different vectors by share of those that brute force finds, over nodes drawn by hash and all nodes."""
    total = nodes.count()
    while True:
        draw = F.pmod(F.xxhash64("node", F.lit(97)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, audit / max(1, total)))
        asked = nodes.where(draw).select("node", "v").join(counts, "node", "left").select("v", F.coalesce("k", F.lit(0)).alias("k")).collect()
        if not asked:
            return 1.0
        sent = nodes.sparkSession.sparkContext.broadcast(unit(np.array([np.pad(np.array(r.v, float), (0, width - len(r.v))) for r in asked])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(sent.value), np.int64)
            for b in batches:
                if b.num_rows:
                    total += ((unit(matrix(b.column(0), width)) @ sent.value.T) >= threshold).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "n"])

        true = {r.i: r.n for r in nodes.select("v").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
        wanted = sum(true.get(i, 1) - 1 for i in range(len(asked)))
        if wanted >= least_links or audit >= min(total, 16384):
            seen = sum(r.k for r in asked) / wanted if wanted else 1.0
            return seen if audit >= total or wanted < least_links else least_share(seen, wanted)
        audit *= 4


def least_share(seen: float, n: int, z: float = 1.645) -> float:
    """The lower bound of a share seen in n draws (Wilson)."""
    return (seen + z * z / (2 * n) - z * math.sqrt(seen * (1 - seen) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def classes(table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", overlap: int = 2, max_overlap: int = 4, shard_rows: int = 1000, region_rows: int = 8000, block_rows: int = 4000, slack: float = 0.1, sample: int = 8000, max_centroids: int = 4096, audit: int = 256, least_links: int = 100, least_recall: float = 0.95) -> DataFrame:
    """One row for each row of the table: id, n_links, component_id, kept (it is its component's least id), audit_recall."""
    ship(table.sparkSession)
    parts = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # no negative zero
    rows = table.select(F.col(id_col).cast("long").alias("id"), parts.alias("v"))
    valid = rows.where(VALID).withColumn("node", F.xxhash64("v"))
    nodes = materialize(valid.groupBy("node").agg(F.first("v").alias("v"), F.min("id").alias("least"), F.count(F.lit(1)).alias("m")), "vectors-nodes")
    width = nodes.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"), F.lit(1.0).alias("audit_recall"))
    c = _centres(nodes, width, shard_rows, sample, max_centroids)
    while True:
        if overlap <= max_overlap:
            found = _search(nodes, c, width, threshold, overlap, shard_rows, region_rows, block_rows, slack)
        else:
            found = _exact(nodes, c, width, threshold, block_rows)
        found = materialize(found, "vectors-found")
        counts = found.groupBy("node").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
        recall = _audit(nodes, counts, width, threshold, audit, least_links)
        if recall >= least_recall or overlap > max_overlap:
            break
        overlap += 1
    component = roots(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("e", "node")
    known = nodes.select("node", "least", "m").join(counts, "node", "left").join(component, "node", "left")
    known = materialize(known.select("node", "least", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "vectors-known")
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(named, "root").select("node", "n_links", "component_id")
    result = valid.select("id", "node").join(known, "node").select("id", "n_links", "component_id").unionByName(rows.where(f"not coalesce({VALID}, false)").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return result.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(float(recall)).alias("audit_recall"))
