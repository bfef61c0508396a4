r"""Ranked lexical search: the best documents of each item, by whole-number term scores.

Terms are the maximal matches of `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`, A-Z in lower case. With N documents that have
terms, L terms in all, n of a document, df documents with a term and tf occurrences in one, a term weighs
w = floor(1000 ln((2N + 2)/(2df + 1))), m = 10 + 90 n N div L, and a document scores the sum of
w * (10^9 tf div (1000 tf + 8 m)) over the distinct terms of an item.

1. One pass over the texts writes, for each document, n and its term vector restricted to terms of items. N, L and df are
   aggregated from that table, so they cover all documents.
2. Vectors are put in the order of falling df and read in shards into an FP-tree: documents that begin alike share a path,
   and a node holds for the documents below it the greatest tf of each of their terms and the least m. The score of no
   document below can exceed the sum over these, so the tree is searched depth first, best child first, and a subtree is
   left for each item whose k-th best score its bound does not reach. Shards of one task share their best so far.
3. Each task sends its k best of each item; a window over these gives the ranks.

Items are taken in slices of at most `slice_terms` terms (or one item), each with a pass of its own, so what is broadcast is
bounded. Ids of documents are whole numbers; among equal scores they ascend, null ids last. Null texts and texts without
terms have no score. Items without terms, or whose terms no document holds, give no rows. Copies of rows are ranked each for
itself, copies of items too. Empty tables give no rows; columns besides id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship, spread, steps

#: Other bytes than 0-9, A-Z, a-z and those of non-ASCII characters become spaces; A-Z become a-z.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TOP, LEAF, SHARD_DOCS, SHARD_TERMS, SLICE_TERMS = 10, 32, 16_384, 4_000_000, 1_000_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


@dataclass
class Items:
    """A slice of items: ids, and the numbers of their terms one item after the other, item i's from cuts[i] to cuts[i + 1]."""

    ids: list
    vocabulary: dict[bytes, int]
    terms: np.ndarray
    cuts: np.ndarray


def slices(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[Items]:
    """Items with terms, at most `most` terms together (or a single item). They pass the driver one partition at a time."""
    ids, vocabulary, terms, cuts = [], {}, [], [0]
    for row in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        wanted = sorted(set(terms_of(row[1].encode("utf-8", "surrogatepass"))))
        if not wanted:
            continue
        if ids and len(terms) + len(wanted) > most:
            yield Items(ids, vocabulary, np.array(terms, np.int64), np.array(cuts))
            ids, vocabulary, terms, cuts = [], {}, [], [0]
        ids.append(row[0])
        terms += [vocabulary.setdefault(t, len(vocabulary)) for t in wanted]
        cuts.append(len(terms))
    if ids:
        yield Items(ids, vocabulary, np.array(terms, np.int64), np.array(cuts))


def _lists(values: list[np.ndarray], sizes: list[int]) -> pa.ListArray:
    flat = np.concatenate(values) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, pa.int32()))


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tf) of each row that has terms: how many, and which of the vocabulary how often."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for b in batches:
            place = 0
            for part in steps(b.column(1), 8_000_000):
                kept, sizes, terms, tf, lengths = [], [], [], [], []
                for i, text in enumerate(part.cast(pa.large_binary()).to_pylist(), place):
                    words = terms_of(text)
                    if words:
                        found = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                        of, count = np.unique(found[found >= 0], return_counts=True)
                        kept.append(i)
                        sizes.append(len(words))
                        terms.append(of)
                        tf.append(count.astype(np.int32))
                        lengths.append(len(of))
                place += len(part)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), _lists(terms, lengths), _lists(tf, lengths)], names=["id", "n", "terms", "tf"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, n long, terms array<int>, tf array<int>")


def contribution(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class Node:
    """A subtree: its terms with their greatest tf, its least m, and either children or the rows of its documents."""

    terms: np.ndarray
    tf: np.ndarray
    m: int
    children: list[Node] | None
    rows: range | None


class Tree:
    """An FP-tree over rows of term numbers that ascend in the order of falling document frequency."""

    def __init__(self, terms: list[np.ndarray], tf: list[np.ndarray], m: list[int], ids: list, leaf: int = LEAF):
        keyed = sorted((t.astype(">u4").tobytes(), f.astype(">u4").tobytes(), m, i is None, i or 0) for t, f, m, i in zip(terms, tf, m, ids, strict=True))
        self.ids: list[list] = []  # of rows that are alike, ascending
        kept, last = [], None
        for row in keyed:
            if row[:3] == last:
                self.ids[-1].append(None if row[3] else row[4])
            else:
                last = row[:3]
                kept.append(row)
                self.ids.append([None if row[3] else row[4]])
        self.terms = [np.frombuffer(r[0], ">u4").astype(np.int64) for r in kept]
        self.tf = [np.frombuffer(r[1], ">u4").astype(np.int64) for r in kept]
        self.m = np.array([r[2] for r in kept], np.int64)
        self.leaf = leaf
        self.root = self._grow(self._shared())

    def _shared(self) -> np.ndarray:
        """How many terms each row begins alike with the row before."""
        out = np.zeros(len(self.terms), np.int64)
        for i in range(1, len(self.terms)):
            a, b = self.terms[i - 1], self.terms[i]
            n = min(len(a), len(b))
            other = a[:n] != b[:n]
            out[i] = int(other.argmax()) if other.any() else n
        return out

    def _grow(self, shared: np.ndarray) -> Node:
        """Splits ranges of rows where their common path ends, without recursion; small neighbours below one path share a leaf."""
        plan: list[tuple[int, int, list[int] | None]] = [(0, len(shared), None)]
        at = 0
        while at < len(plan):
            low, high, _ = plan[at]
            if high - low > self.leaf:
                inner = shared[low + 1 : high]
                splits = [low, *(np.flatnonzero(inner == inner.min()) + low + 1).tolist(), high]
                parts: list[tuple[int, int]] = []
                for a, b in zip(splits[:-1], splits[1:], strict=True):
                    if parts and b - parts[-1][0] <= self.leaf:
                        parts[-1] = (parts[-1][0], b)
                    else:
                        parts.append((a, b))
                plan[at] = (low, high, list(range(len(plan), len(plan) + len(parts))))
                plan += [(a, b, None) for a, b in parts]
            at += 1
        nodes: list[Node | None] = [None] * len(plan)
        for at in range(len(plan) - 1, -1, -1):
            low, high, below = plan[at]
            children = [nodes[c] for c in below] if below else None
            terms = np.concatenate([c.terms for c in children] if children else self.terms[low:high])
            tf = np.concatenate([c.tf for c in children] if children else self.tf[low:high])
            order = np.argsort(terms, kind="stable")
            terms, tf = terms[order], tf[order]
            first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.empty(0, np.int64)
            nodes[at] = Node(terms[first], np.maximum.reduceat(tf, first) if len(first) else tf, int(self.m[low:high].min()), children, None if children else range(low, high))
        return nodes[0]


class Search:
    """The k best of each item over any number of trees. Term numbers are those of the trees; weights are by term."""

    def __init__(self, terms: np.ndarray, cuts: np.ndarray, weights: np.ndarray, k: int = TOP):
        self.terms, self.cuts, self.weights, self.k = terms, cuts, weights[terms], k
        self.best: list[list[tuple]] = [[] for _ in cuts[1:]]  # heaps of (score, id is not None, -id)
        self.least = np.ones(len(cuts) - 1, np.int64)  # what a document has to reach
        self.place = np.full(len(weights), -1, np.int64)
        self.visited = 0

    def _sums(self, terms: np.ndarray, values: np.ndarray, active: np.ndarray) -> np.ndarray:
        """For rows of contributions of `terms`, the scores of the active items."""
        sizes = self.cuts[active + 1] - self.cuts[active]
        of = spread(self.cuts[active], sizes)
        self.place[terms] = np.arange(len(terms))
        at = self.place[self.terms[of]]
        self.place[terms] = -1
        hit = at >= 0
        ends = np.concatenate(([0], np.cumsum(hit)))[np.concatenate(([0], np.cumsum(sizes)))]
        summed = np.zeros((len(values), int(hit.sum()) + 1), np.int64)
        np.cumsum(values[:, at[hit]] * self.weights[of[hit]], axis=1, out=summed[:, 1:])
        return summed[:, ends[1:]] - summed[:, ends[:-1]]

    def bound(self, node: Node, active: np.ndarray) -> np.ndarray:
        return self._sums(node.terms, contribution(node.tf, np.int64(node.m))[None, :], active)[0]

    def _leaf(self, tree: Tree, node: Node, active: np.ndarray) -> None:
        rows = node.rows
        values = np.zeros((len(rows), len(node.terms)), np.int64)
        for j, r in enumerate(rows):
            values[j, np.searchsorted(node.terms, tree.terms[r])] = contribution(tree.tf[r], tree.m[r])
        scores = self._sums(node.terms, values, active)
        for j, a in zip(*np.nonzero(scores >= self.least[active]), strict=True):
            item, score = int(active[a]), int(scores[j, a])
            heap = self.best[item]
            for i in tree.ids[rows[j]][: self.k]:
                entry = (score, i is not None, -i if i is not None else 0)
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                else:
                    break
            if len(heap) == self.k:
                self.least[item] = heap[0][0]
        self.visited += len(rows)

    def add(self, tree: Tree) -> None:
        every = np.arange(len(self.cuts) - 1)
        stack = [(tree.root, every, self.bound(tree.root, every))]
        while stack:
            node, active, bounds = stack.pop()
            active = active[bounds >= self.least[active]]
            if not len(active):
                continue
            if node.children is None:
                self._leaf(tree, node, active)
                continue
            below = [(c, active, self.bound(c, active)) for c in node.children]
            stack += sorted(below, key=lambda b: int(b[2].sum()))


def _best(table: DataFrame, items: Items, n_docs: int, n_terms: int, df: np.ndarray, k: int) -> DataFrame:
    """(item, id, score): the k best of each item in each task."""
    order = np.lexsort((np.arange(len(df)), -df))  # falling document frequency
    rank = np.empty(len(df), np.int64)
    rank[order] = np.arange(len(df))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df[t]) + 1))) for t in order], np.int64)
    sent = table.sparkSession.sparkContext.broadcast((rank, rank[items.terms], items.cuts, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, terms, cuts, weights = sent.value
        search, held, n_held = Search(terms, cuts, weights, k), [], 0
        for b in batches:
            flat, tf, at = rank[b.column(2).flatten().to_numpy()], b.column(3).flatten().to_numpy(), np.concatenate(([0], np.cumsum(b.column(2).value_lengths().to_numpy()))).tolist()
            for i, (doc_id, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                part = slice(at[i], at[i + 1])
                in_order = np.argsort(flat[part])
                held.append((flat[part][in_order], tf[part][in_order], 10 + 90 * n * n_docs // n_terms, doc_id))
                n_held += at[i + 1] - at[i]
                if len(held) >= SHARD_DOCS or n_held >= SHARD_TERMS:
                    search.add(Tree(*map(list, zip(*held, strict=True))))
                    held, n_held = [], 0
        if held:
            search.add(Tree(*map(list, zip(*held, strict=True))))
        rows = [(item, -neg if known else None, score) for item, heap in enumerate(search.best) for score, known, neg in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((),) * 3)], names=["item", "id", "score"])

    return table.where(F.size("terms") > 0).select("id", "n", "terms", "tf").mapInArrow(run, "item long, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_terms: int = SLICE_TERMS) -> DataFrame:
    """(item id, rank, id, score) of the k documents of the highest scores above 0 of each row of items."""
    spark = ship(docs.sparkSession)
    item_kind, id_kind = items.schema[item_col].dataType, docs.schema[id_col].dataType
    out = None
    for part in slices(items, item_col, item_text_col, slice_terms):
        table = materialize(vectors(docs, part.vocabulary, id_col, text_col), "lexical")
        sizes = table.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        df = np.zeros(len(part.vocabulary), np.int64)
        for r in table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():  # no more rows than the vocabulary
            df[r["t"]] = r["df"]
        if not sizes["docs"]:
            continue
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        ranked = _best(table, part, sizes["docs"], sizes["terms"], df, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, name) for i, name in enumerate(part.ids)], f"item long, name {item_kind.simpleString()}")
        ranked = ranked.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), "rank", F.col("id").cast(id_kind).alias(id_col), "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        out = spark.createDataFrame([], f"`{item_col}` {item_kind.simpleString()}, rank int, `{id_col}` {id_kind.simpleString()}, score long")
    return out
