"""Exact Jaccard join of word-shingle sets by universe partition.

Two sets of sizes a <= b link when 100 * |common| >= threshold * |union|, so that they differ in at most
D = floor((a + b)(100 - t)/(100 + t)) elements, and a >= t/100 * b.

Candidates. Sizes fall into bands that grow by (100/t)^2; a set is indexed in its own band and, if it can
reach the next band's sizes, there too, so that linked sets meet in the larger one's band. In a band the
universe is hashed into M segments, and what a set has in a segment makes one signature. D differences
spoil at most D segments. In bands of small sets (D <= `deletion_limit`) ceil((D+1)/2) segments are enough,
each indexed with its one-deletion neighbourhood: some segment then differs by one element at most. In other
bands M is about 1.5 (D+1), and each set is indexed under a subset of D+1 of its segments, the cheapest by
the signatures' frequency in the whole corpus (any M - D common segments force a common one among the D+1
first of each side in one global order). The frequencies come from counts of all documents: signatures
repeated within a task are summed over tasks, and the most frequent, `heavy_limit` at most, go to the tasks; the
order of the rest does not touch the result, only its cost.

Hot groups. Exact copies are one set, known by its 64-bit hash. A bucket of one signature is never paired
with itself: first every set is verified against the least set of the bucket that it shares most with; then, where buckets
hold several components, against one delegate of each bucket, which has then met all others and leaves it; after three
such turns or more, as long as they find links (`rounds` at most), only what is still apart in a bucket is paired across
components. Pairs first pass a parity sketch of some 16 D
cells, whose differing cells are never more than the differing elements, and seldom much fewer; only the texts of pairs that pass are read. The
sketches are dealt by set once, on disk, and every turn's pairs go to them. So the
work follows the bucket's size, and no link is lost: a pair that was not verified is already in one component. The sets
that many others are verified against are dealt over `SALTS` tasks.

Verification counts both shingle sets of the texts. Null texts and texts without words have no set and stay
alone; fewer words than a shingle make one element. Every row is a document of its own, whatever its id: rows of equal
ids are told apart by their texts' hashes, rows without an id link like others, and `component_id` is the least id that
is not null (null where there is none). Sets of different content with equal 64-bit hashes of the whole set, and texts
of one id with equal 64-bit hashes, would be taken for copies. Ids are whole numbers. A long text is one row, whose words are
read at once; an empty table gives no rows, and columns besides id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import coded_words, discard, materialize, mix64, most_frequent, shingle_hashes, ship, spread, unused, words_as_one

U, MASK = np.uint64, (1 << 64) - 1
#: Rows of two numbers that a join may broadcast; larger tables are joined by a shuffle.
BROADCAST_ROWS = 400_000
SALTS = 16
#: Cells of a sketch for each difference that a link allows. With 3, sets of up to 1.6 D differences pass; with 16, of 1.07 D.
CELLS = 16


#: Bytes of text whose sets are made together.
STEP = 4_000_000


def joined_sets(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of texts, for some texts at a time: sorted distinct shingle hashes, one set after the other, and the bounds of each set."""
    for hashed, at, cuts in coded_words(texts, STEP):
        flat, n = hashed[at], np.diff(cuts)
        few = np.flatnonzero((n > 0) & (n < k))  # one element: the whole text
        sizes = np.maximum(n - k + 1, 0)
        sizes[few] = 1
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        whole = np.flatnonzero(n >= k)
        out = np.empty(bounds[-1], np.uint64)
        if len(whole):
            out[spread(bounds[whole], sizes[whole])] = shingle_hashes(flat, k)[spread(cuts[whole], sizes[whole])]
        for i in few.tolist():
            out[bounds[i]] = words_as_one(flat[cuts[i] : cuts[i + 1]])[0]
        ends = bounds.tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            out[a:b].sort()
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        new[bounds[:-1][sizes > 0]] = True
        yield out[new], np.concatenate(([0], np.cumsum(new)))[bounds]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The set of each text."""
    for values, cuts in joined_sets(texts, k):
        cuts = cuts.tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield values[a:b]


def small(df: DataFrame) -> DataFrame:
    """The side of a join that is broadcast where its rows, a few numbers each, are few enough; else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def set_hashes(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, 0 for an empty one."""
    n = np.diff(cuts).astype(np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(values + U(0x51)), dtype=np.uint64)))[cuts]
    return np.where(n > 0, mix64(np.diff(total) + n * U(0xA24BAED4963EE407)), U(0)).view(np.int64)


@dataclass
class Partition:
    """Signatures of sets for one shingle size and threshold (in hundredths)."""

    threshold: int
    spare: float = 1.5
    deletion_limit: int = 2

    def __post_init__(self):
        self.starts = [1]
        self._segments: dict[int, tuple[int, int]] = {}
        self._places: dict[int, list[tuple[int, int]]] = {}

    def band_of(self, n: int) -> int:
        while self.starts[-1] <= n:
            last = self.starts[-1]
            self.starts.append(max(last + 1, -(-last * 10_000 // self.threshold**2)))
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def differences(self, total: int) -> int:
        return total * (100 - self.threshold) // (100 + self.threshold)

    def places(self, n: int) -> list[tuple[int, int]]:
        """(band, D of this set there)."""
        if n not in self._places:
            self._places[n] = self._placed(n)
        return self._places[n]

    def _placed(self, n: int) -> list[tuple[int, int]]:
        band, reach = self.band_of(n), n * 100 // self.threshold
        self.band_of(reach)
        top = self.starts[band + 1] - 1
        out = [(band, self.differences(n + min(top, reach)))]
        if reach > top:
            out.append((band + 1, self.differences(n + reach)))
        return [(b, d) for b, d in out if d > 0]  # D = 0: only equal sets link

    def segments(self, band: int) -> tuple[int, bool]:
        """How many segments a band has, and whether with one-deletion neighbourhoods."""
        found = self._segments.get(band)
        if found is None:
            self.band_of(self.starts[band])
            while len(self.starts) <= band + 1:
                self.band_of(self.starts[-1])
            d = self.differences(2 * (self.starts[band + 1] - 1))
            found = ((d + 2) // 2, True) if d <= self.deletion_limit else (int(np.ceil(self.spare * (d + 1))), False)
            self._segments[band] = found
        return found

    def sketches(self, s: np.ndarray, owner: np.ndarray, n: int, band: int) -> np.ndarray:
        """The parity of the elements of each of n sets in some `CELLS` D cells: cells that differ between two sets of a band bound their differences from below.

        Differences seldom meet in so many cells, so that the bound is close: what passes has few more than D."""
        self.segments(band)
        cells = 64 * -(-(CELLS * self.differences(2 * (self.starts[band + 1] - 1)) + 32) // 64)
        at = (mix64(s ^ U(0x5851F42D4C957F2D)) % U(cells)).astype(np.int64)
        return np.packbits((np.bincount(owner * cells + at, minlength=n * cells) & 1).astype(bool).reshape(n, cells), axis=1).view(np.int64)

    def sketch(self, s: np.ndarray, band: int) -> np.ndarray:
        return self.sketches(s, np.zeros(len(s), np.int64), 1, band)[0]

    def by_band(self, values: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each band: the sets that have a place there (by number), D of each, their elements one set after the other, and which of the sets each is of."""
        found: dict[int, list[tuple[int, int]]] = {}
        for i, n in enumerate(np.diff(cuts).tolist()):
            for band, d in self.places(n) if n else ():
                found.setdefault(band, []).append((i, d))
        for band, rows in found.items():
            which, d = np.array(rows, np.int64).T
            n = cuts[which + 1] - cuts[which]
            ends, first = np.cumsum(n), 0
            while first < len(which):  # some sets at a time, so that the work on them stays in memory that is near
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 50_000, "right")))
                part, size = which[first:last], n[first:last]
                yield band, part, d[first:last], values[spread(cuts[part], size)], np.repeat(np.arange(len(part)), size)
                first = last

    def signatures(self, s: np.ndarray, owner: np.ndarray, n: int, band: int) -> tuple[np.ndarray, np.ndarray | None]:
        """The signatures of the segments of n sets in a band, a row for each; and those of the one-deletion neighbourhoods, one for each element, where the band has them."""
        m, deletions = self.segments(band)
        h = mix64(s + U((band + 1) * 0x9E3779B97F4A7C15 & MASK))
        segment = (h >> U(40)).astype(np.int64) % m
        value, cell = mix64(h), owner * m + segment
        sums = np.zeros(n * m, np.uint64)
        np.add.at(sums, cell, value)
        salt = mix64((np.arange(m, dtype=np.uint64) + U(band << 32) + U(1)) * U(0xD6E8FEB86659FD93))
        whole = mix64(sums.reshape(n, m) ^ salt)
        return whole, mix64((sums[cell] - value) ^ salt[segment]) if deletions else None

    def chosen(self, s: np.ndarray, owner: np.ndarray, d: np.ndarray, band: int, heavy: Heavy) -> tuple[np.ndarray, np.ndarray]:
        """The signatures that sets of a band are indexed under, one set after the other, and how many each has."""
        n = len(d)
        whole, less = self.signatures(s, owner, n, band)
        if less is not None:
            size = np.bincount(owner, minlength=n) + whole.shape[1]
            order = np.argsort(np.concatenate((np.repeat(np.arange(n), whole.shape[1]), owner)), kind="stable")
            return np.concatenate((whole.reshape(-1), less))[order], size
        cost = heavy.counts(whole)
        if cost is None:
            whole.sort(axis=1)
        else:
            order = np.argsort(whole, axis=1)
            whole, cost = np.take_along_axis(whole, order, 1), np.take_along_axis(cost, order, 1)
            some = np.flatnonzero(cost.any(1))
            whole[some] = np.take_along_axis(whole[some], np.argsort(cost[some], axis=1, kind="stable"), 1)
        size = np.minimum(d + 1, whole.shape[1])
        return whole[np.arange(whole.shape[1]) < size[:, None]], size

    def indexed(self, s: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """All signatures that a set is indexed under, given the frequent signatures (sorted) and their counts."""
        known = Heavy(*heavy)
        found = [self.chosen(v, owner, d, band, known)[0] for band, _, d, v, owner in self.by_band(s, np.array([0, len(s)]))]
        return np.unique(np.concatenate([np.empty(0, np.uint64), *found]))


class Heavy:
    """Frequent signatures (sorted) and their counts; a table of low bits tells nearly all others apart without a search."""

    BITS = 22

    def __init__(self, sig: np.ndarray, count: np.ndarray):
        self.sig, self.count, self.maybe = sig, count, np.zeros(1 << self.BITS, bool)
        self.maybe[self._low(sig)] = True

    def _low(self, sig: np.ndarray) -> np.ndarray:
        return (sig & U((1 << self.BITS) - 1)).astype(np.int32)

    def counts(self, sig: np.ndarray) -> np.ndarray | None:
        """The count of each signature, 0 of those that are not frequent; None where none is."""
        at = np.flatnonzero(self.maybe[self._low(sig)])
        if not len(at):
            return None
        asked, out = sig.reshape(-1)[at], np.zeros(sig.size, np.int64)
        place = np.minimum(np.searchsorted(self.sig, asked), len(self.sig) - 1)
        out[at] = np.where(self.sig[place] == asked, self.count[place], 0)
        return out.reshape(sig.shape)


def _first_pass(docs: DataFrame, id_col: str, text_col: str, k: int, partition: Partition, repeated: int) -> DataFrame:
    """Rows (doc, th = hash of the text, n, e = set hash) of documents, and rows (sig, count) of signatures repeated within a task."""
    names = ["doc", "th", "n", "e", "sig", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def heavy() -> pa.RecordBatch:
            sig, count = np.unique(np.concatenate(held), return_counts=True)
            sig, count = sig[count >= repeated], count[count >= repeated]
            none = pa.nulls(len(sig), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(sig.view(np.int64)), pa.array(count.astype(np.int64))], names=names)

        for b in batches:
            n, e = [], []
            for values, cuts in joined_sets(b.column(2), k):
                n.append(np.diff(cuts))
                e.append(set_hashes(values, cuts))
                for band, which, _, s, owner in partition.by_band(values, cuts):
                    if not partition.segments(band)[1]:
                        held.append(partition.signatures(s, owner, len(which), band)[0].reshape(-1))
                        size += len(held[-1])
            none = pa.nulls(b.num_rows, pa.int64())
            n, e = (pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (n, e))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, e, none, none], names=names)
            if size > 3_000_000:
                yield heavy()
                held, size = [], 0
        if held:
            yield heavy()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _index(docs: DataFrame, text_col: str, k: int, partition: Partition, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row for each band of each set: s (its key there), e, n, sigs, cells (its sketch).

    Of a signature 48 bits are kept, so that a shuffle's compression saves the rest; signatures alike by chance share a bucket,
    which costs a comparison and loses no link."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)
    names = ["s", "e", "n", "sigs", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Heavy(*sent.value)
        for b in batches:
            seen: set[int] = set()
            for values, cuts in joined_sets(b.column(0), k):
                e, fresh = set_hashes(values, cuts), np.zeros(len(cuts) - 1, bool)
                for i in np.flatnonzero(np.diff(cuts)).tolist():
                    fresh[i] = (own := int(e[i])) not in seen
                    seen.add(own)
                rows = []
                for band, which, d, s, owner in partition.by_band(values[np.repeat(fresh, np.diff(cuts))], np.concatenate(([0], np.cumsum(np.diff(cuts) * fresh)))):
                    sigs, size = partition.chosen(s, owner, d, band, known)
                    cells = partition.sketches(s, owner, len(which), band)
                    key = mix64(e[which].view(np.uint64) ^ U((band + 1) * 0x9E3779B97F4A7C15 & MASK)).view(np.int64)
                    lists = [
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array((sigs >> U(16)).view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.reshape(-1))),
                    ]
                    rows.append([pa.array(key), pa.array(e[which]), pa.array(np.bincount(owner, minlength=len(which))), *lists])
                if rows:
                    yield pa.RecordBatch.from_arrays(list(map(pa.concat_arrays, zip(*rows, strict=True))), names=names)

    return docs.select(text_col).mapInArrow(run, "s long, e long, n long, sigs array<long>, cells array<long>")


class Verifier:
    """Counts the common shingles of pairs (a, b) of sets, from the text of each set's first document."""

    def __init__(self, docs: DataFrame, firsts: DataFrame, sketches: DataFrame, id_col: str, text_col: str, k: int, threshold: int):
        # dealt by set once for all turns: a turn's exchanges hold its pairs, not all sketches again
        self.sketches = sketches.repartition(int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s").persist(StorageLevel.DISK_ONLY)
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
        self.firsts, self.k, self.threshold = firsts, k, threshold

    def _texts(self, of: DataFrame, key: str) -> DataFrame:
        """`of` (with the set hash in `key`) with the set's text; a text that several rows hold comes once."""
        first = self.firsts.select(F.col("e").alias(key), F.col("doc").alias("d"), F.col("th").alias("t"))
        of = materialize(of.join(first, key), "jaccard-ids")
        found = self.docs.join(small(of), F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
        return found.select(*[c for c in of.columns if c not in "dt"], F.col("text").alias(f"text_{key}"))

    def side(self, x: str) -> DataFrame:
        return self.sketches.select(F.col("s").alias(f"s{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "cells")))

    def fits(self) -> Column:
        """Whether the sizes and sketches of a and b, of one band, allow a link, as a join condition."""
        t = self.threshold
        apart = "aggregate(zip_with(cells_a, cells_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
        return F.expr(f"100 * least(n_a, n_b) >= {t} * greatest(n_a, n_b) and {apart} <= floor((n_a + n_b) * {100 - t} / {100 + t})")

    def named(self, pairs: DataFrame) -> DataFrame:
        """The pairs (sa, sb) as pairs of set hashes, a below b."""
        e = self.sketches.select("s", "e")
        pairs = materialize(pairs.select("sa", "sb"), "jaccard-pairs")
        pairs = e.withColumnsRenamed({"s": "sa", "e": "ea"}).join(small(pairs), "sa")
        return pairs.join(e.withColumnsRenamed({"s": "sb", "e": "eb"}), "sb").select(F.least("ea", "eb").alias("a"), F.greatest("ea", "eb").alias("b")).distinct()

    def possible(self, pairs: DataFrame) -> DataFrame:
        """(a, b) as set hashes of the pairs (sa, sb), of one band each, whose sizes and sketches allow a link."""
        pairs = materialize(pairs.select("sa", "sb"), "jaccard-pairs")
        left = self.side("a").join(small(pairs), "sa")
        right = self.side("b").withColumnRenamed("sb", "s")
        found = self.named(left.join(right, (F.col("sb") == F.col("s")) & self.fits()))
        return found

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        k, threshold = self.k, self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, keep, own = batch.column(0).to_numpy(), [], np.empty(0, np.uint64)
                new = np.concatenate((np.ones(min(1, len(a)), bool), a[1:] != a[:-1]))
                owns = shingle_sets(batch.column(2).filter(pa.array(new)), k)
                for changed, other in zip(new.tolist(), shingle_sets(batch.column(3), k), strict=True):
                    own = next(owns) if changed else own
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    keep.append(100 * common >= threshold * (len(own) + len(other) - common))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        pairs = materialize(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt")), "jaccard-pairs")
        right = self._texts(pairs, "b")
        left = self._texts(pairs.select("a", "salt").distinct(), "a")
        both = right.join(left, ["a", "salt"]).select("a", "b", "text_a", "text_b")
        return both.mapInArrow(run, "a long, b long").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(e, root): connected components of edges (a, b), each labelled by its least member.

    Alternating large-star and small-star steps; every step is two aggregations, written to the shared folder. The least
    neighbour of each node is broadcast while the edges are few; beyond that adaptive execution splits a hub's partition."""
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    size = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
    while True:
        few = F.broadcast if size[0] <= BROADCAST_ROWS else lambda df: df
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(few(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(few(least), "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x")).select(F.col("x.a").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        e, old = materialize(small, "components"), e
        discard(old)
        new = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if new == size:
            return e.select(F.col("a").alias("e"), F.col("b").alias("root"))
        size = new


def labelled(docs: DataFrame, k: int, threshold: int, id_col: str = "doc_id", text_col: str = "text", heavy_limit: int = 300_000, repeated: int = 2, rounds: int = 8) -> DataFrame:
    """One row for each row of docs: doc (its id), th (the hash of its text), n (its set's size), e (the set's hash), root (the component's)."""
    spark: SparkSession = ship(docs.sparkSession)
    partition = Partition(threshold)
    first = materialize(_first_pass(docs, id_col, text_col, k, partition, repeated), "jaccard-sets")
    sizes = first.where("n is not null").select("doc", "th", "n", "e")
    counted = materialize(first.where("sig is not null").groupBy("sig").agg(F.sum("count").alias("count")), "jaccard-counts")
    heavy = most_frequent(counted, "count", heavy_limit).toPandas()
    discard(counted)
    sig, count = heavy["sig"].to_numpy(np.int64).view(np.uint64), heavy["count"].to_numpy(np.int64)
    order = np.argsort(sig)
    index = materialize(_index(docs, text_col, k, partition, (sig[order], count[order])), "jaccard-index")

    # one exchange serves the buckets, what joins them and the rows without repeats
    rows = index.select("s", F.explode("sigs").alias("sig")).repartition("sig")
    buckets = rows.groupBy("sig").agg(F.min("s").alias("least"), F.max("s").alias("most")).where("least <> most").select("sig", "least")
    members = materialize(rows.join(buckets, "sig").select("sig", "s", "least").distinct(), "jaccard-members")
    sketches = materialize(index.select("s", "e", "n", "cells").join(members.select("s").distinct(), "s", "left_semi").dropDuplicates(["s"]), "jaccard-sketches")
    discard(index)
    firsts = materialize(sizes.where("n > 0").groupBy("e").agg(F.min(F.struct(F.isnull("doc"), "doc", "th")).alias("x")).select("e", "x.doc", "x.th"), "jaccard-firsts")
    verifier = Verifier(docs, firsts, sketches, id_col, text_col, k, threshold)
    named = materialize(members.join(sketches.select("s", "e"), "s").select("sig", "s", "e"), "jaccard-members")

    shared = members.where("s <> least").groupBy("s", "least").agg(F.count(F.lit(1)).alias("n"))
    most = shared.groupBy("s").agg(F.max(F.struct("n", "least")).alias("x")).select(F.col("s").alias("sb"), F.col("x.least").alias("sa"))
    links = materialize(verifier.links(verifier.possible(most)), "jaccard-links")
    discard(members)
    found, held = roots(links), named
    for turn in range(rounds):
        apart = _apart(held, found, turn)
        if held is not named:
            discard(held)
        held = materialize(apart.where("s <> sa").select("sig", "s", "e"), "jaccard-held")  # the delegate has then met all others
        pairs = apart.where("root <> of").select(F.least("sa", "s").alias("sa"), F.greatest("sa", "s").alias("sb")).distinct()
        more = materialize(verifier.links(verifier.possible(pairs)), "jaccard-links")
        discard(apart)
        if not more.isEmpty():
            found, old = roots(more.unionByName(found.select(F.col("root").alias("a"), F.col("e").alias("b")))), found
            discard(old)
        if held.isEmpty() or (turn >= 2 and more.isEmpty()):
            break

    apart = _apart(held, found, rounds)
    left = apart.select("sig", F.col("s").alias("sa"), F.col("root").alias("ra")).join(verifier.side("a"), "sa")
    right = apart.select(F.col("sig").alias("t"), F.col("s").alias("sb"), F.col("root").alias("rb")).join(verifier.side("b"), "sb")
    rest = left.join(right, (F.col("sig") == F.col("t")) & F.expr("ra < rb") & verifier.fits()).select("sa", "sb").distinct()
    rest = materialize(verifier.named(rest), "jaccard-rest")
    if not rest.isEmpty():
        more = materialize(verifier.links(rest), "jaccard-links")
        if not more.isEmpty():
            found = roots(more.unionByName(found.select(F.col("root").alias("a"), F.col("e").alias("b"))))
    verifier.sketches.unpersist()
    discard(apart, named, sketches)
    linked = materialize(sizes.join(found.where("e <> root"), "e", "left").select("doc", "th", "n", "e", F.coalesce("root", "e").alias("root")), "jaccard-labelled")
    discard(first)
    return linked


def classes(docs: DataFrame, k: int, threshold: int, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the least id reachable by links, its own included)."""
    rows = labelled(docs, k, threshold, id_col, text_col, **options)
    least = rows.where("n > 0").groupBy("root").agg(F.min("doc").alias("component_id"), F.count(F.lit(1)).alias("size")).where("size > 1").select("root", "component_id")
    found = rows.where("n > 0").join(least, "root", "left").select("doc", "n", F.coalesce("component_id", "doc").alias("component_id"))
    return found.unionByName(rows.where("n = 0").select("doc", "n", F.col("doc").alias("component_id"))).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _apart(members: DataFrame, found: DataFrame, turn: int) -> DataFrame:
    """(sig, s, e, root, sa, of) of the buckets that still hold several components: root is a set's component, sa and of are the delegate and its own.

    One exchange by signature serves the choice of delegates and the join with it."""
    both = members.join(small(found), "e", "left").select("sig", "s", "e", F.coalesce("root", "e").alias("root")).repartition("sig")
    delegate = F.min(F.struct(F.xxhash64("sig", "s", F.lit(turn)).alias("h"), F.col("s").alias("sa"), F.col("root").alias("of"), "e"))
    mixed = both.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), delegate.alias("d")).where("lo <> hi").select("sig", "d.sa", "d.of")
    return materialize(both.join(mixed, "sig").select("sig", "s", "e", "root", "sa", "of"), "jaccard-apart")


def keep_one(docs: DataFrame, k: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the least id (of equal ids, of the least text hash); columns as they are.

    Rows without a set all stay. The rows to drop are broadcast where they are few, else joined by a shuffle."""
    rows = labelled(docs, k, threshold, id_col, text_col).where("n > 0")
    d, t = unused(docs, "doc"), unused(docs, "th")
    best = rows.groupBy("root").agg(F.min(F.struct(F.isnull("doc"), "doc", "th")).alias("x"), F.count(F.lit(1)).alias("size")).where("size > 1").select("root", F.col("x.doc").alias("kd"), F.col("x.th").alias("kt"))
    many = materialize(rows.join(best, "root").select("doc", "th", "kd", "kt"), "jaccard-many")
    same = F.col("doc").eqNullSafe(F.col("kd")) & (F.col("th") == F.col("kt"))
    drop = many.where(~same).select(F.col("doc").alias(d), F.col("th").alias(t)).distinct()
    again = many.where(same).groupBy(F.col("doc").alias(d), F.col("th").alias(t)).agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(d, t)  # rows repeated with id and text
    drop, again = materialize(drop, "jaccard-drop"), materialize(again, "jaccard-again")
    keys = F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text_col) == F.col(t))
    kept = docs.join(small(drop), keys, "left_anti")
    if again.isEmpty():
        return kept
    once = docs.join(small(again), keys, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(small(again), keys, "left_anti").unionByName(once)
