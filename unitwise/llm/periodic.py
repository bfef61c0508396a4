r"""Runs of repeated words in documents: every maximal stretch of a smallest period q that holds at least four periods.

The words [^\x20\x09-\x0D]+ of a text are numbered from 0. A run of period q is a stretch of consecutive words in which
words q apart are identical, whose smallest period is q, of at least max(least, copies * q) words, that no neighbouring
word extends. Periods are taken by octave: B <= q < 2B for B = 1, 2, 4, ... Every B-th word of a document is a boundary.

1. Tiles. A run's matches (words equal to the word q later) number at least 3q >= 3B, so some boundary has B-word blocks
   before or after it that recur q words later, two blocks in a row. Rolling hashes over all boundaries and all q of
   the octave find these boundaries without a miss; a false one only costs work. They are exploded as overlapping tiles
   of `TILE` words or 8B, each with the margin its boundaries can look at, so that a long document becomes many rows.
2. Tiles are solved apart: at a boundary the Z function of the words after it tells for each q how far they agree with
   the words q later, that of the reversed words how far the words before do. Both are cut at the margin.
3. The fragments are exchanged by document and period, and those that touch are stitched to whole matches; a stretch
   found with several periods keeps the least.

Only documents with a tile are carried through the exchanges, as words; the others are done in the pass over the texts.

Null texts and texts without words have no runs. Copies of rows, of ids and null ids are rows of their own. An empty table
gives no rows. Columns besides id and text are not looked at, whatever their names. The length of a text is bounded only
by what a row can hold; tiles are rows of at most 8B + 5B words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import materialize, mix64, ship, steps

LEAST, COPIES = 6, 4
TILE = 256
#: Words whose gates are computed together, and the distinct words at which the numbering starts anew.
GROUP_WORDS, MOST_CODES = 1 << 20, 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1

_STAGE = "row_key long, id string, n long, words string, collapsed string, octave int, at long, marks array<int>, codes array<int>"
_ARROW = pa.schema([("row_key", pa.int64()), ("id", pa.string()), ("n", pa.int64()), ("words", pa.string()), ("collapsed", pa.string()), ("octave", pa.int32()), ("at", pa.int64()), ("marks", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32()))])


class Codes(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def z_function(x: list[int]) -> list[int]:
    """z[i]: how many items from i on agree with the beginning of x (z[0] = len(x))."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        if i < right:
            known = z[i - left]
            if known < right - i:
                z[i] = known
                continue
            j = right
        else:
            j = i
        while j < n and x[j] == x[j - i]:
            j += 1
        z[i] = j - i
        left, right = i, j
    return z


def octaves(n: int, copies: int = COPIES) -> int:
    """How many octaves of periods a text of n words can have runs in."""
    return max(0, n // copies).bit_length()


def boundaries(codes: np.ndarray, n_octaves: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each octave the multiples b of B with two neighbouring B-word blocks at b - B, b or b, b + B that recur q later, B <= q < 2B.

    Blocks are compared by polynomial hashes modulo 2^64, so a few may be too many, none is missing."""
    pad = 3 << n_octaves
    padded = np.concatenate((codes.astype(np.int64), -(1 << 40) - np.arange(pad, dtype=np.int64)))
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(padded) - 1, BASE, np.uint64))))
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(padded.view(np.uint64)) * power)))
    for k in range(n_octaves):
        size = 1 << k
        blocks = prefix[size:] - prefix[:-size]
        n = len(codes) // size
        if n < 2:
            continue
        recurs = blocks[: n * size : size, None] * power[None, size : 2 * size] == blocks[size : (n + 1) * size].reshape(n, size)
        two = (recurs[:-1] & recurs[1:]).any(axis=1)
        marked = np.zeros(n, bool)
        marked[:-1] |= two
        marked[1:] |= two
        yield k, np.flatnonzero(marked) * size


def tiles(codes: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(document, octave, first word, boundaries from there, words) for documents that stand one after the other in `codes`.

    `cuts` holds their bounds; between two documents stands one code that occurs once."""
    sizes = np.diff(cuts) - 1
    for k, at in boundaries(codes, octaves(int(sizes.max(initial=0)))):
        if not len(at):
            continue
        block, tile = 1 << k, max(TILE, 8 << k)
        doc = np.searchsorted(cuts, at, "right") - 1
        new = np.flatnonzero(np.diff(np.stack((doc, (at - cuts[doc]) // tile)), axis=1).any(axis=0)) + 1
        for part in np.split(np.arange(len(at)), new):
            d = int(doc[part[0]])
            start, stop = int(cuts[d]), int(cuts[d] + sizes[d])
            first = max(start, int(at[part[0]]) - block)
            yield d, k, first - start, (at[part] - first).astype(np.int32), codes[first : min(stop, int(at[part[-1]]) + 4 * block)]


def solve(octave: int, marks: list[int], words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of stretches of words equal to the word a period later, within one tile."""
    block, n = 1 << octave, len(words)
    open_at: dict[int, list[int]] = {}
    for b in marks:
        ahead = z_function(words[b : b + 4 * block])
        near = [q for q in range(block, min(2 * block, len(ahead))) if ahead[q] >= block]
        if not near:
            continue
        low, high = max(0, b - block), min(n, b + 2 * block)
        before = words[low:b][::-1]
        behind = z_function([*before, -1, *words[low:high][::-1]])
        for q in near:
            left, right = behind[len(before) + high - b - q + 1], min(ahead[q], 2 * block)
            if left < block and right < 2 * block:
                continue
            last = open_at.get(q)
            if last and b - left <= last[1]:
                last[1] = max(last[1], b + right)
            else:
                if last:
                    yield q, last[0], last[1]
                open_at[q] = [b - left, b + right]
    for q, (s, e) in open_at.items():
        yield q, s, e


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _staged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (words where a tile was made, the digest of all words elsewhere) and rows of tiles."""

    def group(docs: list[tuple], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cuts = np.concatenate(([0], np.cumsum([len(c) for c in codes], dtype=np.int64)))
        rows, loud = {name: [] for name in _ARROW.names}, set()
        held = 0
        for d, octave, at, marks, words in tiles(np.concatenate(codes), cuts):
            loud.add(d)
            for name, value in zip(_ARROW.names, (docs[d][0], None, None, None, None, octave, at, marks, words), strict=True):
                rows[name].append(value)
            held += len(words)
            if held > GROUP_WORDS:
                yield pa.RecordBatch.from_pydict(rows, _ARROW)
                rows, held = {name: [] for name in _ARROW.names}, 0
        for d, (key, doc_id, words) in enumerate(docs):
            text = b" ".join(words).decode() if d in loud else None
            for name, value in zip(_ARROW.names, (key, doc_id, len(words), text, None if d in loud else _digest(words), None, None, None, None), strict=True):
                rows[name].append(value)
        yield pa.RecordBatch.from_pydict(rows, _ARROW)

    numbers, docs, codes, held = Codes(), [], [], 0
    for b in batches:
        keys, ids, place = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
        for part in steps(b.column(2), 4_000_000):
            for text in part.cast(pa.large_binary()).to_pylist():
                words = text.split()
                code = np.empty(len(words) + 1, np.int32)
                code[:-1] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                code[-1] = -1 - len(docs)
                docs.append((keys[place], ids[place], words))
                codes.append(code)
                held, place = held + len(code), place + 1
                if held > GROUP_WORDS:
                    yield from group(docs, codes)
                    docs, codes, held = [], [], 0
                    if len(numbers) > MOST_CODES:
                        numbers.clear()
    if docs:
        yield from group(docs, codes)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(key, q, at + s, at + e) for key, octave, at, marks, words in zip(*(c.to_pylist() for c in b.columns), strict=True) for q, s, e in solve(octave, marks, words)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((),) * 4)], names=["row_key", "period", "s", "e"])


def _stage(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    keyed = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return materialize(keyed.mapInArrow(_staged, _STAGE), "periodic")


def _runs(staged: DataFrame) -> DataFrame:
    """(row_key, start, length, period) of the runs of staged documents."""
    n = int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that small tiles of much work are not put together
    tiled = staged.where("octave IS NOT NULL").select("row_key", "octave", "at", "marks", "codes").repartition(n, "row_key", "octave", "at")
    fragments = tiled.mapInArrow(_solved, "row_key long, period long, s long, e long")
    by = Window.partitionBy("row_key", "period").orderBy("s", "e")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = fragments.withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1)).withColumn("part", F.sum("new").over(by))
    matches = cut.groupBy("row_key", "period", "part").agg(F.min("s").alias("start"), (F.max("e") - F.min("s") + F.col("period")).alias("length"))
    return matches.where(F.col("length") >= F.greatest(F.lit(LEAST), COPIES * F.col("period"))).groupBy("row_key", "start", "length").agg(F.min("period").alias("period"))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, period): a row for each run; word numbers from 0."""
    staged = _stage(docs, id_col, text_col)
    named = staged.where("octave IS NULL AND words IS NOT NULL").select("row_key", F.col("id").cast(docs.schema[id_col].dataType).alias(id_col))
    return named.join(_runs(staged), "row_key").drop("row_key")


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that a run (start, length, period) holds after its first period."""
    kept = bytearray(b"\1") * len(words)
    for start, length, period in found:
        kept[start + period : start + length] = bytes(length - period)
    return [w for w, k in zip(words, kept, strict=True) if k]


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run (start, length, period) of the greatest length/period; ties: least start, then period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


_RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_NONE = hashlib.sha256(b"").hexdigest()


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", *(p.split()[0] for p in _RESULT.split(", "))]
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
    for b in batches:
        rows = []
        for doc_id, words, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
            split = words.encode().split(b" ")
            found = [(r["start"], r["length"], r["period"]) for r in found or ()]
            start, length, period = best(found) if found else (None, None, None)
            text = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(found, key=lambda r: (r[0], r[2])))
            rows.append((doc_id, len(found), start, length, period, 1000 * length // period if found else None, hashlib.sha256(text.encode()).hexdigest(), _digest(collapsed(split, found))))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names=names)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_runs, the run of the greatest length/period (four nulls without runs), digests of the runs and of the words that stay."""
    staged = _stage(docs, id_col, text_col)
    of_docs = staged.where("octave IS NULL")
    none = [F.lit(0).cast("long").alias("n_runs"), *[F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")], F.lit(_NONE).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256")]
    quiet = of_docs.where("words IS NULL").select("id", *none)
    found = _runs(staged).groupBy("row_key").agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))
    loud = of_docs.where("words IS NOT NULL").select("row_key", "id", "words").join(found, "row_key", "left").select("id", "words", "found")
    out = quiet.unionByName(loud.mapInArrow(_reported, f"id string, {_RESULT}"))
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a period planted: of documents whose crc32(decimal id) ends in 0, each word i >= a becomes word a + (i - a) % p.

    With n words and g = crc32 div 10: a = g % n, p = 1 + floor((n - a) / (3 + g % 8)). Other texts, also those without an id, stay."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def turned(s: Column) -> Column:
        n = F.size(s["w"])
        a = F.pmod(s["g"], n)
        return let(lambda t: F.array_join(F.transform(F.sequence(F.lit(0), F.size(t["w"]) - 1), lambda i: F.get(t["w"], F.when(i < t["a"], i).otherwise((t["a"] + F.pmod(i - t["a"], t["p"]))).cast("int"))), " "), w=s["w"], a=a, p=1 + F.floor((n - a) / (3 + F.pmod(s["g"], F.lit(8)))))

    edited = let(lambda s: F.when(F.size(s["w"]) > 0, turned(s)), w=words, g=F.floor(h / 10))
    return F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(edited, text)).otherwise(text)
