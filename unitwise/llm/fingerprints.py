"""Document fingerprints from closed syncmers, and how alike two fingerprints are.

A k-mer of code points is an anchor if the least hash among its s-mers stands at its first or last place. The choice looks
at nothing outside the k-mer, so a passage has the same anchors in whatever text it stands, and no k - s + 1 k-mers in a row
are without one. A fingerprint holds each distinct anchor's hash with the place where it first occurs, all of them in
`report` and `fingerprint` unless `most` is given: then a text of more distinct anchors keeps those whose hash ends in enough zero bits
(but one at least), again a choice by the anchor alone, so two fingerprints can be compared on what both kept. The whole text is read in any case. A text without
an anchor (all shorter than k are) has its own hash as the only one; an empty text has none.

As text an anchor takes 7 characters, 42 bits of its hash and the step to its place, since fingerprints are many times as large
as the texts' files. Two different anchors have one hash once in 4e12 pairs, so comparing texts of 2,000 anchors goes
wrong by one of them once in a million times.

Likeness matches anchors by hash and keeps the longest chain of matches that stand in the same order in both texts:
2 * chain / (anchors of one + anchors of the other), at the coarser of the two selections. Equal texts have equal
fingerprints and likeness 1, two empty texts too.

Null texts count as empty. Copies of rows, of ids and null ids (these come first in the order) are rows of their own;
rows of one id stand in the order of a hash of their texts. An empty table gives no rows, and columns besides id and
text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, ship, steps

K, S, MOST = 9, 4, 256
BASE = np.uint64(0x9E3779B97F4A7C15)
BITS, NEAR, WIDTH, FAR_WIDTH = 42, 6, 7, 5  # bits of a hash; the largest step to the next place that is written with it; characters of both, and of a larger step
DIGITS = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%&()*+-;<=>?@^_`{|}~", np.uint8)
VALUES = np.zeros(256, np.uint64)
VALUES[DIGITS] = np.arange(len(DIGITS))
Mark = tuple[int, np.ndarray, np.ndarray]  # level, hashes and places of a fingerprint, in the order of places


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of an array of code points."""
    n = len(points) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inner = np.zeros(len(points) - s + 1, np.uint64)
    for i in range(s):
        inner = inner * BASE + points[i : i + len(inner)]
    inner = mix64(inner)
    least = window_least(inner, k - s + 1)
    at = np.flatnonzero((least == inner[:n]) | (least == inner[k - s : k - s + n]))
    whole = np.zeros(len(at), np.uint64)
    for i in (*range(0, k - s, s), k - s):  # s-mers that cover the k-mer
        whole = mix64(whole * BASE + inner[at + i])
    return at, whole


def _digits(numbers: np.ndarray, width: int) -> str:
    """Each number in so many digits of base 85."""
    base, out = np.uint64(len(DIGITS)), np.empty((len(numbers), width), np.uint8)
    for i in reversed(range(width)):
        rest = numbers // base
        out[:, i] = DIGITS[numbers - rest * base]
        numbers = rest
    return out.tobytes().decode()


def _numbers(digits: str, width: int) -> np.ndarray:
    values, out = VALUES[np.frombuffer(digits.encode(), np.uint8)].reshape(-1, width), np.uint64(0)
    for i in range(width):
        out = out * np.uint64(len(DIGITS)) + values[:, i]
    return out


def written(marks: list[Mark]) -> list[str]:
    """Fingerprints as text: the level, an anchor after the other (7 times its hash, and its step from the place before if that is at most NEAR), the larger steps."""
    ends = np.cumsum([0, *(len(hashes) for _, hashes, _ in marks)])
    hashes = np.concatenate([np.empty(0, np.uint64), *(h for _, h, _ in marks)])
    places = np.concatenate([np.empty(0, np.int64), *(p for _, _, p in marks)])
    step, starts = np.diff(places, prepend=0), ends[:-1][np.diff(ends) > 0]
    step[starts] = places[starts] + 1
    far = step > NEAR
    near = _digits(hashes * np.uint64(NEAR + 1) + np.where(far, 0, step).astype(np.uint64), WIDTH)
    larger, cuts = _digits(step[far].astype(np.uint64), FAR_WIDTH), np.concatenate(([0], np.cumsum(far)))[ends] * FAR_WIDTH
    ends, cuts = (ends * WIDTH).tolist(), cuts.tolist()
    return [f"{level}.{near[ends[d] : ends[d + 1]]}.{larger[cuts[d] : cuts[d + 1]]}" for d, (level, _, _) in enumerate(marks)]


def parsed(fingerprint: str) -> Mark:
    """Level, hashes and places of a fingerprint, in the order of places."""
    level, near, larger = fingerprint.split(".")
    hashes, step = np.divmod(_numbers(near, WIDTH), np.uint64(NEAR + 1))
    step = step.astype(np.int64)
    step[step == 0] = _numbers(larger, FAR_WIDTH)
    return int(level), hashes, np.cumsum(step) - 1


def _firsts(hashes: np.ndarray) -> np.ndarray:
    """Whether each hash, of BITS bits, is the first of its kind."""
    first, low = np.zeros(len(hashes), bool), np.uint64(64 - BITS)
    if len(hashes) >> int(low):
        first[np.unique(hashes, return_index=True)[1]] = True
        return first
    both = (hashes << low) | np.arange(len(hashes), dtype=np.uint64)
    both.sort()
    new = np.diff(both >> low, prepend=~np.uint64(0)) != 0
    first[both[new] & np.uint64((1 << int(low)) - 1)] = True
    return first


def marks(texts: list[str], k: int = K, s: int = S, most: int | None = MOST) -> list[Mark]:
    """The fingerprint of each text, not yet written. The texts are read as one array, so call it with some megabytes at a time."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends, kept_bits = np.cumsum(sizes), np.uint64((1 << BITS) - 1)
    at, hashes = anchors(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64), k, s)
    doc = np.searchsorted(ends, at, "right")
    inside = at + k <= ends[doc] if len(at) else np.empty(0, bool)
    at, hashes, doc = at[inside], hashes[inside] & kept_bits, doc[inside]
    cuts, out = np.searchsorted(doc, np.arange(len(texts) + 1)), []
    for d, text in enumerate(texts):
        mine, places, level = hashes[cuts[d] : cuts[d + 1]], at[cuts[d] : cuts[d + 1]], 0
        if not len(mine):
            mine = np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))] if text else [], np.uint64) & kept_bits
            places = np.zeros(len(mine), np.int64)
        else:
            first = _firsts(mine)
            mine, places = mine[first], places[first] - (ends[d] - sizes[d])
            if most is not None and len(mine) > most:
                zeros = mine & (~mine + np.uint64(1))  # the lowest bit that is set
                while len(mine) > most and (kept := (zeros >= np.uint64(2 << level)) | (zeros == 0)).any():
                    level, mine, places, zeros = level + 1, mine[kept], places[kept], zeros[kept]
        out.append((level, mine, places))
    return out


def fingerprints(texts: list[str], k: int = K, s: int = S, most: int | None = MOST) -> list[str]:
    """The fingerprint of each text. The texts are read as one array, so call it with some megabytes at a time."""
    return written(marks(texts, k, s, most))


def chain(places: list[int]) -> int:
    """The length of the longest increasing choice of these numbers."""
    tails: list[int] = []
    for p in places:
        i = bisect_left(tails, p)
        tails[i : i + 1] = [p]
    return len(tails)


def common(a: Mark, b: Mark) -> float:
    """The share of anchors that two different fingerprints have in common in the same order."""
    (level_a, hashes_a, places_a), (level_b, hashes_b, places_b) = a, b
    mask = np.uint64((1 << max(level_a, level_b)) - 1)
    if level_a != level_b:
        kept_a, kept_b = hashes_a & mask == 0, hashes_b & mask == 0
        hashes_a, places_a, hashes_b, places_b = hashes_a[kept_a], places_a[kept_a], hashes_b[kept_b], places_b[kept_b]
    total = len(hashes_a) + len(hashes_b)
    if not total:
        return 0.0
    _, in_a, in_b = np.intersect1d(hashes_a, hashes_b, assume_unique=True, return_indices=True)
    if not len(in_a):
        return 0.0
    return 2 * chain(places_b[in_b[np.argsort(places_a[in_a])]].tolist()) / total


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of anchors that two fingerprints have in common in the same order."""
    return 1.0 if a == b else common(parsed(a), parsed(b))


def fingerprint(text: Column, k: int = K, s: int = S, most: int | None = None) -> Column:
    """The fingerprint of a column of texts."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([f for part in steps(pa.array(texts, pa.string()), 4_000_000) for f in fingerprints(part.to_pylist(), k, s, most)], dtype=object)

    return of(text)


def alike(a: Column, b: Column) -> Column:
    """The likeness of two columns of fingerprints."""

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return of(a, b)


def _place(doc_id, h: int) -> tuple:
    return (doc_id is not None, doc_id if doc_id is not None else 0, h)


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, ahead, id, text): the rows dealt to buckets of neighbours in the order of ids, sorted; each bucket ends with the row after it (ahead).

    The bounds are the least (id, hash of the text) of each range, one for a bucket; these rows go to the bucket before too, the
    least of all to the last. So the texts are exchanged once, and no row needs to know more than its own bucket."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    order = F.col(id_col).cast("long" if number else "string")
    keyed = docs.select(F.col(id_col).alias("id"), order.alias("o"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    firsts = keyed.select("o", "h").repartitionByRange(n, "o", "h").withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.min(F.struct("o", "h")).alias("first"))
    bounds = sorted(_place(r["first"]["o"], r["first"]["h"]) for r in firsts.collect())

    @F.pandas_udf("array<int>")
    def buckets(ids: pd.Series, hashes: pd.Series) -> pd.Series:  # ids as text: pandas would turn numbers beside nulls into floating point
        out = []
        for i, h in zip(ids, hashes, strict=True):
            place = _place(int(i) if number and i is not None else i, h)
            own = bisect_right(bounds, place) - 1
            out.append([own, (own - 1) % len(bounds)] if bounds[own] == place else [own])
        return pd.Series(out)

    dealt = keyed.withColumn("to", buckets(F.col("o").cast("string"), "h")).select(F.posexplode("to").alias("ahead", "bucket"), "id", "o", "h", "text")
    return dealt.repartitionById(max(1, len(bounds)), F.col("bucket")).sortWithinPartitions("bucket", "ahead", "o", "h").select("bucket", "ahead", "id", "text")


def edited(text: str, after: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the beginning of the next one."""
    cut = len(text) // 2
    return text[: len(text) - cut] + after[:cut]


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, most: int | None = None) -> DataFrame:
    """Per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is `edited` of the text and the next document's in the order of ids (after the last: the first)."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(p.split()[0] for p in _RESULT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose next is still to come: bucket, ahead, text, fingerprint unwritten and written
        held_id = None
        for b in batches:
            buckets, ahead, place = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
            for part in steps(b.column(3), 1_000_000):  # so few that all anchors of the texts and their edited forms stay small
                texts = part.to_pylist()
                own_marks = marks(texts, k, s, most)
                rows = list(zip(buckets[place : place + len(texts)], ahead[place : place + len(texts)], texts, own_marks, written(own_marks), strict=True))
                ids = b.column(2).slice(place, len(texts))
                if held is not None:
                    rows.insert(0, held)
                    ids = pa.concat_arrays([held_id, ids])
                place += len(texts)
                own = [i for i in range(len(rows) - 1) if not rows[i][1]]
                new = [edited(rows[i][2], rows[i + 1][2]) for i in own]
                new_marks = marks(new, k, s, most)
                new_written = written(new_marks)
                yield pa.RecordBatch.from_arrays(
                    [
                        pc.take(ids, pa.array(own, pa.int64())),
                        pa.array([len(rows[i][2]) for i in own], pa.int64()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
                        pa.array([rows[i][4] for i in own], pa.string()),
                        pa.array(new_written, pa.string()),
                        pa.array([1.0 if rows[i][4] == w else common(rows[i][3], m) for i, m, w in zip(own, new_marks, new_written, strict=True)], pa.float64()),
                        pa.array([1.0 if rows[i][4] == rows[i + 1][4] else common(rows[i][3], rows[i + 1][3]) for i in own], pa.float64()),
                    ],
                    names=names,
                )
                held, held_id = rows[-1], ids.slice(len(ids) - 1)

    return in_order(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {_RESULT}")
