"""Benchmark decontamination: which passages of benchmark items stand in documents.

Every run of 13 words of an item (a shorter item as a whole) is a window, a set of its three-word
shingles with their places. It is joined with the documents as a prefix-filtered set join:

1. Rarity. Item shingles are counted over all documents; a bitmap of item shingles keeps the others of a document
   from being sent. Shingles of a window are ordered by rarity.
2. Prefix. Containment has to be complete, so the necessary prefix of a window is its one rarest shingle. A
   document's shingles that pass the bitmap of prefixes are sent, each with the words a window around it can reach,
   and joined with the prefixes by shingle; salts deal a shingle that stands in very many documents over several tasks.
3. Bounds. A joined shingle fixes where the window would lie: it starts at or after the first word and ends by the last.
4. What is left is verified word by word, over that window only. Hits of a row are united.

Neither items nor their windows pass the driver; what is broadcast is a bitmap of 16 bits for each shingle, 2^30 bits at
most (beyond that it lets more through to the join, nothing is lost). Documents are scanned twice whatever the size of
the benchmark.

Null texts, texts without words and empty ones have no windows and no hits; an empty benchmark hits nothing, and an empty
table gives no rows. Repeated items count each by its item_id; words of items without an item_id are hit, but such items are
neither counted nor named. A document's repeated passages are all hit. Ties of rarity go to the smaller hash, then the
earlier place. Rows are told apart by a key of their own, so null and repeated ids stay apart; `keep_clean` judges equal texts
alike, which they are. Columns besides id and text are kept by `keep_clean` and not looked at, whatever their names. A long
text is one row; what is sent of it is by shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shingle_hashes, ship, word_hashes

#: Upper case to lower, and everything below 0x80 that is no letter or digit to a space.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WINDOW, SHINGLE = 13, 3
#: Tasks over which a shingle of very many documents is dealt; bits of the bitmap at most.
SALTS, MOST_BITS = 8, 30


def words_of(text: str | None) -> list[bytes]:
    r"""The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class Bitmap:
    """A set of hashes by their top bits: what is in the set passes, and a small share of all else."""

    def __init__(self, bits: int, chunks: dict[int, bytes]):
        self.shift, self.bits = np.uint64(64 - bits), bits
        self.map = np.zeros(max(1, 1 << bits >> 3), np.uint8)
        for at, data in chunks.items():
            self.map[at * CHUNK : at * CHUNK + len(data)] = np.frombuffer(data, np.uint8)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The places in `hashes` of what passes."""
        at = hashes >> self.shift
        return np.flatnonzero(self.map[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)


#: Bytes of a bitmap that one row carries.
CHUNK = 1 << 16


def _bitmap(hashes: DataFrame, bits: int | None = None) -> Bitmap:
    """The bitmap of a column h, made in pieces by tasks."""
    n = hashes.count()
    bits = bits or max(12, min(MOST_BITS, (16 * n).bit_length()))
    shift = np.uint64(64 - bits)

    def piece(table: pa.Table) -> pa.Table:
        at = table.column("h").to_numpy().view(np.uint64) >> shift
        data = np.zeros(min(CHUNK, 1 << bits >> 3), np.uint8)
        np.bitwise_or.at(data, (at >> np.uint64(3)).astype(np.int64) % CHUNK, np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        return pa.table({"piece": pa.array([table.column("piece")[0].as_py()], pa.int64()), "data": pa.array([data.tobytes()], pa.binary())})

    place = F.shiftrightunsigned("h", 64 - bits + 19) if bits > 19 else F.lit(0).cast("long")  # 8 bits in each of CHUNK bytes
    pieces = hashes.withColumn("piece", place).groupBy("piece").applyInArrow(piece, "piece long, data binary")
    return Bitmap(bits, {r["piece"]: r["data"] for r in pieces.toLocalIterator()})


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def _items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_key, item, words) of the items that have words, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [" ".join(w.decode("utf-8", "surrogatepass") for w in words_of(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.string())], names=["item_key", "item", "words"])

    keyed = items.select(F.monotonically_increasing_id().alias("item_key"), F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return materialize(keyed.mapInArrow(run, "item_key long, item string, words string").where("words <> ''"), "decontaminate-items")


def _item_shingles(items: DataFrame, window: int) -> DataFrame:
    """(item_key, k, h, place): the shingles of each item; those of an item of fewer than three words have all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.encode().split(b" ")
                k = min(SHINGLE, window, len(words))
                h = shingle_hashes(word_hashes(words), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), key)), pa.array(np.full(len(h), k, np.int32)), _signed(h), pa.array(np.arange(len(h)))], names=["item_key", "k", "h", "place"])

    return items.select("item_key", "words").mapInArrow(run, "item_key long, k int, h long, place long")


def _counts(docs: DataFrame, text_col: str, sizes: list[int], bitmap: Bitmap) -> DataFrame:
    """(k, h, n): how often shingles that pass the bitmap stand in the documents, over all of them."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for b in batches:
            held: dict[int, list[np.ndarray]] = {k: [] for k in sizes}
            for text in b.column(0).to_pylist():
                words = word_hashes(words_of(text))
                for k in sizes:
                    h = shingle_hashes(words, k)
                    held[k].append(h[bitmap.places(h)])
            for k, v in held.items():
                h, n = np.unique(np.concatenate(v), return_counts=True) if v else (np.empty(0, np.uint64), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), _signed(h), pa.array(n.astype(np.int64))], names=["k", "h", "n"])

    return docs.select(text_col).mapInArrow(run, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))


def _prefixes(items: DataFrame, shingles: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(k, h, item, offset, width, passage): each window of each item under its rarest shingle."""

    def choose(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("place").to_numpy())
        hashes, n = table.column("h").to_numpy()[order].view(np.uint64), table.column("n").to_numpy()[order]
        words, k = table.column("words")[0].as_py().split(" "), int(table.column("k")[0].as_py())
        width = min(window, len(words))
        span = width - k + 1
        rank = np.empty(len(hashes), np.int64)
        rank[np.lexsort((np.arange(len(hashes)), hashes, n))] = np.arange(len(hashes))
        offset = np.lib.stride_tricks.sliding_window_view(rank, span).argmin(1)
        starts = np.arange(len(offset))
        passages = [" ".join(words[i : i + width]) for i in starts.tolist()]
        same = lambda v, t: pa.array([v] * len(starts), t)
        return pa.table({"k": same(k, pa.int32()), "h": _signed(hashes[starts + offset]), "item": same(table.column("item")[0].as_py(), pa.string()), "offset": pa.array(offset.astype(np.int32)), "width": same(width, pa.int32()), "passage": pa.array(passages, pa.string())})

    counted = shingles.join(counts, ["k", "h"], "left").select("item_key", "k", "h", "place", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return counted.join(items, "item_key").groupBy("item_key").applyInArrow(choose, "k int, h long, item string, offset int, width int, passage string").distinct()


_STAGED = "row_key long, same long, id string, n_words long, k int, h long, at long, lead int, around string"


def _staged(docs: DataFrame, id_col: str, text_col: str, sizes: list[int], bitmap: Bitmap, window: int) -> DataFrame:
    """One row for each document (n_words; `same` is the hash of its text) and one for each shingle that passes the bitmap, with the words within a window's reach."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    names = [c.split()[0] for c in _STAGED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for b in batches:
            rows: list[tuple] = []
            for key, same, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                hashed = word_hashes(words)
                rows.append((key, same, doc_id, len(words), None, None, None, None, None))
                for k in sizes:
                    h = shingle_hashes(hashed, k)
                    for at in bitmap.places(h).tolist():
                        first = max(0, at - window + k)
                        rows.append((key, same, None, None, k, int(h[at].view(np.int64)), at, at - first, b" ".join(words[first : at + window]).decode("utf-8", "surrogatepass")))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    keyed = docs.select(F.monotonically_increasing_id(), F.xxhash64(F.coalesce(text_col, F.lit(""))), F.col(id_col).cast("string"), text_col)
    return materialize(keyed.mapInArrow(run, _STAGED), "decontaminate-shingles")


def _met(staged: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(row_key, same, start, end, item): windows that stand in documents, verified over their own words."""
    probes = staged.where("k IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int"))
    salted = prefixes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = probes.join(salted, ["k", "h", "salt"]).where("lead >= offset")  # the window starts at or after the first word in reach
    words = F.split("around", " ")
    inside = F.array_join(F.slice(words, F.col("lead") - F.col("offset") + 1, F.col("width")), " ")
    fits = (F.size(words) >= F.col("lead") - F.col("offset") + F.col("width")) & (inside == F.col("passage"))
    return joined.where(fits).select("row_key", "same", (F.col("at") - F.col("offset")).alias("start"), (F.col("at") - F.col("offset") + F.col("width")).alias("end"), "item")


_UNION = """aggregate(array_sort(s), cast(array() as array<struct<start:long,end:long>>), (a, x) ->
    CASE WHEN size(a) > 0 AND x.start <= element_at(a, -1).end
         THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end))))
         ELSE concat(a, array(x)) END)"""


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, map_bits: int | None) -> tuple[DataFrame, DataFrame]:
    """Staged documents, and (row_key, same, spans, items) of those with hits."""
    ship(docs.sparkSession)
    listed = _items(items, item_col, item_text_col)
    shingles = materialize(_item_shingles(listed, window), "decontaminate-item-shingles")
    wanted = shingles.select("k", "h").distinct()
    sizes = sorted(r["k"] for r in shingles.select("k").distinct().collect())  # 1, 2 and 3 at most
    counts = _counts(docs, text_col, sizes, _bitmap(wanted, map_bits)).join(wanted, ["k", "h"], "left_semi")
    prefixes = materialize(_prefixes(listed, shingles, counts, window), "decontaminate-prefixes")
    staged = _staged(docs, id_col, text_col, sizes, _bitmap(prefixes.select("h").distinct(), map_bits), window)
    met = _met(staged, prefixes).groupBy("row_key", "same").agg(F.collect_set(F.struct("start", "end")).alias("s"), F.array_sort(F.collect_set("item")).alias("items"))
    return staged, met.select("row_key", "same", F.expr(_UNION).alias("spans"), "items")


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, map_bits: int | None = None) -> DataFrame:
    """For each row of docs: id, n_words, spans (hit word ranges, merged, end exclusive), items (sorted item ids). map_bits: bits of the bitmaps' keys, by default after their size."""
    staged, met = _found(docs, items, id_col, text_col, item_col, item_text_col, window, map_bits)
    rows = staged.where("k IS NULL").select("row_key", F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words")
    none = F.expr("cast(array() as array<struct<start:long,end:long>>)")
    return rows.join(met.drop("same"), "row_key", "left").select(id_col, "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated (some word is hit, and at least one in twenty)."""
    found = hits(docs, items, id_col=id_col, **options)
    n_hit, contaminated = _judged()
    return found.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        contaminated.alias("contaminated"),
    )


def _judged() -> tuple[Column, Column]:
    """n_hit and contaminated, of a row of hits."""
    n_hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)")
    return n_hit, (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, map_bits: int | None = None) -> DataFrame:
    """The rows of docs that are not contaminated, columns as they are. Rows go by the hash of their text (64 bits), as equal texts are judged alike."""
    staged, met = _found(docs, items, id_col, text_col, item_col, item_text_col, window, map_bits)
    sizes = staged.where("k IS NULL").select("row_key", "n_words")
    bad = met.join(sizes, "row_key").where(_judged()[1]).select(F.col("same").alias("__same")).distinct()
    return docs.join(bad, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__same"), "left_anti")


def digest_of(items: list[str]) -> str:
    """The digest of item ids as `report` gives it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
