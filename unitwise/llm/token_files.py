"""Token ids in fixed-width binary files.

A shard file holds the ids of a run of documents, ascending by document id:

    "UWTB" | version u16 | bits u16 | block_ids u32 | blocks ... | block_offsets i64[n_blocks]
    | doc_ids i64[n_docs] | doc_starts i64[n_docs + 1] | n_ids u64 | n_docs u64 | n_blocks u64 | n_null u64 | "UWTE"

A block stores `block_ids` ids (a multiple of 64; the last is padded with zeros) in `bits` bits each,
the fewest that hold the vocabulary's largest id, as little-endian 64-bit words: 64 ids fill exactly
`bits` words, so packing and unpacking are 64 vectorised shifts whatever the number of ids. Block
offsets and document starts give random access to one document without reading the rest.

Null texts are empty and hold the end id alone. Rows without an id come before all others; the first `n_null` documents
of a shard have none. Rows of equal ids follow each other, in the order of their texts. An empty table gives no files and
no rows. A task begins a new shard once the last holds `shard_ids` ids, so that a shard can be read whole by one task.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import MARKS, ChunkIds, encode_lines
from .common import ship

HEAD, TAIL = struct.Struct("<4sHHI"), struct.Struct("<QQQQ4s")
BLOCK_IDS = 4096


def width(vocabulary: int) -> int:
    """Bits that hold every id below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids, padded to a multiple of 64, as 64-bit words."""
    v = np.zeros(-(-len(ids) // 64) * 64, np.uint64)
    v[: len(ids)] = ids
    v = v.reshape(-1, 64)
    out = np.zeros((len(v), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= v[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - shift)
    return out.reshape(-1)


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    w = np.asarray(words, np.uint64).reshape(-1, bits)
    out, mask = np.empty((len(w), 64), np.uint32), np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = w[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | w[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = x & mask
    return out.reshape(-1)[:n]


class ShardWriter:
    """Streams documents into one shard; memory holds one block and the document index."""

    def __init__(self, sink, bits: int, block_ids: int = BLOCK_IDS):
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.at, self.offsets, self.doc_ids, self.starts = HEAD.size, [], [], [0]
        self.held: list[np.ndarray] = []
        self.n_held = self.n_null = 0
        sink.write(HEAD.pack(b"UWTB", 1, bits, block_ids))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.n_null += doc_id is None
        self.doc_ids.append(doc_id or 0)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 64 * self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        full = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        per_block = self.block_ids // 64 * self.bits * 8
        if full:
            data = pack(ids[:full], self.bits).astype("<u8").tobytes()
            for i in range(-(-full // self.block_ids)):
                self.offsets.append(self.at + i * per_block)
            self.sink.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[full:]], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        for x in (self.offsets, self.doc_ids, self.starts):
            self.sink.write(np.asarray(x, "<i8").tobytes())
        self.sink.write(TAIL.pack(self.starts[-1], len(self.doc_ids), len(self.offsets), self.n_null, b"UWTE"))


class ShardReader:
    """Reads a shard from anything with seek and read; only the index is held."""

    def __init__(self, source):
        self.source = source
        magic, _, self.bits, self.block_ids = HEAD.unpack(self._read(0, HEAD.size))
        size = source.seek(0, os.SEEK_END) if not hasattr(source, "size") else source.size()
        self.n_ids, n_docs, n_blocks, self.n_null, end = TAIL.unpack(self._read(size - TAIL.size, TAIL.size))
        if (magic, end) != (b"UWTB", b"UWTE"):
            raise ValueError("not a token shard")
        index = np.frombuffer(self._read(size - TAIL.size - 8 * (n_blocks + 2 * n_docs + 1), 8 * (n_blocks + 2 * n_docs + 1)), "<i8")
        self.offsets, self.doc_ids, self.starts = np.split(index, [n_blocks, n_blocks + n_docs])

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids in [start, stop) of the shard: whole blocks are read and unpacked at once."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        words_per_block = self.block_ids // 64 * self.bits
        n = min(self.n_ids, (last + 1) * self.block_ids) - first * self.block_ids
        raw = self._read(int(self.offsets[first]), ((last - first) * words_per_block + -(-(n - (last - first) * self.block_ids) // 64) * self.bits) * 8)
        return unpack(np.frombuffer(raw, "<u8"), self.bits, n)[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def find(self, doc_id: int) -> range:
        """The places of the documents of an id."""
        known = self.doc_ids[self.n_null :]
        a, b = np.searchsorted(known, doc_id, "left"), np.searchsorted(known, doc_id, "right")
        return range(int(a) + self.n_null, int(b) + self.n_null)

    def names(self) -> pa.Array:
        """The ids of all documents, null where they have none."""
        return pa.array(self.doc_ids, mask=np.arange(len(self.doc_ids)) < self.n_null)


class LibraryTokenizer:
    """The tokenizers library behind a memo of the chunks between spaces, where byte-level vocabularies split anyway.

    `special_as_text`: strings of special tokens in a text are ordinary text (the library's own default makes them ids)."""

    def __init__(self, path: str, special_as_text: bool = False, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.chunks = ChunkIds(encode_lines(self._library), limit, MARKS)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encode(self, texts: pa.Array, end: int | None = None) -> Iterator[np.ndarray]:
        """uint32 ids of each text, followed by `end`."""
        return self.chunks.ids(texts, end)


_tokenizers: dict[tuple[str, bool], LibraryTokenizer] = {}


def tokenizer(path: str, special_as_text: bool = False) -> LibraryTokenizer:
    if (path, special_as_text) not in _tokenizers:
        _tokenizers[path, special_as_text] = LibraryTokenizer(path, special_as_text)
    return _tokenizers[path, special_as_text]


_MANIFEST = "shard long, path string, n_docs long, n_null long, n_ids long, first_id long, last_id long"


def write(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 25_000_000, special_as_text: bool = False) -> DataFrame:
    """Encodes docs and writes shards into the folder `out`, ascending by id over the shards' numbers.

    The range exchange carries each text once and encoding follows it, so ids are made once. A task
    writes a shard under another name and renames it, so a repeated task leaves the same files.
    Returns the manifest: shard, path, n_docs, n_null, n_ids, first_id, last_id (null where no document has an id)."""
    spark = ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, folder = fs.FileSystem.from_uri(out)
        t, writer, rows = tokenizer(tokenizer_path, special_as_text), None, []
        bits = width(max(t.vocabulary, end_id + 1))
        temporary = f"{folder}/_shard-{part:06d}-{attempt}"

        def close() -> None:
            writer.close()
            writer.sink.close()
            shard = part << 20 | len(rows)
            final = f"{folder}/shard-{shard:014d}.uwt"
            store.move(temporary, final)
            named = writer.doc_ids[writer.n_null :]
            rows.append({"shard": shard, "path": final, "n_docs": len(writer.doc_ids), "n_null": writer.n_null, "n_ids": writer.starts[-1], "first_id": named[0] if named else None, "last_id": named[-1] if named else None})

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), t.encode(b.column(1), end_id), strict=True):
                if writer is None:
                    store.create_dir(folder, recursive=True)
                    writer = ShardWriter(store.open_output_stream(temporary), bits)
                writer.add(doc_id, ids)
                if writer.starts[-1] >= shard_ids:
                    close()
                    writer = None
        if writer is not None:
            close()
        kinds = pa.schema([(c.split()[0], pa.string() if c.split()[1] == "string" else pa.int64()) for c in _MANIFEST.split(", ")])
        yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    ordered = docs.select(F.col(id_col).cast("long"), text_col).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    ordered.mapInArrow(run, _MANIFEST).write.parquet(f"{out}/_manifest")
    return spark.read.parquet(f"{out}/_manifest")


def read(spark: SparkSession, out: str, id_col: str = "doc_id") -> DataFrame:
    """(shard, id, local_start, ids array<long>) of every document in the shards of a folder."""
    return _scan(spark, out, id_col, True)


def fetch(wanted: DataFrame, out: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<long>) of the documents of some ids: only the shards that can hold an id are opened, and only its blocks are read.

    The manifest, one row for a shard, is what the ids are joined with by range."""
    spark = ship(wanted.sparkSession)
    manifest = spark.read.parquet(f"{out}/_manifest").where("first_id is not null").select("path", "first_id", "last_id")
    asked = wanted.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    by_shard = asked.join(F.broadcast(manifest), F.col("id").between(F.col("first_id"), F.col("last_id"))).select("path", "id").repartition("path").sortWithinPartitions("path", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, opened, reader = fs.FileSystem.from_uri(out)[0], None, None
        for b in batches:
            names, ids = [], []
            for path, doc_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path != opened:
                    opened, reader = path, ShardReader(store.open_input_file(path))
                for i in reader.find(doc_id):
                    names.append(doc_id)
                    ids.append(reader.document(i).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=[id_col, "ids"])

    return by_shard.mapInArrow(run, f"`{id_col}` long, ids array<long>")


def digest(spark: SparkSession, out: str, id_col: str = "doc_id") -> DataFrame:
    """One row for each document as read back: id, start (ids of all documents before it), n_tokens, ids_crc32.

    Shards are numbered in the order of their ids, so starts are a running sum over the manifest (one row for a shard)."""
    manifest = spark.read.parquet(f"{out}/_manifest")
    before = manifest.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("before"))
    docs = _scan(spark, out, id_col, False)
    return docs.join(F.broadcast(before), "shard").select(id_col, (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", F.col("bits").alias("bits_per_id"))


def _scan(spark: SparkSession, out: str, id_col: str, with_ids: bool, step: int = 4_000_000) -> DataFrame:
    """Rows of every document; a shard's ids are unpacked some `step` at a time."""
    ship(spark)
    tail = "ids array<long>" if with_ids else "n_tokens long, ids_crc32 long, bits int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = int(path.rsplit("-", 1)[1].split(".")[0])
                r = ShardReader(pa.BufferReader(content.as_buffer()))
                names, start = r.names(), 0
                while start < len(names):
                    stop = max(start + 1, int(np.searchsorted(r.starts, r.starts[start] + step, "right")) - 1)
                    n, cuts = stop - start, r.starts[start : stop + 1]
                    ids = r.ids(int(cuts[0]), int(cuts[-1])).astype("<u4")
                    parts = [ids[x:y] for x, y in zip(cuts[:-1] - cuts[0], cuts[1:] - cuts[0], strict=True)]
                    first = [pa.array(np.full(n, shard)), names.slice(start, n), pa.array(cuts[:-1])]
                    if with_ids:
                        rest, of = [pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64()))], ["ids"]
                    else:
                        crc = [zlib.crc32(x.tobytes()) for x in parts]
                        rest, of = [pa.array(np.diff(cuts)), pa.array(crc, pa.int64()), pa.array(np.full(n, r.bits, np.int32))], ["n_tokens", "ids_crc32", "bits"]
                    yield pa.RecordBatch.from_arrays(first + rest, names=["shard", id_col, "local_start", *of])
                    start = stop

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.uwt").schema("path string, modificationTime timestamp, length long, content binary").load(out)
    return files.select("path", "content").mapInArrow(run, f"shard long, `{id_col}` long, local_start long, {tail}")
