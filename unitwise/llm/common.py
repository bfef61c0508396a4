"""What the text operators share: the scratch folder, shipping of this package, folds and hashing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import shared_folder

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()

#: The characters with the Unicode property White_Space, as the inside of a character class.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers, unless their PYTHONPATH has it already."""
    sc = spark.sparkContext
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in on_path or sc.applicationId in _shipped:
        return spark
    package = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp()) / f"{package.name}-package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in package.rglob("*.py"):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that the driver and all executors see.

    Only in local mode a temporary folder may take its place; on a cluster the setting is required."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Writes a table to the shared folder (in folders by the columns `parts`) and reads it back: lineage ends there, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, name)
    if parts:
        conf, key = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
        before = conf.get(key)
        conf.set(key, "16")  # a file for each folder stays open, so that no task sorts its rows by folder
        df.write.option("parquet.block.size", 16 << 20).partitionBy(*parts).parquet(path)
        conf.set(key, before)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of written tables that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for path in {re.sub(r"(/[^/]*=[^/]*)*/[^/]*$", "", f) for f in df.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: Column | str, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    c = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_words(text: str | None) -> list[bytes]:
    r"""The words [^\x20\x09-\x0D]+ of a text in UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    kind = np.int32 if total < 1 << 31 and (not len(starts) or starts.max() < 1 << 30) else np.int64
    return np.repeat((starts - before).astype(kind), sizes) + np.arange(total, dtype=kind)


def steps(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """The texts in slices of about `size` bytes (one text at least); nulls as empty texts."""
    texts = pc.fill_null(texts, "")
    ends, start = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def coded_words(texts: pa.Array, size: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    r"""The words [^\x20\x09-\x0D]+ of texts, A-Z in lower case, for some texts at a time: hashes, a number into these for each word, the bounds of each text.

    What stands between spaces is told apart by Arrow's dictionary encoding, so that each distinct string is hashed once."""
    for part in steps(texts, size):
        split = pc.split_pattern(pc.ascii_lower(part), " ")
        n = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        words, sizes = _words_of(coded.dictionary)
        hashed, at = word_hashes(words), coded.indices.to_numpy()
        if len(sizes) and sizes.max() == 1 and sizes.min() == 1:
            yield hashed, at, np.concatenate(([0], np.cumsum(n)))
        else:
            length = sizes[at]
            yield hashed, spread((np.cumsum(sizes) - sizes)[at], length), np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(n)))]


def _words_of(strings: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The words of strings without spaces, one string after the other, and how many each has; only those with other white space, or empty, are split."""
    _, bounds, data = pc.cast(strings, pa.binary()).buffers()
    bounds = np.frombuffer(bounds, np.int32)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int32)
    raw, ends = data.to_pybytes() if data else b"", bounds.tolist()
    found = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    code, sizes = np.frombuffer(raw, np.uint8), np.ones(len(found), np.int64)
    white = np.searchsorted(bounds, np.flatnonzero((code >= 9) & (code <= 13)), "right") - 1
    odd = np.union1d(white[(white >= 0) & (white < len(found))], np.flatnonzero(bounds[1:] == bounds[:-1])).tolist()
    words, last = [], 0
    for i in odd:
        own = found[i].split()
        sizes[i] = len(own)
        words += found[last:i]
        words += own
        last = i + 1
    return words + found[last:], sizes


def hashed_words(texts: pa.Array, size: int = 2_000_000) -> Iterator[np.ndarray]:
    """The word hashes of each text, as `word_hashes(byte_words(text))` gives them."""
    for hashed, at, cuts in coded_words(texts, size):
        flat, cuts = hashed[at], cuts.tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield flat[a:b]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k words; order within a run counts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n] + np.uint64(i + 1))
    return h


def words_as_one(words: np.ndarray) -> np.ndarray:
    """The hash of a whole sequence shorter than a shingle, kept apart by its length from those of shingles."""
    h = np.uint64(len(words) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    with np.errstate(over="ignore"):
        for w in words:
            h = mix64(np.array([h * np.uint64(0x9E3779B97F4A7C15) + w]))[0]
    return np.array([h], np.uint64)


def most_frequent(counts: DataFrame, n: str, limit: int) -> DataFrame:
    """The rows whose count reaches the least level, in eighths of powers of two, that `limit` rows or fewer reach.

    Only the sizes of the levels come to the driver, some five hundred numbers at most; no task sends its own top rows."""
    level = F.floor(8 * F.log2(F.col(n).cast("double"))).cast("long")
    sizes = sorted(((r["level"], r["size"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("size")).collect()), reverse=True)
    kept, least = 0, None
    for at, size in sizes:
        if kept + size > limit:
            break
        kept, least = kept + size, at
    return counts.where(F.lit(False)) if least is None else counts.where(level >= least)
