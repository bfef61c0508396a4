import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from unitwise.llm import bpe, token_files
from unitwise.llm.common import shared_dir

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a  b\n c \x85x \x1c y", "ab" * 5000, " " * 300 + "x", "don't 12,5 <|endoftext|>", "Ünß ñ　é́", "same", "same", "\t\n \r\n  end "]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "n", "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, n_tokens string")


def test_encoding_equals_tiktoken():
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(7)
    letters = "abethoingx  \n\t'sZ19=-é中 \U0001f600"
    for text in [t or "" for t in TEXTS] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)]:
        ids = codec.encode(text)
        assert ids == theirs.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_round_trip_query(spark, docs):
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = codec.encode(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_then_decode(spark, docs):
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(ids, RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.bytes) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), bits, 1000) == ids).all()


def test_token_files(spark, docs):
    out = shared_dir(spark, "t")
    token_files.write(docs, out, JSON, 2)
    library = tokenizers.Tokenizer.from_file(JSON)
    want, start = {}, 0
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.digest(spark, out).collect()} == want
    full = {r.doc_id: r.ids for r in token_files.read(spark, out).collect()}
    assert full[6] == [*library.encode(TEXTS[6]).ids, 2] and 50256 in full[6]  # the library's own reading of a special token's string
    assert full[4] == [*library.encode(TEXTS[4]).ids, 2]
    path = spark.read.parquet(f"{out}/_manifest").orderBy("shard").first().path
    with open(path, "rb") as f:
        reader = token_files.ShardReader(f)
        assert reader.document(1).tolist() == full[int(reader.doc_ids[1])]


def test_token_files_of_null_and_repeated_ids_in_many_shards(spark):
    rows = [(None, "a b"), (3, "x <|endoftext|> y"), (None, None), (3, "x"), (1, "one two three " * 40), (2, "z" * 3000)]
    out = shared_dir(spark, "t")
    manifest = token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), out, JSON, 2, shard_ids=20)
    assert manifest.count() > 2 and manifest.agg(F.sum("n_docs"), F.sum("n_null")).first()[:] == (6, 2)
    library = tokenizers.Tokenizer.from_file(JSON)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in order]
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    want = [(i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), s, x in zip(order, starts, ids, strict=True)]
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.digest(spark, out).orderBy("start").collect() if r.doc_id) == sorted(w for w in want if w[0])
    assert [tuple(r)[:4] for r in token_files.digest(spark, out).orderBy("start").collect()] == want
    got = token_files.fetch(spark.createDataFrame([(3,), (1,), (9,)], "doc_id long"), out).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted((i, tuple(x)) for (i, _), x in zip(order, ids, strict=True) if i in (1, 3))


def test_compatibility_equals_merging_of_joined_bytes():
    codec, rng = bpe.codec(RANKS, public_tokenizers.PATTERN), random.Random(3)
    usable = [r for r, t in enumerate(codec.vocab) if len(t) == 1 or codec.halves[r]]
    known = set(usable)
    pairs = [(rng.choice(usable), rng.choice(usable)) for _ in range(4000)]
    near = [(codec.ranks[t[:k]], codec.ranks[t[k:]]) for t in codec.vocab for k in range(1, len(t)) if t[:k] in codec.ranks and t[k:] in codec.ranks]
    for left, right in pairs + [(a, b) for a, b in rng.sample(near, 4000) if a in known and b in known]:
        assert codec.compatible(left, right) == (codec.merged(codec.vocab[left] + codec.vocab[right]) == [left, right])


def test_chunk_ids_step_through_texts(spark):
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    import pyarrow as pa

    texts = ["", "a, b.  c", None, "word.) word.) x", " lead", "trail ", "a\n\nb c", "it's 5,5! été."] * 5
    small = bpe.ChunkIds(codec.chunks.encode, limit=4, tail=bpe.MARKS, step=10)
    for end in (None, 7):
        want = [codec.encode(t or "") + ([end] if end else []) for t in texts]
        assert [x.tolist() for x in small.ids(pa.array(texts, pa.string()), end)] == want
    assert list(small.ids(pa.array([], pa.string()))) == []


def test_empty_table(spark, docs):
    none = docs.where(F.lit(False))
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0
    out = shared_dir(spark, "t")
    token_files.write(none, out, JSON, 2)
    assert token_files.digest(spark, out).count() == 0
