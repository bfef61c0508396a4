"""The pipeline's stages and whole run against plain functions, on rows with nulls, empty texts and repeats."""

import hashlib
import random

import public_tokenizers
import pytest

import corpus_pipeline
from unitwise.llm import bpe, pii


def words(rng, n):
    return " ".join(f"{rng.choice('bcdfgh')}{rng.randint(0, 10**5)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    out = tmp_path_factory.mktemp("corpus")
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        text = words(rng, 40 if toxic else rng.choice([40, 40, 400, 1500])) + (" idiot moron scum idiot" * 2 if toxic else "")
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, 1, int(toxic)))
    passage = words(rng, 30)
    base = rows[1][1]
    special = [
        (400, None), (401, ""), (402, base), (403, base + " tail"), (404, f"see {passage} here"), (405, passage.upper()),
        (406, "mail me at jane.roe@example.org or +1 555 201 9876 " + words(rng, 30)), (407, None), (None, words(rng, 20)), (408, base), (408, base),
        (409, words(rng, 1500)), (410, "\t \n"),
    ]
    rows += [(i, t, "en", "b", len(t or "")) for i, t in special]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([("q1", passage), (None, None), ("q2", "")], "item_id string, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_run(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, folder).collect()
    ids = [r.doc_id for r in got]
    clean = {i for i in range(300) if i % 5}
    assert len([i for i in ids if i is not None and i < 300 and i % 5 == 0]) <= 3  # toxic ones go
    assert clean <= set(ids)
    assert set(ids) - set(range(300)) == {400, 401, 406, 407, None, 409, 410}  # 402, 403, 408: copies; 404, 405: benchmark
    assert len(ids) == len(set(ids))
    codec = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in got:
        text = pii.masked(docs[r.doc_id]) or ""
        tokens = codec.encode(text)
        assert (r.n_tokens, r.decoded_sha256) == (len(tokens), hashlib.sha256(text.encode()).hexdigest())
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest()


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
