"""The end of texts counts whatever its rank; learned operators over empty tables."""

import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from unitwise.llm import language, lm_scoring, secret_scan


def score(docs, **options):
    return lm_scoring.score(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, **options)


def test_the_end_is_known_below_the_frequent_words(spark):
    words = [f"w{i}" for i in range(300)]
    text = " ".join(words + words[:150])  # 150 words are more frequent than the one end
    docs = spark.createDataFrame([(0, text, True), (1, "w1 w299 new", False), (2, None, False)], "doc_id long, text string, learn boolean")
    got = {r["doc_id"]: r for r in score(docs, learn_from=F.col("learn"), frequent=100).collect()}
    n, v = 451, 301
    log = lambda c: math.log10((c + 1) / (n + v + 1))
    assert got[0]["n_known"] == got[0]["n_tokens"] == 451 and got[0]["train_tokens"] == n
    assert got[0]["base_score"] == pytest.approx(sum(log(2 if i < 150 else 1) for i in range(300)) + sum(log(2) for _ in range(150)) + log(1))
    assert (got[1]["n_known"], got[1]["n_tokens"]) == (3, 4) and got[1]["base_score"] == pytest.approx(log(2) + log(1) + log(0) + log(1))
    assert (got[2]["n_known"], got[2]["n_tokens"]) == (1, 1) and got[2]["base_score"] == pytest.approx(log(1))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "text", "en")], "doc_id long, text string, lang string").where("doc_id > 5")
    assert score(docs).collect() == []
    assert language.report(docs).collect() == []
    assert secret_scan.report(docs).collect() == []


def test_every_text_to_learn_from_moves_the_weights(spark):
    n, size = 60, 200  # each text has two ids of its own
    texts = [np.array([2 * i, 2 * i + 1, 2 * i, size - 1], "<u2") for i in range(n)]
    docs = spark.createDataFrame([(i, bytes(t.tobytes())) for i, t in enumerate(texts)], "id long, ids binary").repartition(3)
    counts = np.bincount(np.concatenate(texts), minlength=size).astype(float)
    around = np.ones((size, 2 * lm_scoring.BUCKETS))
    cls = lm_scoring.classes_of(counts, around)
    start = lm_scoring.Attention.new(size, cls, lm_scoring.within_class(counts, cls))
    got = lm_scoring.train(docs, counts, around, sample=2)
    assert (got.p["E"][: 2 * n] != start.p["E"][: 2 * n]).any(1).all()
