"""A bitmap that lets almost all through gives the same hits, and judges each document row by itself, whatever its id."""

from collections import Counter

from unitwise.llm import decontaminate


def test_narrow_bitmaps_equal_wide_ones_on_null_and_repeated_ids(spark):
    items = [(i, " ".join(f"b{i}w{j}" for j in range(15))) for i in range(6)]
    clean = " ".join(f"c{j}" for j in range(30))
    rows = [(None, items[0][1]), (None, clean), (7, items[1][1] + " " + items[2][1]), (7, clean), (7, None), (8, items[3][1]), (8, items[3][1]), (9, "")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row_key int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = ({"map_bits": n} for n in (None, 3))
    want = Counter(map(tuple, decontaminate.report(docs, bench, **one).collect()))
    assert sum(want.values()) == len(rows) and Counter(map(tuple, decontaminate.report(docs, bench, **many).collect())) == want
    kept = decontaminate.keep_clean(docs, bench, **many)
    assert kept.columns == docs.columns
    assert sorted(r.row_key for r in kept.collect()) == sorted(r.row_key for r in decontaminate.keep_clean(docs, bench, **one).collect()) == [1, 3, 4, 7]


def test_items_without_an_id_hit_words(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, "clean words only")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), ("", passage)], "item_id string, text string")
    for map_bits in (None, 3):
        got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(docs, bench, map_bits=map_bits).collect()}
        assert got == {1: (20, 1, True), 2: (0, 0, False)}
        assert [r.doc_id for r in decontaminate.keep_clean(docs, bench.where("item_id is null"), map_bits=map_bits).collect()] == [2]
