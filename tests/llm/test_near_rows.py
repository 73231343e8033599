import corpus_pipeline


def test_near_copies_go_by_row_where_identifiers_repeat(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b + " more"), (4, "x y z"), (4, "x y z")], "doc_id long, text string")
    got = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted(tuple(r) for r in got) == [(1, a), (2, b), (4, "x y z")]
    once = spark.createDataFrame([(1, a), (2, a), (3, b)], "doc_id long, text string")
    assert sorted(tuple(r) for r in corpus_pipeline.near_copies(spark, once, "").collect()) == [(1, a), (3, b)]
