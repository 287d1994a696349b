from gleanline.llm import mixture as X


def test_a_text_takes_the_source_of_its_first_copy_that_has_one(spark):
    rows = [(1, None, "one text"), (2, "blog", "one text"), (3, "chat", "one text"), (4, None, "no source"), (5, None, "no source"), (6, "blog", "other")]
    texts = {r.doc_id: r.source for r in X.texts_of(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()}
    assert texts == {2: "blog", 4: None, 6: "blog"}


def test_rests_are_flown_again_until_one_bucket_holds_them(spark):
    rows = [(i, "s", i % 37 + 1) for i in range(3000)]
    texts = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens int")
    targets = spark.createDataFrame([("m", "s", 1.0, 1), ("m", "t", 1.0, 1)], "mix_name string, source string, weight double, max_uses int")
    both = texts.unionByName(spark.createDataFrame([(9000 + i, "t", 10) for i in range(1500)], texts.schema))
    planned = X.plan(both, targets)
    want = {r.source: r.target_tokens for r in planned.collect()}
    got = {r.source: r.t for r in X.chosen(both, planned, bucket=16).groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "t").collect()}
    assert all(abs(got[s] - want[s]) <= 0.01 * want[s] for s in want)
