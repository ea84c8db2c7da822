"""One row of each near-duplicate group stays, also where ids are null or shared."""

from lodestrata.llm import simhash

A, B, C = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")


def kept(spark, *rows):
    return sorted(map(tuple, simhash.keep_one(spark.createDataFrame(list(rows), "doc_id long, text string, lang string")).collect()), key=str)


def test_null_ids(spark):
    # a group of null ids alone keeps one row, and lets no other group's null-id row stay
    assert kept(spark, (None, A, "en"), (None, A, "de"), (1, B, "en"), (None, B, "en")) == sorted([(None, A, "de"), (1, B, "en")], key=str)


def test_shared_ids(spark):
    # doc 5 is the least of its group with C; its other text is a near copy of doc 2's
    assert kept(spark, (5, C, "en"), (5, A, "en"), (2, A, "en"), (3, B, "en"), (3, B, "en")) == sorted([(5, C, "en"), (2, A, "en"), (3, B, "en")], key=str)


def test_columns_without_an_order(spark):
    docs = spark.createDataFrame([(1, "a b c d e", {"k": 2}, None), (1, "a b c d e", {"k": 1}, "x"), (None, None, None, None), (None, None, {}, None)], "doc_id long, text string, more map<string,int>, extra string")
    out = sorted(simhash.keep_one(docs).collect(), key=str)
    assert [(r.doc_id, r.text) for r in out] == [(1, "a b c d e"), (None, None)]
    assert out[0].more == {"k": 1}
