"""Documents whose columns are named like the operators' own."""

from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, language_id, ngram_join, token_counts

TEXT = " ".join(f"word{i}" for i in range(40))
CLASH = "doc_id bigint, text string, _id string, _points int, _sha string, _gone bigint, n int, _row int, points int, root string"


def documents(spark):
    rows = [(1, TEXT), (2, TEXT), (3, TEXT + " more"), (4, "another text"), (5, None), (5, None)]
    return spark.createDataFrame([(i, t, "x", 1, "y", i, 2, 3, 4, "r") for i, t in rows], CLASH)


def test_keep_one_of_each(spark):
    docs = documents(spark)
    exact = exact_dedup.keep_one_of_each(docs)
    assert exact.columns == docs.columns
    assert sorted(r.doc_id for r in exact.collect()) == [1, 3, 4, 5]
    near = ngram_join.keep_one_of_each(docs)
    assert near.columns == docs.columns
    assert sorted(r.doc_id for r in near.collect()) == [1, 4, 5, 5]
    ids = docs.where("doc_id < 5")
    assert sorted(r.doc_id for r in ngram_join.keep_one_of_each(ids).collect()) == [1, 4]


def test_groups_named_like_the_curve(spark):
    docs = documents(spark).withColumns({"docs": F.col("n"), "n_tokens": F.col("_sha"), "docs_group": F.lit(1)})
    curve = token_counts.token_counts(docs, groups=["docs", "n_tokens", "docs_group"])
    assert {"docs_group", "n_tokens_group", "docs_group_group"} <= set(curve.columns)
    assert sum(r.docs for r in curve.collect()) == 6
    assert sum(r.docs for r in token_counts.token_counts(docs, groups=["text"]).collect()) == 6


def test_a_letter_beside_a_digit_sign_is_a_letter(spark):
    docs = spark.createDataFrame([(1, "x² + y²", "en"), (2, "² ³", "en"), (3, "the cat and the dog", "en"), (4, "der Hund und die Katze", "de")], "doc_id int, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert got[1] in ("en", "de") and got[2] == "und"
