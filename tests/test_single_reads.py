"""Expensive expressions stand once in the plan that Spark makes of them."""

from pyspark.sql import functions as F

from corpusloom.operators import locators, units


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_locator_reads_each_value_once(spark):
    df = spark.createDataFrame([(1, "pdf", '{"page_number": 3, "unit_type": " a ", "line_end": 0}')], "k int, file_type string, j string")
    out = locators.build_source_locator(df.withColumn("meta", F.parse_json("j")), F.col("file_type"), F.col("meta"))
    # A type is asked for once for each integer or text key, and once for each of its three lists and one number.
    assert optimized(out).count("schema_of_variant") <= 60
    assert out.columns == ["k", "file_type", "j", "meta", "locator"]
    row = out.first().locator
    assert (row.page, row.unit_type, row.line_end, row.structure_path) == (3, "a", None, "page:3")
    again = out.withColumn("locator", F.lit(1))
    assert locators.build_source_locator(again, F.col("file_type"), F.col("meta")).columns == out.columns


def test_a_recognised_text_is_repaired_once(spark):
    rows = [(1, 1, "a ,  b", 0.9), (1, 2, "c" * 12, 0.9), (2, 1, " ", 0.9), (3, 1, "ﬁ", 0.1), (4, 1, "abcdefghi jk", 0.9)]
    lines = spark.createDataFrame(rows, "image int, ordinal int, text string, confidence double")
    out = units.recognised_lines_to_text(lines, ["image"], max_chars=10)
    assert optimized(out).count("{2,}") + optimized(out).count("{3,}") <= 1
    assert sorted((r.image, r.text) for r in out.collect()) == [(1, "a, b\nccccc"), (4, "abcdefghi")]
