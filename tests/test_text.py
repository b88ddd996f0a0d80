"""Column expressions on texts."""

from pyspark.sql import functions as F

from cadenza.functions.text import mask_paths


def test_long_paths_are_masked(spark):
    rows = [(1, "/a" * 200_000 + " end"), (2, "/one two"), (3, "see /a/b-c/d.e: /x//y/z"), (4, None)]
    got = spark.createDataFrame(rows, "id long, t string").select("id", mask_paths(F.col("t")).alias("m"))
    assert dict(got.collect()) == {1: "<path> end", 2: "/one two", 3: "see <path>: /x/<path>", 4: None}
