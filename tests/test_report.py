"""The text report's listing."""

from salegrain.operators.report import format_table


def test_listing_tells_how_many_rows_it_leaves_out(spark):
    rows = spark.range(5)
    assert format_table(rows, ("id",), limit=3).splitlines()[2:] == ["| 0  |", "| 1  |", "| 2  |", "(2 filas más)"]
    assert format_table(rows, ("id",), limit=5).splitlines()[-1] == "| 4  |"


def test_columns_are_as_wide_as_their_widest_value(spark):
    rows = spark.createDataFrame([("a", None), ("wider", 1)], "x string, number int").orderBy("number")
    assert format_table(rows, ("x", "number")).splitlines() == ["| x     | number |", "|-------|--------|", "| a     |        |", "| wider | 1      |"]
    assert format_table(rows.limit(0), ("x",)) == "(sin filas)"
