"""The registered trace query follows every line of a page."""

from pulsegrid.plans.queries import QUERIES


def test_all_lines_are_traced(spark, data):
    pages = spark.read.parquet(f"{data}/events.parquet").select("user_id").distinct().count()
    rows = QUERIES["t11_traces"](spark, data).collect()
    assert len(rows) == 4 * pages and {r["line"] for r in rows} == {0, 1, 2, 3}
    assert all(r["n"] == 320 and 30 <= r["mean"] - 60 * r["line"] <= 46 for r in rows)
