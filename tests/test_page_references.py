"""References without a semicolon at their end: text in the page queries, as their SQL has it; decoded by the parser's rule."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from curatrix import registry
from curatrix.functions import html

TITLES = ["and&amp", "and&amp;&am", "x&lt", "a &", "&ampy z", "b&amp;c &#39", "﷐&﷑﷐﷒&amp"]


def page(title: str) -> str:
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='&amp';</script></head><body><nav>&amp</nav><h1>{title}</h1><p>a &amp;&lt; b</p><footer>&copy</footer></body></html>"


def test_queries_follow_their_sql(spark, tmp_path):
    # Twice six ids, so that each title also stands in pages that page_text_odd leaves to the parser.
    rows = [(6 * k + r, "u", page(t)) for k, t in enumerate(TITLES) for r in range(6)] + [(1000, "u", None), (1002, "u", "")]
    for folder, given, names in (("all", rows, ("page_text", "page_text_routes")), ("odd", [r for r in rows if r[2]], ("page_text_odd",))):
        spark.createDataFrame(given, "page_id long, url string, html string").write.parquet(str(tmp_path / folder / "pages.parquet"))
        con = duckdb.connect()
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path / folder / 'pages.parquet'}/*.parquet'")
        for name in names:
            found = sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path / folder)).collect())
            assert found == sorted(con.execute(registry.oracle_sql()[name]).fetchall()), name


def test_both_rules(spark):
    row = spark.createDataFrame([("<h1>x&amp</h1>&lt;&copy &copy; ﷐",)], "page string").select(html.page_text(F.col("page")).alias("loose"), html.page_text(F.col("page"), ended=True).alias("ended")).first()
    assert (row.loose, row.ended) == ("x&\n<© © ﷐", "x&amp\n<&copy © ﷐")
    cut = spark.createDataFrame([("cut &am<b>p;</b>",)], "page string").select(html.page_text(F.col("page"), ended=True).alias("ended"))
    assert cut.first().ended == "cut &amp;"  # as the parser has it
