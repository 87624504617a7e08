"""Pages of markup as rows: inspection records and table cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters and digits below which a page's own text counts as low.
LEAST_TEXT = 40


def inspect(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """(page_id, n_alnum, native_text, n_images, n_rows): a projection, nothing is shuffled."""
    source = F.coalesce(F.col(html), F.lit(""))
    n = F.length(F.regexp_replace(F.regexp_replace(source, "<[^>]*>", " "), "[^A-Za-z0-9]", ""))
    status = F.when(n == 0, "missing").when(n < LEAST_TEXT, "low").otherwise("usable")
    return pages.select(page_id, n.alias("n_alnum"), status.alias("native_text"), F.regexp_count(source, F.lit("<img")).alias("n_images"), F.regexp_count(source, F.lit("<tr")).alias("n_rows"))


def table_cells(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """(page_id, row, col, text) of every table cell, rows counted through the page."""
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.regexp_extract_all(F.col("row_html"), F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    cut = pages.select(page_id, F.posexplode(rows).alias("row", "row_html"))
    return cut.select(page_id, "row", F.posexplode(cells).alias("col", "x")).select(page_id, "row", "col", F.trim(F.regexp_replace("x", "<[^>]*>", "")).alias("text"))
