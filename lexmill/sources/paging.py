"""Listings that come in pages: which of the fetched pages count, and the rows that they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: pages of a listing, at most
CAP = 50


def pages_taken(pages: DataFrame, most: int, cap: int = CAP) -> DataFrame:
    """(listing, page, rows, taken) of the pages (listing, page, total, rows) that a reader would take, one after another.

    The first page is always taken, and its number of rows is the page size. The next one is taken while the one before
    had rows, fewer rows than wanted have come, and the page is among those that ``most`` rows may need, one more, and
    ``cap`` at most. Wanted are ``most`` rows, or as many as the first page says there are in total (without a total: as
    many as it has). A page that is missing ends its listing. Of pages with one number the one with the most rows counts;
    taken is the number of rows that came before the page."""
    one = pages.filter(F.col("page").between(1, cap) & F.col("listing").isNotNull()).groupBy("listing", "page").agg(F.max_by(F.struct("total", "rows"), F.struct(F.size("rows"), "rows")).alias("r"))
    one = one.select("listing", F.col("page").cast("int").alias("page"), "r.total", F.coalesce("r.rows", F.array().cast(pages.schema["rows"].dataType)).alias("rows"))
    by = Window.partitionBy("listing").orderBy("page")
    whole = Window.partitionBy("listing")
    size = F.size("rows")
    rows = one.withColumns({
        "place": F.row_number().over(by), "taken": F.coalesce(F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "before": F.lag(size).over(by),
        "first": F.max(F.when(F.col("page") == 1, F.struct(F.coalesce("total", size.cast("long")).alias("total"), size.alias("size")))).over(whole),
    })
    wanted = F.least(F.lit(most), F.col("first.total"))
    needed = F.ceil(F.lit(most) / F.when(F.col("first.size") > 0, F.col("first.size")).otherwise(1)) + 1
    ends = (F.col("page") > 1) & ((F.col("before") == 0) | (F.col("taken") >= wanted) | (F.col("page") > needed))
    stop = F.min(F.when(ends | (F.col("place") != F.col("page")), F.col("page"))).over(whole)
    return rows.withColumn("stop", stop).filter("stop is null or page < stop").select("listing", "page", "rows", "taken")


def listed(pages: DataFrame, most: int, cap: int = CAP) -> DataFrame:
    """(listing, position, row): the first ``most`` rows of each listing's taken pages, positions from 0."""
    rows = pages_taken(pages, most, cap).select("listing", "taken", F.posexplode("rows").alias("at", "row"))
    return rows.select("listing", (F.col("taken") + F.col("at")).cast("long").alias("position"), "row").filter(F.col("position") < most)
