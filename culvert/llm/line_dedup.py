"""Line dedup by site-relative frequency: lines that too many pages of one host have.

Each page counts a line of its host once. Counts are combined before and after one shuffle by
(host, line code), so a hot host is spread over its lines and a hot line is one row a task. The
lines over the ratio of one host are at most (mean lines of its pages) / ratio, so the list that
joins the pages again is a small part of the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.llm.exchange import written

#: Rows of (host, line code) that are broadcast at most: 16 bytes each and the host's name. Longer
#: lists are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Lines of web pages: what stands between tags and line breaks.
HTML_LINES = r"<[^>]*>|[\n\r]"
TEXT_LINES = r"[\n\r]"
_BLANKS = " \t\n\x0b\x0c\r"


def host_of(url: str) -> Column:
    """The host of a URL, in lower case; the empty string where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def lines_of(text: str, separator: str) -> Column:
    """The lines of a text without blanks at their ends; blank lines are left out."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), separator), lambda x: F.btrim(x, F.lit(_BLANKS)))
    return F.filter(lines, lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, line): codes of the lines that more than `ratio` of a host's pages have, and at least
    min_pages; of pages (host, lines)."""
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    once = pages.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    counts = once.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    return counts.join(totals, "host").filter(F.col("n") > F.lit(ratio) * F.col("pages")).select("host", "line")


def line_dedup(pages: DataFrame, host: Column, text: str, separator: str = TEXT_LINES, ratio: float = 0.3, min_pages: int = 3) -> DataFrame:
    """All columns of pages but `text`, with host, n_lines, n_dropped, kept_text (lines joined by \\n).

    Lines are what `separator` parts, without blanks at their ends; blank lines are left out. A
    line goes from all pages of a host where more than `ratio` of the host's rows have it, and at
    least min_pages of them: pages of small sites keep their lines. Repeated rows are pages each.

    A page of any length is one row. A null text has no lines; a null host is a host of its own, the empty one. An empty table gives
    an empty table. Columns of pages with the names of results are replaced. Lines of one host are
    told apart by 64-bit codes.
    """
    results = ("host", "n_lines", "n_dropped", "kept_text")
    # The columns of pages travel as one, so that none can clash with a working column.
    others = [c for c in pages.columns if c.lower() not in (text.lower(), *results)]
    page = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in others]) if others else F.lit(None)
    pages = pages.select(page.alias("page"), F.coalesce(host, F.lit("")).alias("host"), lines_of(text, separator).alias("lines"))
    found = written(boilerplate(pages, ratio, min_pages).groupBy("host").agg(F.collect_list("line").alias("drop")))
    few = found.select(F.explode("drop")).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = pages.join(F.broadcast(found) if few else found, "host", "left")
    drop = F.coalesce("drop", F.array().cast("array<bigint>"))
    joined = joined.withColumn("kept", F.filter("lines", lambda x: ~F.array_contains(drop, F.xxhash64(x))))
    counts = [F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text")]
    return joined.select(*["page.*"][: len(others)], "host", *counts)
