"""Boilerplate lines by their frequency within a site.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it over the number of the
host's pages, where pages with the same whole text are one page (copies are not boilerplate; another operator removes
them). Lines above ``max_ratio`` that stand on at least ``min_pages`` pages are dropped from every page of the host.

Lines are compared without white space at their ends; blank lines are never dropped. A page of which nothing but blank
lines would be left keeps its text. Cases: a null host is a host of its own; null and empty texts are returned as they
are and count as pages; repeated rows are returned as often as they come; a tie at the threshold keeps the line; an
empty table gives an empty one; other columns are carried along, but ``n_lines`` and ``n_dropped``, in any case, are
replaced, and names that start with ``_ld_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import WORD_TRIM, let, settle, small


#: A line on more than this share of a site's pages is boilerplate. On large sites such lines stand on 9 to 13 % of the
#: pages, and no other line on more than 5 %; a ratio between them decides alike on sites of any size.
MAX_RATIO = 0.0625


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(WORD_TRIM)))


def _host(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h"), host), F.lit("none"))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, max_ratio: float, min_pages: int) -> DataFrame:
    """Rows (_ld_host, _ld_line): hashes of the lines to drop. Of a host, at most its mean lines a page / max_ratio."""
    rows = pages.select(_host(F.col(host_col)).alias("_ld_host"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_ld_page"), F.coalesce(F.col(text_col), F.lit("")).alias("_ld_text"))
    real = F.filter(F.split("_ld_text", "\n"), lambda x: F.btrim(x, F.lit(WORD_TRIM)) != "")
    # The row for the page itself has the line null; one shuffle counts both lines and pages.
    keys = F.concat(F.array(F.lit(None).cast("long")), F.array_distinct(F.transform(real, _key)))
    seen = rows.select("_ld_host", "_ld_page", F.explode(keys).alias("_ld_line")).distinct()
    counts = settle(seen.groupBy("_ld_host", "_ld_line").agg(F.count("*").alias("n")).where(F.col("_ld_line").isNull() | (F.col("n") >= min_pages)))
    totals = counts.where(F.col("_ld_line").isNull()).select("_ld_host", F.col("n").alias("total"))
    lines = counts.where(F.col("_ld_line").isNotNull()).join(small(totals), "_ld_host")
    return lines.where(F.col("n") > max_ratio * F.col("total")).select("_ld_host", "_ld_line")


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = 5) -> DataFrame:
    """``pages`` with boilerplate lines dropped from the text, and ``n_lines`` and ``n_dropped`` (long) added."""
    found = settle(boilerplate(pages, host_col, text_col, max_ratio, min_pages))
    rows = found.count()
    hosts = found.groupBy("_ld_host").agg(F.collect_set("_ld_line").alias("_ld_drop"))
    # Beyond the broadcast limit this is a sort-merge join, whose hot hosts adaptive execution splits.
    joined = pages.withColumn("_ld_host", _host(F.col(host_col))).join(small(hosts, rows), "_ld_host", "left")

    def cleaned(lines: Column) -> Column:
        blank = lambda x: F.btrim(x, F.lit(WORD_TRIM)) == ""
        kept = F.filter(lines, lambda x: blank(x) | ~F.array_contains("_ld_drop", _key(x)))
        return let(kept, lambda k: F.when((F.size(k) < F.size(lines)) & F.exists(k, lambda x: ~blank(x)), F.struct(F.array_join(k, "\n").alias("text"), (F.size(lines) - F.size(k)).alias("n"))))

    lines = F.split(F.col(text_col), "\n")
    new = F.when(F.col("_ld_drop").isNotNull(), let(lines, cleaned))
    out = joined.withColumn("_ld_new", new)
    n_lines = F.coalesce(F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(WORD_TRIM)) != "")), F.lit(0)).cast("long")
    names = [c for c in pages.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*[F.coalesce(F.col("_ld_new.text"), F.col(text_col)).alias(c) if c == text_col else F.col(c) for c in names], n_lines.alias("n_lines"), F.coalesce(F.col("_ld_new.n"), F.lit(0)).cast("long").alias("n_dropped"))
