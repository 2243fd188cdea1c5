"""Line de-duplication by site-relative frequency, in DataFrame operations only.

For each host, the pages that contain a line are divided by the host's pages; a line above
``ratio`` that occurs on at least ``least_pages`` pages of the host is boilerplate there and is
dropped from the host's pages. A page counts once for a line, however often it repeats it. Lines are
compared without ASCII white space around them; blank lines are never boilerplate.

Hosts with many pages are no hot spot: counts are taken per (host, line) with map-side partial sums.
The boilerplate lines of a host number at most lines per page / ratio; they reach the pages by a
broadcast while their measured size is below ``BROADCAST_BYTES``, else by a join on the host that
the engine may split.

Cases: a null text stays null and has no lines; a null host is a host of its own; an empty text
stays empty; repeated rows are pages of their own; an empty table gives an empty table; extra
columns pass through unchanged, and helper names (``__ld_...``) do not clash with theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RATIO = 0.05
LEAST_PAGES = 3
BROADCAST_BYTES = 32 << 20


#: ASCII white space but the newline.
_SPACE = " \t\x0b\x0c\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACE))


def _key(line: Column) -> Column:
    return F.md5(_bare(line).cast("binary"))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host key, keys of its boilerplate lines); hosts without any are left out."""
    base = pages.select(F.to_json(F.struct(F.col(host).alias("h"))).alias("__ld_host"), F.col(text).alias("__ld_text"))
    lines = base.select("__ld_host", F.explode(F.array_distinct(F.transform(F.split("__ld_text", "\n"), lambda x: _bare(x)))).alias("__ld_line")).filter("__ld_line != ''")
    counted = lines.groupBy("__ld_host", F.md5(F.col("__ld_line").cast("binary")).alias("__ld_key")).agg(F.count("*").alias("__ld_n")).filter(F.col("__ld_n") >= least_pages)
    totals = base.groupBy("__ld_host").agg(F.count("*").alias("__ld_pages"))
    hot = counted.join(totals, "__ld_host").filter(F.col("__ld_n") > F.lit(ratio) * F.col("__ld_pages"))
    return hot.groupBy("__ld_host").agg(F.collect_list("__ld_key").alias("__ld_keys"))


def drop_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """All rows and columns of ``pages``, the text without boilerplate lines; adds n_lines and n_dropped."""
    found = written(boilerplate(pages, host, text, ratio, least_pages), "boilerplate")
    size = found.agg(F.sum(F.size("__ld_keys") * 40 + F.length("__ld_host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        found = F.broadcast(found)
    lines = F.split(F.col(text), "\n")
    out = pages.withColumn("__ld_host", F.to_json(F.struct(F.col(host).alias("h")))).join(found, "__ld_host", "left")
    # First which boilerplate the page has at all: seldom more than a few lines, which each line is then held against.
    out = out.withColumn("__ld_hit", F.array_intersect(F.transform(lines, lambda x: _key(x)), F.col("__ld_keys")))
    keep = F.filter(lines, lambda x: (_bare(x) == "") | ~F.array_contains(F.col("__ld_hit"), _key(x)))
    out = out.withColumn("__ld_keep", F.when(F.col("__ld_keys").isNull() | (F.size("__ld_hit") == 0), lines).otherwise(keep))
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size("__ld_keep")).cast("long"))
    out = out.withColumn(text, F.when(F.col("__ld_keys").isNull(), F.col(text)).otherwise(F.array_join("__ld_keep", "\n")))
    return out.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
