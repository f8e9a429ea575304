"""Boilerplate lines of a site, found by their site-relative frequency.

A line is what stands between line feeds, without blanks, tabs, form feeds and carriage returns at its ends. A host's pages that contain a
line, divided by all pages of that host, give its ratio; lines above the ratio, on at least min_pages pages, are dropped from all pages of
the host. Everything is DataFrame work: lines travel as 64-bit hashes, counts are summed before the shuffle, and since a
host with p pages of l lines has at most l / ratio boilerplate lines, the list of a host stays small however many pages
it has. The lists are written, and their size is measured: up to BROADCAST_BYTES they go to every task and no text is shuffled; beyond, pages
are joined by host and by salt, a salt for each PAGES pages of the largest host.

Defined results: a null text stays null and counts as a page without lines; empty lines never are boilerplate; a null host is
a host of its own; a line repeated inside a page counts once; a page whose lines all go becomes the empty text and stays;
an empty table gives an empty table; further columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecinity.llm.common import fresh, saved

RATIO = 0.05
MIN_PAGES = 3
BROADCAST_BYTES = 8 << 20
PAGES = 100_000


def line_key(line: Column) -> Column:
    """The hash of a line without white space at its ends."""
    return F.xxhash64(F.btrim(line, F.lit(" \t\f\r")))


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host with such lines: host_key string, lines array of long (hashes), pages long."""
    pages = docs.select(host_key(host).alias("host_key"), F.col(f"`{text}`").alias("t"))
    totals = pages.groupBy("host_key").agg(F.count(F.lit(1)).alias("pages"))
    lines = F.array_distinct(F.transform(F.split("t", "\n"), line_key))
    seen = pages.select("host_key", F.explode(lines).alias("line")).where(F.col("line") != F.xxhash64(F.lit(""))).groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("with_line")).where(F.col("with_line") >= min_pages)
    return seen.join(totals, "host_key").where(F.col("with_line") > F.lit(ratio) * F.col("pages")).groupBy("host_key").agg(F.collect_list("line").alias("lines"), F.max("pages").alias("pages"))


def host_key(host: str) -> Column:
    """The host as a key that is never null."""
    return F.coalesce(F.concat(F.lit("h:"), F.col(f"`{host}`").cast("string")), F.lit("null"))


def drop_boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False, broadcast_bytes: int = BROADCAST_BYTES, pages: int = PAGES) -> DataFrame:
    """docs with text cleaned; with counts also n_lines and n_dropped, which replace columns of those names."""
    at, salt, lines, all_, kept = fresh(docs.columns, "host_key", "salt", "lines", "all_lines", "kept_lines")
    lists = saved(boilerplate(docs, text, host, ratio, min_pages), "boilerplate").select(F.col("host_key").alias(at), F.col("lines").alias(lines), "pages")
    size = lists.agg(F.sum(F.size(lines) * 8 + 64).alias("bytes"), F.max("pages").alias("pages")).first()
    keyed, lists = docs.withColumn(at, host_key(host)), lists.select(at, lines)
    if (size["bytes"] or 0) <= broadcast_bytes:
        joined = keyed.join(F.broadcast(lists), at, "left")
    else:
        salts = -(-size["pages"] // pages)
        lists = lists.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")).join(lists, [at, salt], "left")
    joined = joined.withColumn(all_, F.split(F.col(f"`{text}`"), "\n"))
    stays = F.filter(all_, lambda x: ~F.array_contains(lines, line_key(x)))
    joined = joined.withColumn(kept, F.when(F.col(lines).isNull(), F.col(all_)).otherwise(stays))
    out = [F.array_join(kept, "\n").alias(text) if n == text else F.col(f"`{n}`") for n in docs.columns if not counts or n not in ("n_lines", "n_dropped")]
    if counts:
        number = lambda x: F.when(F.col(all_).isNull(), F.lit(0)).otherwise(x).cast("long")
        out += [number(F.size(all_)).alias("n_lines"), number(F.size(all_) - F.size(kept)).alias("n_dropped")]
    return joined.select(*out)
