"""Line deduplication by site-relative frequency.

For each host, the pages that hold a line are divided by the host's pages; a
line on more than ``MAX_RATIO`` of them is boilerplate there and is dropped
from all of the host's pages. A page counts a line once, and copies of a page
are one page. Lines are counted by a 128-bit hash, so a host or a line with a
third of all rows is dealt by its pages. A host has at most (mean lines per
page) / ``MAX_RATIO`` boilerplate lines, so its list is short.

Near copies are one page as well. A first count finds the frequent lines. Pages
that consist of frequent lines by ``NEAR`` of their characters or more, the same
ones on each, are put together, and the frequent lines are counted again. So a
group of pages that differ in little does not make its own lines boilerplate,
and a line that is on other pages too still is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from fillwright.session import write_through

from .frames import set_aside

MAX_RATIO = 0.05
# A line on fewer pages is no boilerplate, however small the host.
MIN_PAGES = 8
# Pages that share so much of their characters are one, as near duplicates are.
NEAR = 0.75

FIELDS = (StructField("n_lines", LongType(), False), StructField("n_dropped", LongType(), False))


def line_key(line: Column) -> Column:
    """Two 64-bit hashes of the line without the blanks around it."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(bare, F.lit(1)).alias("b"))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare_lines(text: str) -> Column:
    """The different lines of a text without the blanks around them; blank ones are none."""
    return F.filter(F.array_distinct(F.transform(lines_of(F.col(text)), F.trim)), lambda line: line != "")


def _two_hashes(value: Column) -> Column:
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(value, F.lit(1)).alias("b"))


def _over_ratio(held: DataFrame, pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, key, pages, host_pages) of the lines over the ratio, from (host, key, page) and (host, page)."""
    totals = pages.distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = held.distinct().groupBy("host", "key").agg(F.count("*").alias("pages"))
    frequent = counts.where(F.col("pages") >= min_pages)
    joined = frequent.join(totals, frequent["host"].eqNullSafe(totals["host"])).select(frequent["host"], "key", "pages", "host_pages")
    return joined.where(F.col("pages") > F.lit(max_ratio) * F.col("host_pages"))


def _listed(found: DataFrame) -> DataFrame:
    """One short list per host, stored so that its size is known: the planner
    broadcasts a small table and else joins by host, splitting a hot one."""
    return write_through(found.groupBy(F.col("host").alias("_host")).agg(F.collect_list("key").alias("_keys")))


def boilerplate_lines(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, near: float = NEAR
) -> DataFrame:
    """(host, key, pages, host_pages) of the lines over the ratio. Blank lines are none."""
    rows = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    paged = rows.select("host", "text", _two_hashes(F.col("text")).alias("page"))
    held = paged.select("host", F.explode(_bare_lines("text")).alias("line"), "page")
    held = held.select("host", line_key(F.col("line")).alias("key"), "page")
    lists = _listed(_over_ratio(held, paged.select("host", "page"), max_ratio, min_pages))

    # the same with near copies put together, over the frequent lines alone
    marked = paged.join(lists, paged["host"].eqNullSafe(lists["_host"]), "left")
    lines = F.transform(_bare_lines("text"), lambda line: F.struct(line_key(line).alias("key"), F.length(line).alias("size")))
    marked = marked.select("host", "page", F.coalesce(lines, F.array().cast("array<struct<key:struct<a:bigint,b:bigint>,size:int>>")).alias("lines"), "_keys")
    common = F.filter("lines", lambda line: F.coalesce(F.array_contains("_keys", line["key"]), F.lit(False)))
    marked = marked.select("host", "page", "lines", common.alias("common"))

    def size(entries: str) -> Column:
        return F.aggregate(entries, F.lit(0).cast("long"), lambda total, line: total + line["size"])

    keys = F.sort_array(F.transform("common", lambda line: line["key"]))
    alike = (F.size("common") > 0) & (size("common") >= F.lit(near) * size("lines"))
    grouped = marked.select("host", F.when(alike, _two_hashes(keys)).otherwise(F.col("page")).alias("page"), "common")
    again = grouped.select("host", F.explode("common.key").alias("key"), "page")
    return _over_ratio(again, grouped.select("host", "page"), max_ratio, min_pages)


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, near: float = NEAR
) -> DataFrame:
    """``docs`` without boilerplate lines, plus ``n_lines`` and ``n_dropped`` (long).

    Lines are parted by a newline and compared without blanks around them; what
    stays is joined by newlines as it was. A null text stays null with no
    lines; an empty one has one blank line, which stays. Rows without a host
    form one host. Repeated rows and copies are one page of the host. Input
    columns named like a result column give way; the others pass unchanged.
    """
    lists = _listed(boilerplate_lines(docs, host, text, max_ratio, min_pages, near))
    rows = docs.drop("n_lines", "n_dropped")
    joined = rows.join(lists, rows[host].eqNullSafe(lists["_host"]), "left")
    lines = F.coalesce(lines_of(F.col(text)), F.array().cast("array<string>"))
    kept = F.when(F.col("_keys").isNull(), lines).otherwise(F.filter(lines, lambda line: ~F.array_contains("_keys", line_key(line))))
    result = joined.withColumns({"_n": F.size(lines), "_kept": kept})
    columns = [F.when(F.col(text).isNotNull(), F.array_join("_kept", "\n")).alias(c) if c == text else F.col(c) for c in rows.columns]
    n = F.col("_n").cast("long")
    return result.select(*columns, n.alias("n_lines"), (n - F.size("_kept")).alias("n_dropped"))


def without_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", **options) -> DataFrame:
    """The columns of ``docs`` and no others, the text without its boilerplate lines."""
    aside, back = set_aside(docs, *FIELDS)
    return back(drop_boilerplate(aside, host, text, **options))


# What the query op5_lines returns, over whole tables.
ORACLE = f"""
WITH p AS (SELECT source, text, row_number() OVER () AS page FROM (SELECT DISTINCT source, text FROM documents)),
w AS (SELECT DISTINCT source, page, trim(line, ' ') AS bare
      FROM (SELECT source, page, unnest(string_split(text, chr(10))) AS line FROM p) WHERE trim(line, ' ') <> ''),
t AS (SELECT source, count(*) AS pages FROM p GROUP BY source),
c AS (SELECT w.source, bare FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source GROUP BY w.source, bare, t.pages
      HAVING count(*) >= {MIN_PAGES} AND count(*) > {MAX_RATIO}::DOUBLE * t.pages),
m AS (SELECT w.source, page, w.bare, c.bare AS common FROM w LEFT JOIN c ON w.source IS NOT DISTINCT FROM c.source AND w.bare = c.bare),
a AS (SELECT page, string_agg(common, chr(10) ORDER BY common) AS alike FROM m GROUP BY page
      HAVING count(common) > 0 AND coalesce(sum(length(common)), 0) >= {NEAR}::DOUBLE * sum(length(bare))),
g AS (SELECT source, page, coalesce('n' || alike, 'p' || page) AS held FROM p LEFT JOIN a USING (page)),
t2 AS (SELECT source, count(DISTINCT held) AS pages FROM g GROUP BY source),
f AS (SELECT m.source, common AS bare FROM m JOIN g USING (page) JOIN t2 ON m.source IS NOT DISTINCT FROM t2.source
      WHERE common IS NOT NULL GROUP BY m.source, common, t2.pages
      HAVING count(DISTINCT held) >= {MIN_PAGES} AND count(DISTINCT held) > {MAX_RATIO}::DOUBLE * t2.pages),
d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, source, text, lines, generate_subscripts(lines, 1) AS i FROM d WHERE text IS NOT NULL),
e AS (SELECT doc_id, source, i, lines[i] AS line, trim(lines[i], ' ') AS bare FROM l),
k AS (SELECT e.doc_id, count(*) AS n_lines, count(f.bare) AS n_dropped,
             coalesce(string_agg(CASE WHEN f.bare IS NULL THEN e.line END, chr(10) ORDER BY e.i), '') AS text
      FROM e LEFT JOIN f ON e.source IS NOT DISTINCT FROM f.source AND e.bare = f.bare GROUP BY e.doc_id)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NOT NULL THEN k.text END AS text,
       coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped
FROM d LEFT JOIN k USING (doc_id)
"""
