"""URL filters by dated lists: entries become validity intervals, captures are joined as of them.

List entries say that a pattern was added to or removed from a list on a day. They become
intervals (valid from a day inclusive to a day exclusive). A capture is judged by the entries that
were active on the day it was fetched. Patterns are domains, which cover their subdomains
("d:example.org"), and path prefixes by whole segments ("p:www.example.org/a/b").

A URL is only looked up as deep as the list goes: as many labels of its host, from the right, and as
many segments of its path as the deepest entry has. A long path costs its length once. Slashes at the
end of a path pattern say nothing and are dropped.

Lists are dated by day, so captures are first reduced to distinct (URL, day) visits and their
(pattern, day) pairs. A pattern then has at most one row a day on either side of the as-of join,
however many captures its host has: the window per (pattern, list) is bounded by the calendar.
Captures look their visit up last, by an ordinary join that can be split where a URL is hot.

If a pattern is added and removed on the same day, it counts as added. Entries without list,
pattern, action or day are void. A capture without URL or fetch time matches nothing. Repeated
captures each get a row; repeated entries count once. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.llm.common import Workspace


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.lower(F.regexp_replace(host, r"\.$", ""))
    return F.when(host != "", host)


def patterns_of(url: Column, labels_upto: int | None = None, segments_upto: int | None = None) -> Column:
    """All patterns that cover a URL: each suffix of its host, each prefix of its path.

    With bounds, only suffixes of so many labels and prefixes of so many segments (-1: none).
    """
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    first = F.lit(1) if labels_upto is None else F.greatest(F.lit(1), n - labels_upto + 1)
    suffixes = F.when(first <= n, F.sequence(first, n)).otherwise(F.array().cast("array<int>"))
    domains = F.transform(suffixes, lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*(/[^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    if segments_upto is not None:
        segments = F.slice(segments, 1, max(segments_upto, 0))
    folders = F.transform(
        F.sequence(F.lit(0), F.size(segments)),
        lambda i: F.concat(F.lit("p:"), F.array_join(F.concat(F.array(host_of(url)), F.slice(segments, F.lit(1), i)), "/")),
    )
    every = domains if segments_upto == -1 else F.concat(domains, folders)
    return F.when(host_of(url).isNotNull(), F.array_distinct(every))


def depths(valid: DataFrame) -> tuple[int, int]:
    """The most labels of a domain and the most path segments among the patterns; 0 and -1 if none."""
    parts = lambda mark: F.size(F.split(F.col("pattern"), mark))
    kind = F.substring("pattern", 1, 2)
    labels, segments = valid.agg(F.max(F.when(kind == "d:", parts(r"\."))), F.max(F.when(kind == "p:", parts("/") - 1))).first()
    return labels or 0, -1 if segments is None else segments


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals: list, pattern, valid_from, valid_to (null: still valid)."""
    usable = entries.where("list is not null and pattern is not null and action in ('add', 'remove') and day is not null")
    usable = usable.withColumn("pattern", F.regexp_replace("pattern", "/+$", ""))
    daily = usable.groupBy("list", "pattern", "day").agg(F.max(F.col("action") == "add").alias("on"))
    order = Window.partitionBy("list", "pattern").orderBy("day")
    changes = daily.withColumn("was", F.lag("on", 1, False).over(order)).where("`on` != was")
    ended = changes.withColumn("valid_to", F.lead("day").over(order))
    return ended.where("`on`").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def active_entries(visits: DataFrame, valid: DataFrame) -> DataFrame:
    """As-of join of (pattern, day) pairs with intervals: pattern, day, list, valid_from, valid_to."""
    asked = visits.join(valid.select("pattern", "list").distinct(), "pattern").select("pattern", "list", "day", F.lit(1).alias("asked"))
    period = F.struct("valid_from", "valid_to")
    starts = valid.select("pattern", "list", F.col("valid_from").alias("day"), F.lit(0).alias("asked"), period.alias("period"))
    asked = asked.withColumn("period", F.lit(None).cast(starts.schema["period"].dataType))
    before = Window.partitionBy("pattern", "list").orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = starts.unionByName(asked).withColumn("period", F.last("period", ignorenulls=True).over(before))
    live = seen.where("asked = 1 and period is not null and (period.valid_to is null or day < period.valid_to)")
    return live.select("pattern", "day", "list", "period.valid_from", "period.valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched", allow_lists: tuple[str, ...] = ("allow",)) -> DataFrame:
    """Per capture: key, host, fetch_day, n_active, lists, pattern, valid_from, valid_to, blocked.

    ``pattern`` is the longest active one (then the first by name, then by list), with its interval.
    A capture is blocked if an entry is active and none of an allow list is.
    """
    rows = captures.select(F.col(key).alias("key"), F.col(url).alias("url"), F.to_date(fetched).alias("day"))
    visits = rows.where("url is not null and day is not null").select("url", "day").distinct()
    valid = Workspace(captures.sparkSession, "url_filters").put("valid", intervals(entries))
    covered = visits.select("url", "day", F.explode(patterns_of(F.col("url"), *depths(valid))).alias("pattern"))
    asked = covered.select("pattern", "day").distinct()
    live = active_entries(asked, valid)
    best = F.struct((-F.length("pattern")).alias("length"), "pattern", "list", "valid_from", "valid_to")
    # A pattern's lists are put together before they meet its visits: still one row a day.
    per_pattern = live.groupBy("pattern", "day").agg(
        F.count("*").alias("n"), F.collect_set("list").alias("lists"), F.min(best).alias("best")
    )
    hits = covered.join(per_pattern, ["pattern", "day"]).groupBy("url", "day").agg(
        F.sum("n").alias("n_active"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lists")))).alias("lists"), F.min("best").alias("best")
    )
    out = rows.join(hits, ["url", "day"], "left")
    allowed = F.arrays_overlap("lists", F.array(*[F.lit(name) for name in allow_lists]).cast("array<string>"))
    return out.select(
        F.col("key").alias(key), host_of(F.col("url")).alias("host"), F.col("day").alias("fetch_day"),
        F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        F.coalesce(F.array_join("lists", ","), F.lit("")).alias("lists"),
        "best.pattern", "best.valid_from", "best.valid_to",
        F.coalesce(~allowed, F.lit(False)).alias("blocked"),
    )


# --- inputs derived from the pages table ---------------------------------------------------

# Whole-number arithmetic on page ids that Spark and DuckDB agree on (fixed values).
CAPTURES = """
SELECT page_id, url, CAST('2024-01-01 00:00:00' AS TIMESTAMP) + (page_id * 104729 % 1051200) * INTERVAL 1 MINUTE AS fetched FROM pages
"""
ENTRIES = """
SELECT CASE page_id % 7 WHEN 0 THEN 'allow' WHEN 1 THEN 'malware' WHEN 2 THEN 'malware' ELSE 'adult' END AS list,
       CASE WHEN page_id % 4 = 0 THEN 'd:' || host
            WHEN page_id % 4 = 1 THEN 'd:' || CASE WHEN parent = '' THEN host ELSE parent END
            WHEN page_id % 4 = 2 THEN 'p:' || host || '/' || first
            ELSE 'p:' || host || '/' || first || '/' || second || '/' END AS pattern,
       CASE WHEN page_id % 5 = 0 THEN 'remove' ELSE 'add' END AS action,
       CAST(DATE '2024-01-01' + CAST(page_id * 7919 % 730 AS INT) * INTERVAL 1 DAY AS DATE) AS day
FROM (SELECT page_id, host, regexp_extract(host, '^[^.]+[.]([^.]+[.].+)$', 1) AS parent, first, second
      FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
                   regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)', 1) AS first,
                   regexp_extract(url, '^[a-z]+://[^/]+/[^/?#]+/([^/?#]+)', 1) AS second
            FROM pages WHERE url IS NOT NULL) AS cut) AS named
WHERE host <> ''
"""


def derived(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures of all pages, and dated list entries made from all pages: hosts, parent domains, folders."""
    spark = pages.sparkSession
    return spark.sql(CAPTURES.replace("FROM pages", "FROM {pages}").replace("1 MINUTE", "'1' MINUTE"), pages=pages), spark.sql(
        ENTRIES.replace("FROM pages", "FROM {pages}").replace("1 DAY", "'1' DAY"), pages=pages
    )


FILTER_SQL = f"""
WITH c AS ({CAPTURES}), e AS ({ENTRIES}),
daily AS (SELECT list, regexp_replace(pattern, '/+$', '') AS pattern, day, max(action = 'add') AS live FROM e GROUP BY ALL),
changes AS (SELECT * FROM (SELECT *, lag(live, 1, false) OVER (PARTITION BY list, pattern ORDER BY day) AS was FROM daily) WHERE live <> was),
ended AS (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS valid_to FROM changes),
valid AS (SELECT list, pattern, day AS valid_from, valid_to FROM ended WHERE live),
named AS (
  SELECT page_id, CAST(fetched AS DATE) AS fetch_day, nullif(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '') AS host,
         list_filter(string_split(regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS seg
  FROM c),
keys AS (
  SELECT page_id, fetch_day, 'd:' || array_to_string(string_split(host, '.')[unnest(range(1, len(string_split(host, '.')) + 1)):], '.') AS pattern FROM named
  UNION ALL
  SELECT page_id, fetch_day, 'p:' || array_to_string(list_concat([host], seg[1:unnest(range(0, len(seg) + 1))]), '/') FROM named WHERE host IS NOT NULL),
hits AS (
  SELECT page_id, list, k.pattern, valid_from, valid_to,
         row_number() OVER (PARTITION BY page_id ORDER BY length(k.pattern) DESC, k.pattern, list) AS r
  FROM keys k JOIN valid v ON k.pattern = v.pattern AND fetch_day >= valid_from AND (valid_to IS NULL OR fetch_day < valid_to)),
per AS (
  SELECT page_id, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, bool_or(list = 'allow') AS allowed,
         min(pattern) FILTER (r = 1) AS pattern, min(valid_from) FILTER (r = 1) AS valid_from, min(valid_to) FILTER (r = 1) AS valid_to
  FROM hits GROUP BY page_id)
SELECT page_id, host, fetch_day, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, pattern, valid_from, valid_to,
       coalesce(NOT allowed, false) AS blocked
FROM named LEFT JOIN per USING (page_id)
"""
