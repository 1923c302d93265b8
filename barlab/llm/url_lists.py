"""URL filters by a temporal list join.

Block lists change over time. Dated entries (add or remove a pattern) become validity intervals,
and every capture is judged by the entries active when it was fetched: an as-of join on each key
that its URL offers (host, parent domains, path prefixes). Intervals are cut at calendar cells,
so that the join's keys are (pattern, cell): a busy host spreads over its fetch times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a calendar cell.
CELL_DAYS = 30
#: Host labels below which no domain key is made.
MIN_LABELS = 2


def url_host(url: Column) -> Column:
    """Lower-case host without user, port or trailing dot; empty where the URL has none."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1), r"\.$", ""))


def url_path(url: Column) -> Column:
    """Path of the URL, without query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def listed_pattern(pattern: Column) -> Column:
    """A pattern with its host in lower case; paths keep their case, as in url_keys."""
    host = F.substring_index(pattern, "/", 1)
    return F.concat(F.lower(host), F.substring(pattern, F.length(host) + 1, F.length(pattern)))


def path_depths(entries: DataFrame) -> list[int]:
    """The numbers of path segments that listed patterns have, without 0: at most as many as the longest has."""
    depth = F.size(F.split("pattern", "/")) - 1
    return sorted(r._depth for r in entries.select(depth.alias("_depth")).filter("_depth > 0").distinct().collect())


def url_keys(host: Column, path: Column, depths: list[int]) -> Column:
    """Distinct patterns that can match: the host and its parent domains ("example.com"), and the
    host with its first path segments ("example.com/a/b" for the depth 2), for each of the depths."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.when((host != "") & (n >= MIN_LABELS), F.transform(F.sequence(F.lit(1), n - MIN_LABELS + 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.when(host != "", F.array(host)).otherwise(F.array().cast("array<string>")))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    within = F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda i: i <= F.size(parts))
    prefixes = F.when(host != "", F.transform(within, lambda i: F.concat_ws("/", host, F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(domains, prefixes))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list_name, pattern, category, valid_from, valid_to): half-open, valid_to null while active.

    entries: (list_name, pattern, effective, action, category); action is "add" or "remove". An
    entry holds until the next one for the same list and pattern. Of entries for one day, a
    removal wins, then the smallest category. Entries with a null pattern, date or list are void.
    Hosts are compared in lower case, so entries whose hosts differ in case only are one entry.
    """
    valid = entries.filter(F.col("pattern").isNotNull() & F.col("effective").isNotNull() & F.col("list_name").isNotNull() & F.col("action").isin("add", "remove"))
    valid = valid.withColumn("pattern", listed_pattern(F.col("pattern")))
    daily = valid.groupBy("list_name", "pattern", "effective").agg(F.max("action").alias("action"), F.min(F.when(F.col("action") == "add", F.col("category"))).alias("category"))
    following = F.lead("effective").over(Window.partitionBy("list_name", "pattern").orderBy("effective"))
    return daily.withColumn("valid_to", following).filter("action = 'add'").select("list_name", "pattern", "category", F.col("effective").alias("valid_from"), "valid_to")


def _cell(day: Column) -> Column:
    return F.floor(F.unix_date(day) / CELL_DAYS)


def judge_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """One row per row of captures: (id_col, url_col, time_col, host, blocked, n_active, list_name, pattern, category, valid_from).

    captures: time_col is a date. blocked tells whether any entry was active on the day of the
    fetch; the reported one is the most specific (longest pattern, then list, then pattern; of
    equal entries the earliest). URLs of any length are matched whole. Null or host-less URLs and null dates match nothing; repeated rows are judged alike, each on
    its own row; empty tables give empty results or unblocked rows. Extra columns are ignored.
    """
    host = url_host(F.coalesce(F.col(url_col), F.lit("")))
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).cast("date").alias("_day"), host.alias("_host"))
    rows = rows.groupBy("_id", "_url", "_day", "_host").agg(F.count("*").alias("_n"))
    keyed = rows.withColumn("pattern", F.explode(url_keys(F.col("_host"), url_path(F.col("_url")), path_depths(entries)))).withColumn("_cell", _cell(F.col("_day")))
    spans = validity_intervals(entries)
    # Open intervals end with the last capture's day.
    last = rows.agg(F.max("_day")).first()[0]
    end = F.coalesce(F.date_sub("valid_to", 1), F.lit(last).cast("date"))
    cells = spans.filter(end >= F.col("valid_from")).withColumn("_cell", F.explode(F.sequence(_cell(F.col("valid_from")), _cell(end))))
    active = keyed.join(cells, ["pattern", "_cell"]).filter((F.col("_day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to"))))
    best = F.min_by(F.struct("list_name", "pattern", "category", "valid_from"), F.struct(-F.length("pattern"), "list_name", "pattern", "valid_from"))
    judged = active.groupBy("_id", "_url", "_day").agg(F.count("*").alias("n_active"), best.alias("_best"))
    same = F.col("r._id").eqNullSafe(F.col("j._id")) & F.col("r._url").eqNullSafe(F.col("j._url")) & F.col("r._day").eqNullSafe(F.col("j._day"))
    out = rows.alias("r").join(judged.alias("j"), same, "left").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return out.select(F.col("r._id").alias(id_col), F.col("r._url").alias(url_col), F.col("r._day").alias(time_col), F.col("_host").alias("host"), F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).alias("n_active"), "_best.list_name", "_best.pattern", "_best.category", "_best.valid_from")


def pages_as_captures(pages: DataFrame) -> DataFrame:
    """The given pages with a fetch day spread over 2023 by their number."""
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.coalesce(F.col("page_id"), F.lit(0)) * 37, F.lit(365)).cast("int")).alias("fetched"))


def entries_from_pages(pages: DataFrame) -> DataFrame:
    """Dated list entries derived from all given pages: hosts, and hosts with path prefixes of every
    depth, whose hash begins with 0 to 5 enter a list by page number, and some leave it 90 days
    later. Half of the patterns spell their host in capitals, as lists from many hands do."""
    host = url_host(F.coalesce(F.col("url"), F.lit("")))
    parts = F.filter(F.split(url_path(F.col("url")), "/"), lambda p: p != "")
    known = pages.select("page_id", host.alias("host"), parts.alias("parts")).filter("host <> ''")
    domain = known.select("page_id", F.lit("domains").alias("list_name"), "host", F.lit("").alias("rest"))
    prefixes = F.when(F.size("parts") > 0, F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    path = known.select("page_id", F.lit("paths").alias("list_name"), "host", F.explode(prefixes).alias("rest"))
    digest = F.md5(F.concat("host", "rest").cast("binary"))
    shown = F.when(F.substring(digest, 2, 1) < "8", F.upper("host")).otherwise(F.col("host"))
    listed = domain.unionByName(path).filter(F.substring(digest, 1, 1) < "6").select("page_id", "list_name", F.concat(shown, "rest").alias("pattern"))
    seen = listed.groupBy("list_name", "pattern").agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"))
    start = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("low") * 11, F.lit(300)).cast("int"))
    category = F.when(F.col("high") % 2 == 0, "adult").otherwise("spam")
    added = seen.select("list_name", "pattern", start.alias("effective"), F.lit("add").alias("action"), category.alias("category"))
    removed = seen.filter("high % 4 < 2").select("list_name", "pattern", F.date_add(start, 90).alias("effective"), F.lit("remove").alias("action"), F.lit(None).cast("string").alias("category"))
    back = seen.filter("high % 8 = 0").select("list_name", "pattern", F.date_add(start, 200).alias("effective"), F.lit("add").alias("action"), category.alias("category"))
    return added.unionByName(removed).unionByName(back)


_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"
#: The same judgement in DuckDB, with every key of every page against all intervals of its pattern.
URL_SQL = rf"""
WITH p AS (
  SELECT page_id, url, DATE '2023-01-01' + (((coalesce(page_id, 0) * 37) % 365 + 365) % 365)::INT AS fetched,
         lower(regexp_replace(regexp_extract(coalesce(url, ''), '{_SCHEME}(?:[^/?#@]*@)?([^/?#:@]*)', 1), '\.$', '')) AS host,
         regexp_extract(coalesce(url, ''), '{_SCHEME}[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
h AS (SELECT *, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda z: z <> '') AS f FROM p),
n AS (SELECT page_id, 'domains' AS list_name, host, '' AS rest FROM h WHERE host <> ''
      UNION ALL SELECT page_id, 'paths', host, unnest(list_transform(range(1, len(f) + 1), lambda a: '/' || array_to_string(f[1:a], '/'))) FROM h WHERE host <> ''),
u AS (SELECT page_id, list_name, if(substr(md5(host || rest), 2, 1) < '8', upper(host), host) || rest AS pattern FROM n WHERE substr(md5(host || rest), 1, 1) < '6'),
s AS (SELECT list_name, pattern, max(page_id) AS high, DATE '2023-01-01' + ((min(page_id) * 11) % 300)::INT AS d FROM u GROUP BY ALL),
e AS (SELECT list_name, pattern, d AS effective, 'add' AS action, if(high % 2 = 0, 'adult', 'spam') AS category FROM s
      UNION ALL SELECT list_name, pattern, d + 90, 'remove', NULL FROM s WHERE high % 4 < 2
      UNION ALL SELECT list_name, pattern, d + 200, 'add', if(high % 2 = 0, 'adult', 'spam') FROM s WHERE high % 8 = 0),
i AS (SELECT *, effective AS valid_from, lead(effective) OVER (PARTITION BY list_name, pattern ORDER BY effective) AS valid_to
      FROM (SELECT list_name, lower(split_part(pattern, '/', 1)) || substr(pattern, length(split_part(pattern, '/', 1)) + 1) AS pattern, category, effective, action FROM e)),
x AS (
  SELECT DISTINCT page_id, url, fetched, pattern FROM (
    SELECT page_id, url, fetched, unnest(
      CASE WHEN host = '' THEN [] WHEN len(l) < 2 THEN [host]
           ELSE list_transform(range(1, len(l)), lambda a: array_to_string(l[a:], '.')) END
      || CASE WHEN host = '' THEN [] ELSE list_transform(range(1, len(f) + 1), lambda a: host || '/' || array_to_string(f[1:a], '/')) END) AS pattern
    FROM h)),
a AS (SELECT x.page_id, x.url, x.fetched, i.list_name, i.pattern, i.category, i.valid_from FROM x JOIN i ON x.pattern = i.pattern AND i.action = 'add'
      AND x.fetched >= i.valid_from AND (i.valid_to IS NULL OR x.fetched < i.valid_to)),
b AS (SELECT *, count(*) OVER (PARTITION BY page_id, url, fetched) AS n,
             row_number() OVER (PARTITION BY page_id, url, fetched ORDER BY length(pattern) DESC, list_name, pattern, valid_from) AS r FROM a)
SELECT p.page_id, p.url, p.fetched, p.host, b.n IS NOT NULL AS blocked, coalesce(b.n, 0)::BIGINT AS n_active,
       b.list_name, b.pattern, b.category, b.valid_from
FROM p LEFT JOIN b ON b.r = 1 AND p.page_id IS NOT DISTINCT FROM b.page_id AND p.url IS NOT DISTINCT FROM b.url AND p.fetched = b.fetched
"""
