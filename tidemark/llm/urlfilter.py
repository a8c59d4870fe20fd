"""URL filters over time: dated list entries become validity intervals, and captures are joined as of their fetch time.

A list is a log of (key, category, action, at): key is a domain (example.com, which covers its subdomains) or a domain with a
path prefix (example.com/shop). `add` opens an interval, the next entry of the same key and category closes it. A capture is
tested under every domain suffix and path prefix of its URL against the entries active when it was fetched.

Entries of one moment: the last action by name wins ('remove' after 'add'). Entries with a null key, action or date are ignored;
a null category is one of its own and written ''. Captures without a URL, host or fetch time match nothing; repeated captures
are each returned. A list beyond SENT entries isn't broadcast but joined by key; a key's captures are dealt to SALTS tasks, each of
which gets the key's entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

SENT, SALTS = 200_000, 32  #: most intervals that are broadcast; tasks that share a key's captures beyond that
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """(key, category, since, until): until is null while the entry is still active."""
    clean = entries.filter("key is not null and action is not null and at is not null").select("key", F.coalesce("category", F.lit("")).alias("category"), "action", "at")
    one = clean.groupBy("key", "category", "at").agg(F.max("action").alias("action"))
    log = Window.partitionBy("key", "category").orderBy("at")
    return one.withColumn("until", F.lead("at").over(log)).filter("action = 'add'").select("key", "category", F.col("at").alias("since"), "until")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def keys(url: Column) -> Column:
    """Every domain suffix of two labels or more, and the host with each prefix of its path, without a trailing slash."""
    h = host(url)
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/"), lambda s: s != "")
    prefixes = F.transform(F.slice(F.sequence(F.lit(0), F.size(steps)), 2, F.size(steps) + 1), lambda i: F.concat(h, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))
    return F.when(h == "", F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(F.concat(suffixes, prefixes)))


def judge(captures: DataFrame, active: DataFrame, sent: int = SENT) -> DataFrame:
    """(page_id, url, fetched, n_active, categories, blocked) of each capture."""
    few = active.limit(sent + 1).count() <= sent
    numbered = captures.select("page_id", "url", "fetched", F.monotonically_increasing_id().alias("row_no"), keys(F.col("url")).alias("keys"))
    rows = numbered.select("page_id", "url", "fetched", "row_no", F.explode_outer("keys").alias("key"))
    salts = 1 if few else SALTS
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(salts)).cast("int"))
    active = active.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = (rows["key"] == active["key"]) & (F.col("salt") == F.col("of_salt"))
    hit = rows.join(F.broadcast(active) if few else active, same & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))), "left")
    out = hit.groupBy("row_no").agg(
        *[F.first(c).alias(c) for c in ("page_id", "url", "fetched")],
        F.count("category").alias("n_active"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
    )
    return out.drop("row_no").withColumn("blocked", F.col("n_active") > 0)


# ---- the query's list and fetch times, derived from pages -----------------------------------------------------------


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr("timestamp_seconds(1704067200 + page_id * 7919 % 31536000)").alias("fetched"))


def list_of(pages: DataFrame) -> DataFrame:
    """Every second host by its smallest page_id m is listed, for one of five categories: added on day m * 37 % 300, removed 40
    days later, and every third one added again 80 days later. Every third host has its first path step listed as well."""
    base = pages.select("page_id", host(F.col("url")).alias("h"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1).alias("step")).filter("h <> ''")
    sites = base.groupBy("h").agg(F.min("page_id").alias("m"), F.min_by("step", "page_id").alias("step"))
    named = sites.filter("m % 2 = 0").select(F.col("h").alias("key"), "m").unionByName(sites.filter("m % 3 = 0 and step <> ''").select(F.concat("h", F.lit("/"), "step").alias("key"), (F.col("m") + 1).alias("m")))
    dated = named.withColumn("day", F.expr("m * 37 % 300")).withColumn("category", F.concat(F.lit("list"), (F.col("m") % 5).cast("string")))
    moves = F.expr("filter(array(struct(0 as d, 'add' as action), struct(40 as d, 'remove' as action), struct(if(m % 3 = 0, 80, -1) as d, 'add' as action)), x -> x.d >= 0)")
    return dated.select("key", "category", "day", F.inline(moves)).select("key", "category", "action", F.expr("timestamp_seconds(1704067200 + (day + d) * 86400)").alias("at"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(captures_of(pages), intervals(list_of(pages))).select("page_id", "n_active", "categories", "blocked")


ORACLE = r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS step,
                  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS steps,
                  1704067200 + page_id * 7919 % 31536000 AS fetched FROM pages),
s AS (SELECT h, min(page_id) AS m, arg_min(step, page_id) AS step FROM p WHERE h <> '' GROUP BY h),
named AS (SELECT h AS key, m FROM s WHERE m % 2 = 0 UNION ALL SELECT h || '/' || step, m + 1 FROM s WHERE m % 3 = 0 AND step <> ''),
log AS (SELECT key, 'list' || (m % 5) AS category, action, 1704067200 + (m * 37 % 300 + d) * 86400 AS ts
        FROM named, (VALUES (0, 'add'), (40, 'remove'), (80, 'add')) v(d, action) WHERE d < 80 OR m % 3 = 0),
iv AS (SELECT * FROM (SELECT *, lead(ts) OVER (PARTITION BY key, category ORDER BY ts) AS until FROM log) WHERE action = 'add'),
k AS (SELECT DISTINCT page_id, fetched, unnest(list_concat(
        list_transform(range(1, greatest(len(string_split(h, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(h, '.')[i:], '.')),
        list_transform(range(1, len(steps) + 1), lambda i: h || '/' || array_to_string(steps[1:i], '/')))) AS key FROM p WHERE h <> ''),
hit AS (SELECT page_id, category FROM k JOIN iv ON k.key = iv.key AND fetched >= iv.ts AND (until IS NULL OR fetched < until))
SELECT page_id, count(category) AS n_active, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories, count(category) > 0 AS blocked
FROM pages LEFT JOIN hit USING (page_id) GROUP BY page_id
"""
