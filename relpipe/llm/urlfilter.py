"""URL filters from dated lists, evaluated as of each capture.

List entries (list, scope, key, action, listed_at) become validity intervals: an entry holds from its date until the next
entry of the same list, scope and key; a "remove" only ends the one before. A capture has one key for its host, one for
each domain above it, and one for each path prefix. An as-of join finds the entries active at fetch time: intervals and
captures meet on key and period of time, so that neither a busy host nor a long-lived list gathers in one place. The most
specific entry decides; of equally specific ones, blocking wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SCOPES = ("domain", "host", "prefix")
#: By strength at equal times and equal specificity.
ACTIONS = ("remove", "allow", "block")
#: Days of one period.
PERIOD = 60
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^?#]*)?"


def host_of(url: Column) -> Column:
    """The lower-case host; null where the url has none."""
    host = F.lower(F.rtrim(F.regexp_extract(url, URL, 1), F.lit(".")))
    return F.when(host != "", host)


def _period(day: Column) -> Column:
    return F.floor(F.unix_date(day.cast("date")) / PERIOD)


def validity(entries: DataFrame) -> DataFrame:
    """(list, scope, key, action, listed_at, until) of each entry in force; until is exclusive, null while it holds.

    Keys are lower-cased first, so entries that differ in case only are entries of one key. Repeated entries count once; of
    several at one time for one key the strongest action counts (block, allow, remove). Entries with a null, or an unknown
    scope or action, are refused.
    """
    rank = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    wrong = F.greatest(*[F.col(c).isNull() for c in ("list", "scope", "key", "action", "listed_at")]) | (rank == 0) | ~F.col("scope").isin(*SCOPES)
    checked = entries.select("*", F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.lit("a list entry is not valid"))).cast("boolean").alias("__wrong"))
    single = checked.filter(F.col("__wrong").isNull()).withColumn("key", F.lower("key")).groupBy("list", "scope", "key", "listed_at").agg(F.max(rank).alias("rank"))
    after = Window.partitionBy("list", "scope", "key").orderBy("listed_at")
    timed = single.withColumn("until", F.lead("listed_at").over(after)).filter("rank > 1")
    return timed.select("list", "scope", "key", F.get(F.array(*[F.lit(a) for a in ACTIONS]), (F.col("rank") - 1).cast("int")).alias("action"), "listed_at", "until")


def _keys(host: Column, path: Column, depths: list[int]) -> Column:
    """All (scope, key, specificity) that may list a capture; prefixes of the given numbers of segments."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("domain").alias("scope"), F.array_join(F.slice(labels, i, n), ".").alias("key"), (n - i).cast("int").alias("specific")))
    exact = F.array(F.struct(F.lit("host").alias("scope"), host.alias("key"), F.lit(1000).alias("specific")))
    parts = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, max(depths, default=0))
    wanted = F.filter(F.array(*[F.lit(d) for d in depths]).cast("array<int>"), lambda i: i <= F.size(parts))
    prefixes = F.transform(wanted, lambda i: F.struct(F.lit("prefix").alias("scope"), F.concat(host, F.lit("/"), F.lower(F.array_join(F.slice(parts, 1, i), "/"))).alias("key"), (i + 1000).cast("int").alias("specific")))
    return F.concat(domains, exact, prefixes)


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", broadcast_rows: int = 50_000) -> DataFrame:
    """One row per capture: id, url, fetch time, host, verdict and the deciding entry's list, key and date.

    Verdicts: blocked, allowed (by an entry), unlisted, and invalid where the url is null or has no host. A null fetch
    time is before all entries: unlisted. Repeated captures keep their rows. Other columns are not read. Prefixes and paths
    may have any number of segments; a prefix lists the captures whose first segments are its own.
    """
    url = F.col(url_col)
    rows = captures.select(F.col(id_col).alias("id"), url.alias("url"), F.col(time_col).alias("at"), host_of(url).alias("host"), F.regexp_extract(url, URL, 2).alias("path"))
    span = captures.agg(F.min(time_col).alias("low"), F.max(time_col).alias("high")).select(_period(F.col("low")).alias("low"), _period(F.col("high")).alias("high")).first()
    low, high = (0, -1) if span.low is None else (span.low, span.high)
    first, last = F.greatest(_period(F.col("listed_at")), F.lit(low)), F.least(F.coalesce(_period(F.col("until")), F.lit(high)), F.lit(high))
    held = validity(entries).withColumn("first", first).withColumn("last", last).filter("first <= last")
    held = materialize(held.select(F.explode(F.sequence("first", "last")).alias("period"), "list", "scope", "key", "action", "listed_at", "until"))
    # a capture is given prefixes of just the lengths that the lists have, few as they are
    segments = F.size(F.split("key", "/")) - 1
    depths = sorted(r.n for r in held.filter("scope = 'prefix'").select(segments.alias("n")).distinct().collect())
    keyed = rows.filter(F.col("host").isNotNull() & F.col("at").isNotNull()).select("id", "url", "at", _period(F.col("at")).alias("period"), F.explode(_keys(F.col("host"), F.col("path"), depths)).alias("k")).select("id", "url", "at", "period", "k.*")
    side = F.broadcast(held) if held.count() <= broadcast_rows else held
    hits = keyed.join(side, ["scope", "key", "period"]).filter((F.col("at") >= F.col("listed_at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    strength = (F.col("action") == "block").cast("int").alias("strength")
    best = F.struct("specific", strength, F.col("list").alias("list"), "scope", F.col("key").alias("key"), F.col("listed_at").alias("listed_at"))
    marks = rows.select("id", "url", "at", F.lit(1).alias("n"), F.lit(None).cast(hits.select(best.alias("b")).schema["b"].dataType).alias("best"))
    # each capture is one row with its hits beside it; the maximum over both is one partial aggregate and one exchange
    decided = marks.unionByName(hits.select("id", "url", "at", F.lit(0).alias("n"), best.alias("best"))).groupBy("id", "url", "at").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    host = host_of(F.col("url"))
    verdict = F.when(host.isNull(), "invalid").when(F.col("best").isNull(), "unlisted").when(F.col("best.strength") == 1, "blocked").otherwise("allowed")
    out = decided.select("id", "url", "at", host.alias("host"), verdict.alias("verdict"), F.col("best.list").alias("list"), F.col("best.key").alias("list_key"), F.col("best.listed_at").alias("listed_at"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")
    return out.withColumnsRenamed({"id": id_col, "url": url_col, "at": time_col})


def made_captures(pages: DataFrame) -> DataFrame:
    """Pages with fetch dates made from their ids, since the test tables have none: some day of two years."""
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(730)).cast("int")).alias("fetched_at"))


def made_entries(pages: DataFrame) -> DataFrame:
    """Dated lists made from the hosts of pages: for each host, the domain above it and each section of it, a few entries
    with dates and actions from an md5, every second one in upper case."""
    found = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", URL, 2).alias("path")).filter("host IS NOT NULL")
    keys = found.select(F.explode(F.array(
        F.struct(F.lit("hosts").alias("list"), F.lit("host").alias("scope"), F.col("host").alias("key"), F.lit(6).alias("n")),
        F.struct(F.lit("domains").alias("list"), F.lit("domain").alias("scope"), F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1).alias("key"), F.lit(4).alias("n")),
        F.struct(F.lit("sections").alias("list"), F.lit("prefix").alias("scope"), F.concat("host", F.lit("/"), F.lower(F.regexp_extract("path", "^/([^/]+)", 1))).alias("key"), F.lit(3).alias("n")),
    )).alias("k")).select("k.*").filter((F.col("key") != "") & ~F.col("key").endswith("/")).distinct()
    dated = keys.select("list", "scope", "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    m = F.conv(F.substring(F.md5(F.concat_ws("|", "list", "key", F.col("i").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return dated.select("list", "scope", F.when(F.col("i") % 2 == 0, F.upper("key")).otherwise(F.col("key")).alias("key"), F.get(F.array(*[F.lit(a) for a in ACTIONS]), (m % 3).cast("int")).alias("action"), F.date_add(F.lit("2022-10-01").cast("date"), (F.floor(m / 3) % 800).cast("int")).alias("listed_at"))


ORACLE_SQL = r"""
WITH parsed AS (
  SELECT page_id, url, lower(rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^?#]*)?', 1), '.')) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^?#]*)?', 2) AS path,
    (DATE '2023-01-01' + ((page_id * 7919) % 730)::INTEGER) AS fetched_at
  FROM pages),
keys AS (
  SELECT 'hosts' AS list, 'host' AS scope, host AS key, 6 AS n FROM parsed WHERE host <> ''
  UNION SELECT 'domains', 'domain', regexp_extract(host, '^[^.]+\.([^.]+\..+)$', 1), 4 FROM parsed WHERE host <> ''
  UNION SELECT 'sections', 'prefix', host || '/' || lower(regexp_extract(path, '^/([^/]+)', 1)), 3 FROM parsed WHERE host <> ''),
hashed AS (
  SELECT list, scope, CASE WHEN i % 2 = 0 THEN upper(key) ELSE key END AS key, ('0x' || substr(md5(list || '|' || key || '|' || i), 1, 8))::BIGINT AS m
  FROM keys JOIN (SELECT range AS i FROM range(1, 7)) r ON i <= n WHERE key <> '' AND right(key, 1) <> '/'),
entries AS (
  SELECT list, scope, lower(key) AS key, DATE '2022-10-01' + ((m // 3) % 800)::INTEGER AS listed_at, max(m % 3) AS strength
  FROM hashed GROUP BY 1, 2, 3, 4),
timed AS (SELECT *, lead(listed_at) OVER (PARTITION BY list, scope, key ORDER BY listed_at) AS until FROM entries),
candidates AS (
  SELECT page_id, url, fetched_at, 'host' AS scope, host AS key, 1000 AS specific FROM parsed WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched_at, 'domain', array_to_string(string_split(host, '.')[i:], '.'), len(string_split(host, '.')) - i
    FROM parsed JOIN (SELECT range AS i FROM range(1, 20)) r ON i <= len(string_split(host, '.')) WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched_at, 'prefix', host || '/' || lower(array_to_string(string_split(trim(path, '/'), '/')[1:i], '/')), 1000 + i
    FROM parsed JOIN (SELECT range AS i FROM range(1, 9)) r ON i <= len(string_split(trim(path, '/'), '/')) WHERE host <> '' AND trim(path, '/') <> ''),
ranked AS (
  SELECT c.page_id, c.url, c.fetched_at, t.list, t.key, t.listed_at, t.strength,
    row_number() OVER (PARTITION BY c.page_id ORDER BY c.specific DESC, t.strength DESC, t.list DESC, t.scope DESC, t.key DESC, t.listed_at DESC) AS place
  FROM candidates c JOIN timed t ON t.scope = c.scope AND t.key = c.key AND c.fetched_at >= t.listed_at AND (t.until IS NULL OR c.fetched_at < t.until)
  WHERE t.strength > 0)
SELECT p.page_id, p.url, p.fetched_at, CASE WHEN p.host <> '' THEN p.host END AS host,
  CASE WHEN p.host IS NULL OR p.host = '' THEN 'invalid' WHEN r.list IS NULL THEN 'unlisted' WHEN r.strength = 2 THEN 'blocked' ELSE 'allowed' END AS verdict,
  r.list, r.key AS list_key, r.listed_at
FROM parsed p LEFT JOIN ranked r ON r.page_id = p.page_id AND r.place = 1
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(made_captures(pages), made_entries(pages))
