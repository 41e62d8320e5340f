"""Operator 10, URL filters as of the fetch (DataFrame functions only).

Dated list entries (list, domain, listed or not, since when) become validity intervals: an entry holds until the next
one of its list and domain. Captures are reduced to different hosts and fetch times, every host to its chain of parent
domains, and an equi-join on the domain with an interval condition finds the entries active at the fetch. The most
specific active domain decides; on a tie the allow list does.

Defined results: a URL that is null or has no host matches nothing and is kept; hosts are lower-case, without user,
port or final dot; of entries of one list, domain and date the last by action holds ("remove" after "add"); an entry
holds from its date on; a null fetch time matches nothing; repeated captures give repeated equal rows;
columns of a capture that are called as a result column, in any case of letters, are replaced by it; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that a verdict adds.
RESULT = ("host", "verdict", "domain", "since")
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def host(url: Column) -> Column:
    found = F.rtrim(F.regexp_extract(F.lower(F.trim(url)), HOST, 1), F.lit("."))
    return F.when(F.length(found) > 0, found)


def domains(name: Column) -> Column:
    """The host and its parent domains, the most specific first."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """list, domain, valid_from, valid_to of what is listed, from (list, domain, action, since) rows."""
    last = entries.filter("since is not null").groupBy("list", "domain", "since").agg(F.max("action").alias("action"))
    until = F.lead("since").over(Window.partitionBy("list", "domain").orderBy("since"))
    return last.withColumn("valid_to", until).filter("action = 'add'").select("list", "domain", F.col("since").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``captures`` with host, verdict ("block", "allow" or "none"), the domain that decided, and since when it holds."""
    own = [c for c in captures.columns if c.lower() not in RESULT]
    rows = captures.select(F.struct(*own).alias("row"), host(F.col(url_col)).alias("host"), F.col(time_col).alias("at"))
    asked = rows.filter(F.col("host").isNotNull()).select("host", "at").distinct()
    chain = asked.select("host", "at", F.posexplode(domains(F.col("host"))).alias("depth", "domain"))
    hit = chain.join(intervals(entries), "domain").filter((F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    best = hit.groupBy("host", "at").agg(F.min(F.struct("depth", "list", "domain", "valid_from")).alias("best"))
    joined = rows.join(best, ["host", "at"], "left")
    return joined.select("row.*", "host", F.coalesce("best.list", F.lit("none")).alias("verdict"), F.col("best.domain").alias("domain"), F.col("best.valid_from").alias("since"))


def sample_lists(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """A dated list for the query, by rule from the domains of the pages: every registrable domain of three labels is
    blocked from a day that its checksum gives, off for a while and on again; some hosts of blocked domains are allowed."""
    seen = pages.select(host(F.col(url_col)).alias("host")).filter("host is not null").distinct().withColumn("domain", F.substring_index("host", ".", -3))
    mark = lambda c, n: (F.conv(F.substring(F.md5(F.encode(c, "utf-8")), 1, 7), 16, 10).cast("int") % n).cast("int")
    day = lambda c, plus: F.date_add(F.lit("2024-01-01").cast("date"), mark(c, 200) + plus)
    blocked = seen.select("domain").distinct().filter((mark(F.col("domain"), 3) == 0) | F.col("domain").rlike("pills|bets"))
    rows = lambda df, name, c, steps: df.select(F.lit(name).alias("list"), F.col(c).alias("domain"), F.explode(F.array(*(F.struct(F.lit(a).alias("action"), day(F.col(c), p).alias("since")) for a, p in steps))).alias("e")).select("list", "domain", "e.action", "e.since")
    block = rows(blocked, "block", "domain", (("add", 0), ("remove", 60), ("add", 120)))
    allow = rows(seen.filter(mark(F.col("host"), 5) == 0), "allow", "host", (("add", 30), ("remove", 150)))
    return block.unionByName(allow)


def fetched(page_id: Column) -> Column:
    """The fetch day that the query gives a page."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(page_id * 37, F.lit(365)).cast("int"))


_MARK = "CAST('0x' || substr(md5({c}), 1, 7) AS BIGINT)"
_DAY = "CAST(DATE '2024-01-01' + CAST(" + _MARK + " % 200 + plus AS INTEGER) AS DATE)"
#: The query's rows in DuckDB.
SQL = rf"""
WITH captures AS (
  SELECT page_id, nullif(rtrim(regexp_extract(lower(trim(url)), '{HOST}', 1), '.'), '') AS host,
    CAST(DATE '2024-01-01' + CAST(((page_id * 37) % 365 + 365) % 365 AS INTEGER) AS DATE) AS fetched FROM pages
), seen AS (
  SELECT DISTINCT host, array_to_string(string_split(host, '.')[-3:], '.') AS domain FROM captures WHERE host IS NOT NULL
), entries AS (
  SELECT 'block' AS list, d AS domain, action, {_DAY.format(c="d")} AS since
  FROM (SELECT DISTINCT domain AS d FROM seen), (VALUES ('add', 0), ('remove', 60), ('add', 120)) s(action, plus)
  WHERE {_MARK.format(c="d")} % 3 = 0 OR regexp_matches(d, 'pills|bets')
  UNION ALL
  SELECT 'allow', host, action, {_DAY.format(c="host")}
  FROM seen, (VALUES ('add', 30), ('remove', 150)) s(action, plus) WHERE {_MARK.format(c="host")} % 5 = 0
), spans AS (
  SELECT *, lead(since) OVER (PARTITION BY list, domain ORDER BY since) AS until FROM entries
), active AS (
  SELECT c.page_id, s.list, s.domain, s.since, len(c.host) - len(s.domain) AS depth
  FROM captures c JOIN spans s ON (c.host = s.domain OR ends_with(c.host, '.' || s.domain))
    AND s.action = 'add' AND s.since <= c.fetched AND (s.until IS NULL OR c.fetched < s.until)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY depth, list) AS place FROM active
)
SELECT c.page_id, c.host, c.fetched, coalesce(b.list, 'none') AS verdict, b.domain, b.since
FROM captures c LEFT JOIN best b ON b.page_id = c.page_id AND b.place = 1
"""
