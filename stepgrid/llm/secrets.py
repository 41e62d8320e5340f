"""Operator 6, secret scans with corpus-wide ownership frequency (DataFrame functions only).

Candidates are found by kind in every whole text. Their hashed values are counted over the corpus by distinct
repositories and owners: a value that several owners hold is a widely copied example, one of few owners that looks
random is a live credential.

A private key is one span from its BEGIN to its END line, and its value is the body between them.

Defined results: a null text is the empty text and has no spans; a private key without END line ends with its base64
lines; a null repository or owner counts as one of its own;
positions are code points, ends exclusive; spans of different kinds may overlap; repeated rows give repeated equal rows;
whole texts are read, whatever their length; an empty table gives no rows; other columns, of whatever name, stay apart
from the result (``report``) or as they are (``redact``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, keyed, materialise

#: Owners that must hold a value before it is an example, and bits a character that a live value has at least.
EXAMPLE_OWNERS, LIVE_BITS = 3, 2.5

# The base kinds with what they match, and further public formats.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# A private key runs from its BEGIN to its END line or, where no END line comes before the next dashes, to the end of the
# base64 lines; line breaks may be written as escapes. Repeats of groups are possessive, so no text is scanned twice.
KEY_HEAD, KEY_END = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----END [A-Z ]*PRIVATE KEY-----"
_BLANK = r"(?:\s|\\[nrt])"
_LINE = r"(?:\r\n?|\n|\\r\\n|\\[nr])[\x20\t]*+[A-Za-z0-9+/]++={0,2}+(?=[\x20\t]*+(?:[\r\n\\]|\z))"
KEY = (
    rf"{KEY_HEAD}(?:(?:[^-]++|-(?!----))*+{KEY_END}"
    rf"|(?:{_BLANK}*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:{_BLANK}*+[A-Za-z0-9+/=]{{16,}}+|{_LINE})*+)"
)
# Of the places in a run where a token could start only the first can match: later ones close by are passed over.
TOKEN = r"eyJ(?<!eyJ[A-Za-z0-9_-]{0,252}eyJ)[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"
FORMAT = rf"{KEY}|gh[pousr]_[A-Za-z0-9]{{36,}}+|xox[abprs]-[A-Za-z0-9-]{{10,}}+|{TOKEN}"
KINDS = ("assign", "access", "hex", "format")
BASE = 3
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _matches(text: Column, pattern: str, kind: int, group: int) -> Column:
    """Spans of the leftmost non-overlapping matches: lengths of what lies between them give the positions."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.cast("bigint").alias("at"), F.when(x["hit"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span).cast(_SPAN))).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step, lambda acc: acc["spans"])).otherwise(F.array().cast(_SPAN))


def key_body(hit: Column) -> Column:
    """What tells a private key from others: its text without the BEGIN and END lines and line breaks (a bare BEGIN line
    is its own value). Other hits are their own values."""
    body = F.regexp_replace(hit, rf"^{KEY_HEAD}|{KEY_END}$|{_BLANK}", "")
    return F.when(hit.startswith("-----BEGIN ") & (body != ""), body).otherwise(hit)


def spans(text: Column) -> Column:
    """All spans of a text in order of start, then kind: array of (start, kind, end, value)."""
    text = F.coalesce(text, F.lit(""))
    assign = F.filter(_matches(text, ASSIGN, 0, 1), lambda x: F.length(x["value"]) >= 6)
    formats = F.transform(_matches(text, FORMAT, 3, 0), lambda x: x.withField("value", key_body(x["value"])))
    return F.array_sort(F.concat(assign, _matches(text, ACCESS, 1, 0), _matches(text, HEX, 2, 0), formats))


def joined(found: Column, most: int = len(KINDS)) -> Column:
    """kind:start:end of the spans of the first ``most`` kinds, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.filter(found, lambda x: x["kind"] < most), lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def bits(value: Column) -> Column:
    """Shannon entropy of the characters of a whole value, in bits a character: from the lengths of the runs that equal
    characters form once sorted."""
    parts = F.sort_array(F.filter(F.split(value, ""), lambda c: c != ""))
    weight = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(0.0)
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        same = acc["last"] == c
        return F.struct(
            c.alias("last"), F.when(same, acc["run"] + 1).otherwise(1.0).alias("run"),
            F.when(same, acc["sum"]).otherwise(acc["sum"] + weight(acc["run"])).alias("sum"), (acc["n"] + 1).alias("n"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["n"] > 0, F.log2(acc["n"]) - (acc["sum"] + weight(acc["run"])) / acc["n"]).otherwise(0.0))


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, repositories, owners, kind of owner ("example", "live" or "plain") and occurrences (``size``) of every
    candidate value, from (hash, random, repo, owner) rows. Rows are reduced before each shuffle, so no value gathers its
    copies in a task."""
    once = candidates.groupBy("hash", "repo", "owner").agg(F.max("random").alias("random"), F.count(F.lit(1)).alias("size"))
    by_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.max("random").alias("random"), F.sum("size").alias("size"))
    counted = by_owner.groupBy("hash").agg(F.sum("repos").alias("repositories"), F.count(F.lit(1)).alias("owners"), F.max("random").alias("random"), F.sum("size").alias("size"))
    return counted.withColumn("owned", F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").when(F.col("random"), "live").otherwise("plain")).drop("random")


@dataclass
class Scan:
    """``found``: row key, doc_id and spans of every document; ``owned``: what the corpus says of each value."""

    found: DataFrame
    owned: DataFrame

    def judged(self, each: DataFrame, owned: DataFrame) -> DataFrame:
        """Rows with a hash joined with what the corpus says of it; a value that very many hold does not fill a task."""
        total = self.owned.agg(F.sum("size")).first()[0] or 0
        return attach(each, owned.select("hash", "owned", "size"), "hash", total).drop("size")

    def by_document(self) -> DataFrame:
        """key, n_example and n_live of the documents with candidates."""
        each = self.found.filter(F.size("spans") > 0).dropDuplicates(["key", "key2"]).select("key", "key2", F.explode("spans").alias("s"))
        each = each.select("key", "key2", F.sha2(F.col("s.value"), 256).alias("hash")).groupBy("key", "key2", "hash").agg(F.count(F.lit(1)).alias("n"))
        sums = [F.sum(F.when(F.col("owned") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in ("example", "live")]
        return self.judged(each, self.owned).groupBy("key", "key2").agg(*sums)


def candidates(found: DataFrame) -> DataFrame:
    """(hash, random, repo, owner) of every span of (repo, owner, spans) rows."""
    each = found.filter(F.size("spans") > 0).select("repo", "owner", F.explode("spans").alias("s"))
    return each.select(F.sha2(F.col("s.value"), 256).alias("hash"), (bits(F.col("s.value")) >= LIVE_BITS).alias("random"), "repo", "owner")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", corpus: DataFrame | None = None) -> Scan:
    """Find candidates and count their owners, in ``docs`` and in ``corpus`` (with the same columns) where one is given.
    What is kept of a document is its spans, not its text."""
    found = materialise(docs.select(*keyed(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), spans(F.col(text_col).cast("string")).alias("spans")))
    each = candidates(found)
    if corpus is not None:
        each = each.unionByName(candidates(corpus.select(F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), spans(F.col(text_col).cast("string")).alias("spans"))))
    return Scan(found, materialise(ownership(each)))


def report(scanned: Scan) -> DataFrame:
    """doc_id, counts and digests of the spans of every document, with its examples and live-looking credentials."""
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    rows = scanned.found.select("key", "key2", "doc_id", *map(count, range(BASE)), F.sha2(joined(F.col("spans"), BASE), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
    none, some = rows.filter("spans = ''"), rows.filter("spans != ''").join(scanned.by_document(), ["key", "key2"])
    both = none.withColumns({"n_example": F.lit(0).cast("long"), "n_live": F.lit(0).cast("long")}).unionByName(some)
    return both.drop("key", "key2")


def redact(docs: DataFrame, placeholder: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", corpus: DataFrame | None = None) -> DataFrame:
    """``docs`` with every credential that isn't a widely copied example replaced; all rows and columns stay. Only
    documents with candidates are shuffled. Owners are counted in ``corpus`` too, where copies of ``docs`` may be."""
    scanned = scan(docs, id_col, text_col, repo_col, owner_col, corpus)
    each = scanned.found.filter(F.size("spans") > 0).dropDuplicates(["key", "key2"]).select("key", "key2", F.explode("spans").alias("s"))
    each = scanned.judged(each.select("key", "key2", "s", F.sha2(F.col("s.value"), 256).alias("hash")), scanned.owned.filter("owned != 'example'"))
    secret = each.groupBy("key", "key2").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.end"))).alias("cuts"))
    any_kind = F.coalesce(F.col(text_col), F.lit("")).rlike("|".join(f"(?:{p})" for p in (ASSIGN, ACCESS, HEX, FORMAT)))
    plain = docs.filter(~any_kind)
    suspect = docs.filter(any_kind).select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"), *keyed(id_col, text_col)).join(secret, ["key", "key2"], "left")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.col("text").substr((acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(placeholder))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    tail = lambda acc: F.concat(acc["out"], F.col("text").substr((acc["at"] + 1).cast("int"), F.length("text")))
    new = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.aggregate("cuts", start, step, tail))
    return plain.unionByName(suspect.select(F.col("row").withField(text_col, new).alias("row")).select("row.*"))


def _sql() -> str:
    """The query's rows in DuckDB. Its patterns have no look-around or possessive repeats, so private keys are left out
    (the data tables hold none) and tokens are found without a bound on their starts."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    quote = "[\"'']?"
    patterns = (
        (rf"(?:{names}){quote}\x20*[:=]\x20*{quote}([A-Za-z0-9+/_.=-]+)", 1, 6), (ACCESS, 0, 0), (HEX, 0, 0),
        (r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    )
    parts = " UNION ALL ".join(
        f"SELECT r, {k} AS kind, {least} AS least, unnest(range(1, len(string_split_regex(text, '{p}')) + 1)) AS i, unnest(string_split_regex(text, '{p}')) AS gap,"
        f" unnest(regexp_extract_all(text, '{p}', 0)) AS hit, unnest(regexp_extract_all(text, '{p}', {group})) AS val FROM t WHERE regexp_matches(text, '{p}')"
        for k, (p, group, least) in enumerate(patterns)
    )
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), parts AS ({parts}), placed AS (
  SELECT r, kind, least, hit, val, CAST(sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop FROM parts
), spans AS (
  SELECT r, kind, stop - length(hit) AS start, stop, val FROM placed WHERE hit IS NOT NULL AND length(val) >= least
), letters AS (
  SELECT val, c, count(*) AS n FROM (SELECT val, unnest(string_split(val, '')) AS c FROM (SELECT DISTINCT val FROM spans)) GROUP BY val, c
), entropy AS (
  SELECT val, log2(sum(n)) - sum(n * log2(n) ORDER BY c) / sum(n) AS bits FROM letters GROUP BY val
), owned AS (
  SELECT s.val, count(DISTINCT coalesce('=' || source, '')) AS owners FROM spans s JOIN t USING (r) GROUP BY s.val
), judged AS (
  SELECT s.*, ['{"', '".join(KINDS)}'][kind + 1] || ':' || start || ':' || stop AS name, owners >= {EXAMPLE_OWNERS} AS example, owners < {EXAMPLE_OWNERS} AND bits >= {LIVE_BITS} AS live
  FROM spans s JOIN owned USING (val) JOIN entropy USING (val)
), found AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(string_agg(name, ',' ORDER BY start, kind) FILTER (kind < {BASE}), '') AS base, string_agg(name, ',' ORDER BY start, kind) AS spans,
    count(*) FILTER (example) AS n_example, count(*) FILTER (live) AS n_live FROM judged GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live FROM t LEFT JOIN found USING (r)
"""


SQL = _sql()
