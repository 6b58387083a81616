"""Operator 7: URL filters by hashed expressions.

A URL is split into host, path and query (scheme, user, port and fragment go, the host is lower-cased). Its expressions
are every suffix of the host of two labels or more, joined with every prefix of the path that ends at a slash, the whole
path, and the path with its query. Rules are expressions too. URLs and rules meet by an equi-join on the first four
bytes of the expressions' SHA-256; the whole digest confirms, and of the rules confirmed one wins: the highest
priority, then the longest expression, then allow before block, then the least rule id.

The expressions themselves are never made: the digest of a suffix is carried on along the path, and its state at each
slash gives that prefix's digest. So the work grows with the URL's length times the host's labels, not with the square
of the length, and what travels is a row of fixed size for each expression, under the URL's own digest.

Cases: a null URL, or one without scheme and host, gets no rule and the action 'none' (all rows come back); a host that
is a number or has one label has itself as its only suffix; rows that repeat are decided each; a rule with a null
expression matches nothing; two rules with one expression are resolved by precedence; URLs are of any length. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES_SCHEMA = "rule_id int, expression string, action string, priority int"
#: Unwanted hosts of `pages`, read off the URLs of the tables in /root/testdata, and the domains they are under there.
FAMILIES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
DOMAINS = ("example.com", "example.net", "example.org")
#: Rules of the query: (rule id, expression, action, priority). Each blocks a family under a domain with all hosts below it.
RULES = tuple((k, f"{family}.{domain}/", "block", 0) for k, (family, domain) in enumerate(((f, d) for f in FAMILIES for d in DOMAINS), 1))

_SHAPE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(\?[^#]*)?"


_URL = re.compile(_SHAPE)
_NUMBER = re.compile(r"[0-9.]+")
_PORT = re.compile(r":[0-9]*\Z")
#: Expressions of a batch that goes on.
ROWS = 1 << 16


def parts(url: str) -> tuple[str, str, str]:
    """(host or '', path, query)."""
    m = _URL.match(url)
    if m is None:
        return "", "/", ""
    host = m[1].rpartition("@")[2]
    port = host.rfind(":")
    host = host[:port] if port >= 0 and _PORT.match(host, port) else host.rstrip(".")
    return host.lower(), m[2] or "/", m[3] or ""


def suffixes(host: str) -> list[str]:
    if not host or _NUMBER.fullmatch(host):
        return [host] if host else []
    dots = [k + 1 for k, c in enumerate(host) if c == "."]
    return [host[k:] for k in (0, *dots[:-1])]


def digests(url: str) -> Iterator[bytes]:
    """The SHA-256 of every expression of a URL, each once."""
    host, path, query = parts(url)
    steps = [x.encode("utf-8", "surrogatepass") for x in path.split("/")]
    for suffix in suffixes(host):
        state = sha256(suffix.encode("utf-8", "surrogatepass"))
        for step in steps[:-1]:
            state.update(step + b"/")
            yield state.digest()
        if steps[-1]:  # else the whole path is the last prefix
            state.update(steps[-1])
            yield state.digest()
        if query:
            state.update(query.encode("utf-8", "surrogatepass"))
            yield state.digest()


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, prefix, digest) of the expressions of URLs (u, url)."""
    names = ["u", "prefix", "digest"]
    for batch in batches:
        us: list[bytes] = []
        found: list[bytes] = []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array([int.from_bytes(d[:4], "big", signed=True) for d in found], pa.int32()), pa.array(found, pa.binary())], names)

        for u, url in zip(batch.column("u").to_pylist(), batch.column("url").to_pylist()):
            for digest in digests(url):
                us.append(u)
                found.append(digest)
                if len(found) == ROWS:
                    yield packed()
                    us, found = [], []
        yield packed()


def decide(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, action, rule_id, expression) of every row."""
    key = F.unhex(F.sha2(F.col("url"), 256))
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumn("u", key)
    urls = source.where("url is not null").groupBy("u").agg(F.first("url").alias("url"))
    asked = urls.mapInArrow(_ask, "u binary, prefix int, digest binary")
    known = rules.where(F.col("expression").isNotNull()).select("rule_id", F.unhex(F.sha2("expression", 256)).alias("full"), F.col("action").alias("does"), "priority", "expression")
    known = known.withColumn("prefix", F.conv(F.hex(F.substring("full", 1, 4)), 16, 10).cast("bigint"))
    known = known.withColumn("prefix", F.when(F.col("prefix") >= 1 << 31, F.col("prefix") - (1 << 32)).otherwise(F.col("prefix")).cast("int"))
    hits = asked.join(known, "prefix").where(F.col("digest") == F.col("full"))
    rank = F.struct(-F.col("priority"), -F.length("expression"), F.col("does") != "allow", "rule_id")
    won = hits.groupBy(F.col("u").alias("w_u")).agg(F.min_by(F.struct("does", "rule_id", "expression"), rank).alias("w"))
    out = source.join(won, F.col("u") == F.col("w_u"), "left")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.coalesce("w.does", F.lit("none")).alias("action"), F.col("w.rule_id").alias("rule_id"), F.col("w.expression").alias("expression"))


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), RULES_SCHEMA)


def oracle() -> str:
    """decide() over pages in DuckDB's SQL."""
    rules = ", ".join(f"({i}, '{e}', '{a}', {p})" for i, e, a, p in RULES)
    shape = _SHAPE
    return f"""
    with rules(rule_id, rule, does, priority) as (values {rules}),
    part as (select distinct url, lower(regexp_replace(regexp_extract(url, '{shape}', 1), '^.*@|:[0-9]*$|\\.+$', '', 'g')) as host,
        case when regexp_extract(url, '{shape}', 2) = '' then '/' else regexp_extract(url, '{shape}', 2) end as path, regexp_extract(url, '{shape}', 3) as query from pages where url is not null),
    cut as (select *, string_split(host, '.') as labels, string_split(path, '/') as steps from part where host <> ''),
    made as (select url, host, path, query, case when regexp_matches(host, '^[0-9.]+$') or len(labels) < 2 then [host] else list_transform(range(1, len(labels)), lambda i: array_to_string(labels[i:], '.')) end as suffixes,
        list_distinct(list_concat(list_transform(range(1, greatest(len(steps), 2)), lambda i: array_to_string(steps[1:i], '/') || '/'), [path, path || query])) as prefixes from cut),
    wide as (select url, prefixes, unnest(suffixes) as s from made),
    asked as (select url, s || p as expression from (select url, s, unnest(prefixes) as p from wide)),
    hits as (select url, expression, does, rule_id, row_number() over (partition by url order by priority desc, length(expression) desc, does, rule_id) as k
        from asked join rules on substr(sha256(expression), 1, 8) = substr(sha256(rule), 1, 8) and sha256(expression) = sha256(rule))
    select page_id, pages.url as url, coalesce(does, 'none') as action, rule_id::int as rule_id, expression from pages left join hits on pages.url = hits.url and k = 1
    """
