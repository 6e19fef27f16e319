"""URL filters: rules indexed by their rarest literal token.

A rule that fits a url has its literal tokens (whole runs of ASCII letters and digits) in the
url's tokens.  Each rule is put under that one of its tokens which the fewest urls have, counted
over all of them; a url's tokens fetch candidate rules by an equi-join, and only candidates are
compared (site rules) or run their regular expression (patterns).  A rule without a whole token
is a candidate of every url.

Site rules ``host/path`` fit the host and its subdomains where the url's path starts with the
rule's; the longest wins.  Patterns are globs over the whole url in small letters: ``*`` is any
text, ``^`` a separator or the end, ``||`` in front a place where a host label begins, ``|`` in
front or at the end the url's own begin or end.  Where no site rule fits, a pattern that allows
beats one that blocks, and a url without any is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .linededup import LOWER, UPPER

RULES = "kind string, rule string, verdict string"

#: The site rules of the query.
SITE_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Pages without prose of their own: shops' and accounts' forms, listings, files, advert hosts.
PATTERNS = [
    ("||ads.", "block"), ("||adserver.", "block"), ("||doubleclick.", "block"), ("-bets.", "block"), ("-casino.", "block"), ("||casino.", "block"), ("||login.", "block"), ("||accounts.", "block"),
    ("/cart^", "block"), ("/checkout^", "block"), ("/login^", "block"), ("/signin^", "block"), ("/signup^", "block"), ("/wp-login", "block"), ("/wp-admin/", "block"), ("/tag/*/page/", "block"), ("/search?", "block"),
    ("?add-to-cart=", "block"), ("&add-to-cart=", "block"), ("?sessionid=", "block"), ("&sessionid=", "block"), ("?replytocom=", "block"), ("&replytocom=", "block"), (".exe|", "block"), (".zip|", "block"), (".mp4|", "block"), (".jpg|", "block"),
    ("/help/*login^", "allow"), ("||docs.*/login^", "allow"),
]
WORD = "[a-z0-9]+"
SEPARATOR = "(?:[^a-z0-9_.%-]|$)"


def small(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in small letters) and path of a url; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return small(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a url, and the empty one that every url has."""
    return F.array_distinct(F.concat(F.regexp_extract_all(small(F.coalesce(url, F.lit(""))), F.lit(WORD), F.lit(0)), F.array(F.lit(""))))


def compiled(rules: DataFrame) -> DataFrame:
    """``kind, rule, verdict, regex, tokens`` of distinct rules; one that both allows and blocks blocks.

    tokens are those that every url has whole which the rule fits: a run of letters and digits at
    an open end may go on in the url.  Null rules and rules of another kind fit nothing.
    """
    one = rules.where("kind in ('site', 'pattern') and rule is not null").groupBy("kind", "rule").agg(F.max("verdict").alias("verdict"))
    low = small(F.col("rule"))
    bare = F.regexp_replace(low, r"^\|{1,2}|\|$", "")
    body = F.replace(F.replace(F.regexp_replace(bare, r"([.+?$(){}|\[\]\\-])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(SEPARATOR))
    begin = F.when(low.startswith("||"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?").when(low.startswith("|"), "^").otherwise("")
    end = F.when(low.endswith("|"), "$").otherwise("")
    open_ended = F.concat(F.when(low.startswith("|"), "").otherwise("*"), bare, F.when(low.endswith("|"), "").otherwise("*"))
    whole = F.regexp_extract_all(open_ended, F.lit(rf"(?<![a-z0-9*]){WORD}(?![a-z0-9*])"), F.lit(0))
    closed = F.regexp_extract_all(low, F.lit(rf"{WORD}(?=[^a-z0-9])"), F.lit(0))  # a site rule begins where a label does
    site = F.col("kind") == "site"
    return one.select("kind", "rule", "verdict", F.when(~site, F.concat(begin, body, end)).alias("regex"), F.array_distinct(F.when(site, closed).otherwise(whole)).alias("tokens"))


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``token, kind, rule, verdict, regex``: every rule under the token of it that the fewest of ``urls(url)`` have.

    Rules and index are written tables: Spark knows their size, and broadcasts them only below its
    own threshold.
    """
    spelled = staged(compiled(rules).select("kind", "rule", "verdict", "regex", F.explode_outer("tokens").alias("token")), "url-rules")
    wanted = spelled.where("token is not null").select("token").distinct()
    used = urls.select(F.explode(tokens_of(F.col("url"))).alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min(F.when(F.col("token").isNotNull(), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")))
    rated = spelled.join(used, "token", "left").groupBy("kind", "rule", "verdict", "regex").agg(rarest.alias("r"))
    return staged(rated.select(F.coalesce("r.token", F.lit("")).alias("token"), "kind", "rule", "verdict", "regex"), "url-index")


def fits(url: str, host: str, path: str) -> Column:
    """If the candidate rule of a row fits: hosts and paths are compared, patterns run."""
    site_host, site_path = small(F.regexp_extract("rule", r"^([^/]*)", 1)), F.regexp_extract("rule", r"^[^/]*(.*)$", 1)
    of_site = (F.col(host) == site_host) | F.endswith(F.col(host), F.concat(F.lit("."), site_host))
    return F.when(F.col("kind") == "site", of_site & F.startswith(F.col(path), site_path)).otherwise(F.rlike(small(F.coalesce(url, F.lit(""))), F.col("regex")))


def judged(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, url, host, path, rule, verdict, pattern`` of every row of ``pages``.

    rule: the longest site rule that fits (of equal length the first in byte order), else null;
    pattern: if a pattern decided.  Null urls have an empty host and path and are allowed unless
    a pattern fits the empty text; rows with null or equal keys and urls stay, each with its
    verdict; an empty table gives no rows, without rules all is allowed; other columns stay behind.
    Rows of one key and url count as one within a piece of the input, so that copies of a url
    neither meet in one task nor are lost.
    """
    urls = pages.select(F.col(key).alias("key"), F.col("url").cast("string").alias("url"))
    host, path = parts_of(F.col("url"))
    # a token of its own that no rule has stands for the url, and lets urls without candidates pass
    own = F.concat(F.lit("#"), F.xxhash64("key", "url").cast("string"))
    tokens = F.explode(F.concat(tokens_of(F.col("url")), F.array(own)))
    asked = urls.select("key", "url", F.spark_partition_id().alias("piece"), host.alias("host"), path.alias("path"), tokens.alias("token"))
    met = asked.join(rule_index(rules, urls), "token", "left").where(fits("url", "host", "path") | F.startswith("token", F.lit("#")))
    site = F.min(F.when(F.col("kind") == "site", F.struct((-F.char_length("rule")).alias("n"), "rule", "verdict")))
    of = lambda verdict: F.coalesce(F.max((F.col("kind") == "pattern") & (F.col("verdict") == verdict)), F.lit(False))
    one = met.groupBy("key", "url", "piece", "host", "path").agg(site.alias("site"), of("allow").alias("allows"), of("block").alias("blocks"), F.count_if(F.startswith("token", F.lit("#"))).cast("int").alias("n"))
    pattern = F.col("site").isNull() & (F.col("allows") | F.col("blocks"))
    verdict = F.coalesce("site.verdict", F.when(F.col("blocks") & ~F.col("allows"), "block"), F.lit("allow"))
    return one.select(F.col("key").alias(key), "url", "host", "path", F.col("site.rule").alias("rule"), verdict.alias("verdict"), pattern.alias("pattern"), F.explode(F.sequence(F.lit(1), "n")).alias("copy")).drop("copy")


def production_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("site", r, v) for r, v in SITE_RULES] + [("pattern", r, v) for r, v in PATTERNS], RULES)


OP12_SQL = r"""
WITH rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
patterns(regex, verdict) AS (VALUES
  ('^[a-z][a-z0-9+.-]*://([^/?#]*\.)?(ads|adserver|doubleclick|casino|login|accounts)\.', 'block'), ('-(bets|casino)\.', 'block'),
  ('/(cart|checkout|login|signin|signup)([^a-z0-9_.%-]|$)', 'block'), ('/wp-(login|admin/)', 'block'), ('/tag/.*/page/', 'block'), ('/search[?]', 'block'),
  ('[?&](add-to-cart|sessionid|replytocom)=', 'block'), ('\.(exe|zip|mp4|jpg)$', 'block'),
  ('/help/.*login([^a-z0-9_.%-]|$)', 'allow'), ('^[a-z][a-z0-9+.-]*://([^/?#]*\.)?docs\..*/login([^a-z0-9_.%-]|$)', 'allow')
), places AS (
  SELECT page_id, coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS low,
         translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT page_id, host, path, r.rule, CASE WHEN r.rule IS NOT NULL THEN r.verdict WHEN p.verdict = 'block' THEN 'block' ELSE 'allow' END AS verdict
FROM places
LEFT JOIN LATERAL (SELECT rule, verdict FROM rules WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
  AND starts_with(path, substr(rule, instr(rule, '/'))) ORDER BY length(rule) DESC, rule LIMIT 1) r ON true
LEFT JOIN LATERAL (SELECT min(verdict) AS verdict FROM patterns WHERE regexp_matches(low, regex)) p ON true
"""


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), production_rules(spark)).select("page_id", "host", "path", "rule", "verdict")
