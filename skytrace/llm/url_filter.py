"""URL filter: pattern rules indexed by their rarest literal token, in DataFrame functions only.

A rule is a pattern over host and rest of a URL: ``*`` stands for anything, ``^`` for a separator or the end, ``||`` at the start for the start
of the host or of one of its labels, ``|`` at the start or end for the URL's. A run of letters and digits that the pattern bounds on both
sides is a literal token: each URL that fits holds it as a whole token. Tokens of all distinct URLs are counted, and every rule is filed
under its rarest one. A URL fetches the rules filed under its own tokens, and only those run their regular expression. Rules without a
literal token are filed under the empty token, which every URL has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.llm.common import LOOKUP_ROWS, lookup
from skytrace.session import store

ALLOW, BLOCK = "allow", "block"
TOKEN = "[A-Za-z0-9]+"
SALTS = 16  # parts of a token's rules where rules are too many to broadcast
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The site rules (verdict, host, path), which go before all others; the longest that fits wins.
SITES = ((ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/"))
# Patterns of pages that hold little text of their own: they decide where no site rule fits.
PATTERNS = (
    (BLOCK, "||spam-farm."), (BLOCK, "/wp-admin/"), (BLOCK, "/login^"), (BLOCK, "/cart^"), (BLOCK, "/checkout^"), (BLOCK, "?*sessionid="), (BLOCK, "/tag/*/page/"),
    (BLOCK, "||ads."), (BLOCK, "/casino-"), (BLOCK, "?*utm_source=*&utm_medium="), (ALLOW, "||docs.*/login^"),
)


def site_rules(spark: SparkSession, sites=SITES) -> DataFrame:
    """Rules of a host with all its subdomains and the start of a path; named host and path."""
    rows = [(f"{host}{path}", f"||{host}{path or '|'}", verdict, 0) for verdict, host, path in sites]
    return spark.createDataFrame(rows, "name string, pattern string, verdict string, tier int")


def pattern_rules(spark: SparkSession, patterns=PATTERNS) -> DataFrame:
    return spark.createDataFrame([(p, p, verdict, 1) for verdict, p in patterns], "name string, pattern string, verdict string, tier int")


def regex(pattern: Column) -> Column:
    """The regular expression of a pattern over host and rest of a URL.

    Between two stars the first place that fits is as good as any later one, so no part is tried again once it is found: a long URL
    takes time in proportion to its length, however many stars a pattern has.
    """
    labels, start, end = pattern.startswith("||"), pattern.startswith("|"), pattern.endswith("|") & (F.length(pattern) > 1)
    body = F.substr(pattern, F.when(labels, 3).when(start, 2).otherwise(1))
    body = F.when(end & (F.length(body) > 0), F.substr(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    plain = F.regexp_replace(body, r"([\\.+?{}()\[\]$|])", r"\\$1")
    parts = F.split(F.regexp_replace(plain, r"\^", r"(?:[^A-Za-z0-9_.%-]|\\z)"), r"\*+")
    head = F.when(labels, r"(?:|[^/?#]*?\.)").when(start, "").otherwise(".*?")
    first, last, whole = F.get(parts, F.lit(0)), F.element_at(parts, -1), F.size(parts) == 1
    middle = F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.concat(F.lit("(?>.*?"), x, F.lit(")"))), "")
    close = F.when(end, F.concat(F.lit(".*"), last, F.lit(r"\z"))).otherwise(F.concat(F.lit("(?>.*?"), last, F.lit(")")))
    one = F.concat(F.lit("(?s)^"), head, first, F.when(end, r"\z").otherwise(""))
    return F.when(whole, one).otherwise(F.concat(F.lit("(?s)^(?>"), head, first, F.lit(")"), middle, close))


def literal_tokens(pattern: Column) -> Column:
    """The distinct literal tokens of a pattern."""
    open_ended = F.concat(F.when(pattern.startswith("|"), pattern).otherwise(F.concat(F.lit("*"), pattern)), F.when(pattern.endswith("|"), "").otherwise("*"))
    return F.array_distinct(F.regexp_extract_all(open_ended, F.lit("(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])"), F.lit(0)))


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, host with all that follows it) of a URL; a null one, or one without ``://``, has three empty parts."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    low = F.translate(host, _UPPER, _LOWER)
    return low, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.concat(low, F.substr(rest, F.length(host) + 1))


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(target, F.lit(TOKEN), F.lit(0)), F.array(F.lit(""))))


def filed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(token, name, verdict, tier, size, regex): every distinct rule under its rarest literal token among ``urls(target)``."""
    rules = rules.where("pattern IS NOT NULL AND verdict IS NOT NULL").select("name", "pattern", "verdict", "tier").distinct()
    rules = store(rules.withColumn("tokens", literal_tokens(F.col("pattern"))))
    named = store(rules.select(F.explode("tokens").alias("token")).distinct())
    held = lookup(urls.select(F.explode(_tokens(F.col("target"))).alias("token")), named, "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    each = rules.select("name", "pattern", "verdict", "tier", F.explode_outer("tokens").alias("token")).join(store(held), "token", "left")
    rarest = F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), (-F.length("token")).alias("size"), "token"))
    each = each.groupBy("name", "pattern", "verdict", "tier").agg(rarest.alias("r"))
    return each.select(F.coalesce("r.token", F.lit("")).alias("token"), "name", "verdict", "tier", F.length("pattern").alias("size"), regex(F.col("pattern")).alias("regex"))


def fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(target, name, verdict, tier): the rule that decides, for each of ``urls(target)`` that any rule fits.

    The lowest tier goes first, then the longest pattern; of equally long ones a blocking one, then the smaller name.
    """
    index = store(filed(rules, urls))
    asked = urls.select("target", F.explode(_tokens(F.col("target"))).alias("token"))
    if index.count() <= LOOKUP_ROWS:
        fetched = asked.join(F.broadcast(index), "token")
    else:
        # a token may have many rules: they are dealt over parts, each of which every URL with that token meets
        parts = index.withColumn("part", F.pmod(F.xxhash64("name", "regex"), F.lit(SALTS)).cast("int"))
        fetched = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(parts.hint("merge"), ["token", "part"])
    fits = fetched.where(F.regexp_like("target", F.col("regex")))
    first = F.min(F.struct("tier", (-F.col("size")).alias("size"), (F.col("verdict") != BLOCK).alias("open"), "name", "verdict"))
    return fits.groupBy("target").agg(first.alias("r")).select("target", "r.name", "r.verdict", "r.tier")


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """``pages(url, ...)`` with host, path, rule, verdict and tier of the rule that decides; ``rules(name, pattern, verdict, tier)``.

    Where no rule fits, rule and tier are null and the verdict is ``default``; so it is for a null URL and one without ``://``, whose
    host and path are empty, unless a pattern fits the empty URL. Rows stay as they are, repeated ones too; a rule that is listed twice counts once, one with a null
    pattern or verdict never fits. Other columns pass through; columns of ``pages`` called host, path, rule, verdict, tier or _target are
    replaced. An empty table gives an empty table.
    """
    host, path, target = url_parts(F.col("url").cast("string"))
    rows = pages.drop("host", "path", "rule", "verdict", "tier", "_target").withColumns({"host": host, "path": path, "_target": target})
    found = store(fitting(store(rows.select(F.col("_target").alias("target")).distinct()), rules))
    found = found.select(F.col("target").alias("_target"), F.col("name").alias("rule"), "verdict", "tier")
    out = lookup(rows, found, "_target", "left").drop("_target")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
