"""URL filter against a brute-force model: every rule's regular expression on every URL."""

import random
import re

from skytrace.llm import url_filter

RULES = "name string, pattern string, verdict string, tier int"


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host):])[0], rest[len(host):]


def fits(pattern, target):
    body, head, tail = pattern, "", ""
    if body.startswith("||"):
        body, head = body[2:], r"\A(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], r"\A"
    if body.endswith("|"):
        body, tail = body[:-1], r"\Z"
    parts = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}
    return re.search(head + "".join(parts.get(c) or re.escape(c) for c in body) + tail, target, re.S) is not None


def slow(url, rules, default="allow"):
    host, path, tail = parts(url)
    found = min(((t, -len(p), v != "block", n, v) for n, p, v, t in {*rules} if p is not None and v is not None and fits(p, host + tail)), default=None)
    return (host, path, found[3], found[4], found[0]) if found else (host, path, None, default, None)


def judged(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS tier", "'t' AS target", "'k' AS token", "2 AS name")
    out = url_filter.judge(pages, spark.createDataFrame(rules, RULES))
    assert {"page_id", "url", "target", "token", "name"} <= {*out.columns}
    return [(r["host"], r["path"], r["rule"], r["verdict"], r["tier"]) for r in sorted(out.collect(), key=lambda r: r["page_id"])]


HOSTS = ["a.com", "b.a.com", "ba.com", "WWW.Example.com", "example.com", "m.example.com:80", "net", "x.net", "com", "", "café.net", "spam-farm.org", "docs.a.com"]
PATHS = ["", "/", "/en/", "/en", "/english/1", "/es/x", "/fr/", "/EN/", "/login", "/login?x=1", "/loginx", "/a\nb/en/", "/tag/q/page/2", "?q=/en/", "#/en/", "/a|b", "/a*b", "/ü/en/"]


def corpus():
    return [f"{s}{h}{p}" for s in ("http://", "x://y://", "no-scheme") for h in HOSTS for p in PATHS] + [None, "", "://"]


def test_fixed_rules(spark):
    rules = [tuple(r) for r in url_filter.site_rules(spark).unionByName(url_filter.pattern_rules(spark)).collect()]
    urls = corpus() + ["http://" + "a" * 200_000 + ".com/en/", "http://a.com/" + "en/" * 50_000]
    assert judged(spark, urls, rules) == [slow(u, rules) for u in urls]


def test_many_stars_on_a_long_url(spark):
    rules = [("stars", "*a*b*a*b*a*c*", "block", 0), ("end", "||x.*a*b*a*c|", "block", 0)]
    assert [r[3] for r in judged(spark, ["http://x.com/" + "ab" * 200_000, "http://x.com/" + "ab" * 200_000 + "ac"], rules)] == ["allow", "block"]


def odd_rules(seed):
    rng = random.Random(seed)
    bits = ["en", "login", "com", "a", ".", "/", "*", "^", "?", "-", "|", "é", "\\", "(", "[", "page", "$"]
    rules = {(f"r{i}", rng.choice(["", "", "|", "||"]) + "".join(rng.choices(bits, k=rng.randint(1, 4))) + rng.choice(["", "", "|"]), rng.choice(["allow", "block"]), rng.randint(0, 2)) for i in range(60)}
    return [r for r in rules if r[1].strip("|")] + [("null", None, "block", 0), ("none", "/en/", None, 0)] + [("twice", "||a.com/", "block", 1)] * 2


def test_odd_rules(spark):
    for seed in (1, 2):
        rules, urls = odd_rules(seed), corpus()
        assert judged(spark, urls, rules) == [slow(u, rules) for u in urls]


def test_many_rules_are_merged(spark, monkeypatch):
    rules, urls = odd_rules(3), corpus()
    monkeypatch.setattr(url_filter, "LOOKUP_ROWS", 0)
    monkeypatch.setattr("skytrace.llm.common.LOOKUP_ROWS", 0)
    assert judged(spark, urls, rules) == [slow(u, rules) for u in urls]


def test_a_rule_is_filed_under_its_rarest_token(spark):
    urls = spark.createDataFrame([("x.com/en/",)] * 5 + [("y.com/rare/en/",)], "target string").distinct()
    urls = urls.unionByName(spark.createDataFrame([("z.com/en/q",)], "target string"))
    rules = [("a", "/rare/en/", "block", 0), ("b", "||com/*x", "block", 0), ("c", "*unbounded*", "block", 0), ("d", "|x.com|", "block", 0), ("e", "en", "block", 0)]
    found = {r["name"]: r["token"] for r in url_filter.filed(spark.createDataFrame(rules, RULES), urls).collect()}
    assert found == {"a": "rare", "b": "com", "c": "", "d": "x", "e": ""}


def test_only_fetched_rules_are_tried(spark):
    """Rules meet the URLs that hold their token, not all of them."""
    rules = spark.createDataFrame([(f"s{i}", f"||site{i}.org/", "block", 0) for i in range(200)], RULES)
    urls = spark.createDataFrame([(f"site{i}.org/page{i}",) for i in range(400)], "target string")
    index = url_filter.filed(rules, urls)
    assert urls.select("target", url_filter._tokens(urls["target"]).alias("ts")).selectExpr("target", "explode(ts) AS token").join(index, "token").count() == 200


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = url_filter.site_rules(spark)
    assert url_filter.judge(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge(one, rules.limit(0)).collect()] == ["allow"] * 3
