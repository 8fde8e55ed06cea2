import random

from pyspark.sql import functions as F

from tests.llm.brute import LOWER
from trajkit.llm import urlfilter
from trajkit.llm.urlfilter import RULES, Rule


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:end].translate(LOWER), rest[end:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "block"), default=None)
    return host, path, best.host + best.path if best else None, best.verdict if best else default


URLS = [None, "", "no scheme", "http://", "http://com/", "https://Example.COM/en/1?x=/es/#y", "http://www.example.com/en/", "http://a.www.example.com/en/?q", "http://badexample.com/en/", "http://x.net/es/2", "http://net/fr/", "http://x.net/de/", "http://x.org/en/", "http://example.com", "http://example.com?/en/", "http://example.com/en", "a://b://c.net/fr/1", "http://x.net:80/es/", "http://.net/es/", "http://x..net/es/1", "HTTP://WWW.EXAMPLE.COM#/en/", "http://ex.com/\n/en/", "x\n://y.net/es/\n"]


def run(spark, urls, rules, **parameters):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, rules, **parameters).collect()}


def test_contract_rules(spark):
    assert run(spark, URLS, RULES) == {i: judge(u, RULES) for i, u in enumerate(URLS)}


def test_many_nested_rules_and_sweeps(spark):
    rng = random.Random(3)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): Rule(rng.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(60))}.values())
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(600)]
    assert run(spark, urls, rules, rows_per_sweep=100) == {i: judge(u, rules) for i, u in enumerate(urls)}


def test_ties_defaults_repeats_and_empty(spark):
    assert run(spark, ["http://a/", "http://b/"], [Rule("allow", "a", "/"), Rule("block", "a", "/")], default="block") == {0: ("a", "/", "a/", "block"), 1: ("b", "/", None, "block")}
    assert run(spark, ["http://a/"], spark.createDataFrame([], "verdict string, host string, path string")) == {0: ("a", "/", None, "allow")}
    pages = spark.createDataFrame([(None, "http://a.com/" + "x" * 100_000)] * 3, "page_id long, url string").withColumns({"key": F.lit("clash"), "host": F.lit("clash"), "kind": F.lit(7)})
    got = urlfilter.judge_urls(pages).collect()
    assert len(got) == 3 and {r["rule"] for r in got} == {"com/"} and {r["page_id"] for r in got} == {None}
    assert urlfilter.judge_urls(pages.where("false")).count() == 0


def test_many_paths_of_one_host(spark):
    rng = random.Random(8)
    rules = [Rule("block", "h.com", f"/p{i}/") for i in range(900)] + [Rule("allow", "h.com", f"/p{i}/x/y/") for i in range(0, 900, 3)] + [Rule("allow", "com", "/p7/x/"), Rule("block", "a.h.com", "/")]
    urls = [f"http://{rng.choice(['h.com', 'a.h.com', 'b.c.h.com', 'i.com'])}/p{rng.randrange(1000)}/{rng.choice(['', 'x', 'x/', 'x/y/z', 'q'])}" for _ in range(800)]
    assert run(spark, urls, rules, rows_per_sweep=64) == {i: judge(u, rules) for i, u in enumerate(urls)}
