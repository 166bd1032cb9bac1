import random
import re

from nichegrid.llm import urlrules
from nichegrid.llm.queries import RULES


def brute(url, rules, default):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group() if rest[len(host) :][:1] == "/" else ""
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else default


def test_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["example.com", "www.example.com", "a.www.Example.COM", "notexample.com", "com", "net", "x.net", "net.org", "", "a.com:80", "é.net"]
    paths = ["", "/", "/en/", "/en", "/en/x", "/es/", "/fr/1", "/x.example.com/en/", "/EN/"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?q=/en/", "#a://b", "?")] + [None, "", "no scheme", "a://b://c/en/", "http://x.net/" + "a" * 5000, "http://a\nb.com/x\ny"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(pages, RULES).collect()}
    assert got == {i: brute(u, RULES, "allow") for i, u in enumerate(urls)}


def test_globs_in_paths():
    rules = [urlrules.Rule("a.org", "/x*y", "block", globbed=True), urlrules.Rule("a.org", "/?z", "allow", globbed=True), *(urlrules.Rule(f"h{i}.org", "/long/path/to/", "block") for i in range(40))]
    machine = urlrules.ShiftAnd([urlrules.pattern(r) for r in rules])

    def fits(host, path):
        import numpy as np

        s = np.array([*b"." + host.encode(), urlrules.BORDER, *path.encode()])
        return [rules[i].name for i in np.flatnonzero(machine.run(s, np.array([0, len(s)]))[0])]

    assert fits("a.org", "/xy") == ["a.org/x*y"] and fits("b.a.org", "/x123y/z") == ["a.org/x*y"]
    assert fits("a.org", "/qz") == ["a.org/?z"] and fits("a.org", "/xqz") == [] and fits("aa.org", "/xy") == []
    assert fits("h39.org", "/long/path/to/it") == ["h39.org/long/path/to/"]


def test_edge_cases(spark):
    pages = spark.createDataFrame([(None, None, "x"), (1, "http://a.com/", "x"), (1, "http://a.com/", "x")], "page_id long, url string, rule string")
    assert len(urlrules.judge(pages, RULES).collect()) == 3
    assert urlrules.judge(pages.limit(0), RULES).collect() == []
    assert {r["verdict"] for r in urlrules.judge(pages, [], "block").collect()} == {"block"}


def test_very_long_urls(spark):
    long = "http://www.example.com/en/" + "x/" * 20_000
    pages = spark.createDataFrame([(1, long), (2, "http://" + "a." * 5000 + "net/es/"), (3, "x" * 50_000)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"], len(r["host"]), len(r["path"])) for r in urlrules.judge(pages, RULES).collect()}
    assert got == {1: ("www.example.com/en/", "allow", 15, 40_004), 2: ("net/es/", "block", 10_003, 4), 3: (None, "allow", 0, 0)}
