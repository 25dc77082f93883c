import random

from seamstat.llm import registry, url_rules

RULE = "host string, path string, verdict string"
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/es/a", "allow"), ("example.org", "/es/a", "block"),
    ("example.org", "/es/b", "allow"), ("com", "/fr/", "allow"), ("a.com", "", "block"), ("a.com", "/x", "allow"), ("b.a.com", "/", "allow"),
]


def judged(url):
    """Host, path, rule and verdict by looking at every rule."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends, default=len(rest))]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), v != "allow", h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_equals_looking_at_every_rule(spark):
    draw = random.Random(4)
    hosts = ["org", "example.org", "Blog.EXAMPLE.org", "notexample.org", "a.com", "x.a.com", "b.a.com", "z.b.a.com", "aa.com", "de", "a..com", "", "org."]
    paths = ["", "/", "/es", "/es/", "/es/a", "/es/ab?q=/fr/", "/es/c", "/es/b#x", "/fr/", "/fr", "?a=/", "#/es/", "/x/y", "/\u00e9s/", "/es/\n"]
    urls = [draw.choice(["http", "HTTPS", ""]) + "://" + draw.choice(hosts) + draw.choice(paths) for _ in range(600)]
    urls += [None, "", "no-scheme.org/es/", "mailto:x", "a://b://c/d", "http://" + "l." * 2000 + "org/" + "p" * 20_000]
    rows = [(i, u, "h", "p") for i, u in enumerate(urls)] + [(0, urls[0], "h", "p")] * 3 + [(None, urls[1], None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, path string")
    rules = spark.createDataFrame(RULES, RULE)
    for at_once in (url_rules.PAGES_AT_ONCE, 7):  # one part a host, and many
        got = sorted(map(tuple, url_rules.judge(pages, rules, at_once).collect()), key=str)
        assert got == sorted([(i, *judged(u)) for i, u, _, _ in rows], key=str)


def test_many_nested_hosts_over_many_ranges(spark, monkeypatch):
    """Rule hosts stay open over the borders of ranges; labels with signs below the full stop sort between them."""
    draw = random.Random(9)
    labels = ["a", "a-b", "a!", "b", "", "com", "com-x", "z\x00"]
    names = [".".join(draw.choice(labels) for _ in range(draw.randint(1, 5))) for _ in range(400)]
    rules = [(h, draw.choice(["", "/", "/p"]), draw.choice(["allow", "block"])) for h in {*names[:60], "com", "a.com"}]
    monkeypatch.setattr("tests.llm.test_url_rules.RULES", rules)
    rows = [(i, f"x://{h}{draw.choice(['', '/', '/p', '/q'])}") for i, h in enumerate(names)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    got = sorted(map(tuple, url_rules.judge(pages, spark.createDataFrame(rules, RULE)).collect()))
    assert got == sorted((i, *judged(u)) for i, u in rows)


def test_many_rules_on_one_host(spark):
    rules = spark.range(20_000).selectExpr("'big.org' AS host", "concat('/', id % 200, '/', id) AS path", "IF(id % 2 = 0, 'allow', 'block') AS verdict")
    pages = spark.range(30_000).selectExpr("id AS page_id", "concat('http://w.big.org/', id % 200, '/', id, '/x') AS url")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(pages, rules).collect()}
    assert len(got) == 30_000
    for i, found in got.items():  # the longest beginning of the number that is a rule's
        fit = [n for n in (str(i)[:k] for k in range(1, 6)) if int(n) < 20_000 and int(n) % 200 == i % 200 and str(int(n)) == n]
        assert found == ((f"big.org/{i % 200}/{fit[-1]}", "block" if int(fit[-1]) % 2 else "allow") if fit else (None, "allow"))


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, RULE)
    assert url_rules.judge(pages.limit(0), rules).collect() == []
    assert list(map(tuple, url_rules.judge(pages, rules.limit(0)).collect())) == [(1, "a.org", "/x", None, "allow")]


def test_plan_has_no_python_and_no_single_partition(spark):
    plan = registry.QUERIES["op4_url_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SinglePartition" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
