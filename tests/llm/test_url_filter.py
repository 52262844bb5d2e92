"""URL rules in the trie and by join, against a scan of all rules."""

import random

import pytest

from tidemark.llm.url_filter import RULES, Rule, Trie, filter_urls

NEW = ["host", "path", "rule", "verdict"]


def split(url):
    """Host and path as the contract words them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = min((rest.split(c, 1)[0] for c in "/?#"), key=len)
    path = min((rest[len(host) :].split(c, 1)[0] for c in "?#"), key=len)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url, rules):
    host, path = split(url)
    fits = [r for r in rules if (host == r.host or host.endswith(f".{r.host}")) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
    return (host, path, best and best.host + best.path, best.verdict if best else "allow")


URLS = [
    None,
    "",
    "no scheme",
    "://",
    "http://net",
    "http://NET/",
    "http://Example.Net/en/x?q=/fr/",
    "http://example.net/en",
    "http://example.net?x=/en/",
    "http://a.b.example.com/de/#f",
    "http://xexample.com/de/",
    "http://org/fr/1",
    "http://É.org/FR/",
    "http://a.org:80/fr/",
    "x://y://example.com/de/",
    "http://example.net./en/",
    "http://.net/",
    "http://a..net/\n/x",
    "http://" + "a." * 50_000 + "example.net/en/" + "b/" * 50_000,
]


@pytest.mark.parametrize("trie_bytes", [1 << 20, 0])
def test_awkward_urls(spark, trie_bytes):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(3, URLS[6])] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    found = filter_urls(frame, RULES, trie_bytes=trie_bytes).select("page_id", *NEW).collect()
    want = [(k, *brute(u, RULES)) for k, u in rows]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def random_rules(rnd):
    labels, parts = ["a", "b", "aa", "net"], ["x", "y", "xy", "", "/"]
    made = {}
    for _ in range(40):
        host = ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4)))
        path = rnd.choice(["", "/" + "/".join(rnd.choice(parts) for _ in range(rnd.randint(0, 4)))])
        made[host, path] = rnd.choice(["allow", "block"])
    return [Rule(*k, v) for k, v in made.items()]


def random_url(rnd):
    host = ".".join(rnd.choice(["a", "b", "aa", "net", ""]) for _ in range(rnd.randint(1, 6)))
    path = "".join(rnd.choice(["/", "x", "y", "xy", "/x"]) for _ in range(rnd.randint(0, 6)))
    return f"http://{host}" + (f"/{path}" if rnd.random() < 0.9 else "")


def test_trie_is_a_scan_of_the_rules():
    rnd = random.Random(1)
    for _ in range(100):
        rules = random_rules(rnd)
        trie = Trie(rules)
        for url in (random_url(rnd) for _ in range(100)):
            found = trie.longest(*split(url))
            assert (None if found is None else rules[found].host + rules[found].path) == brute(url, rules)[2]


@pytest.mark.parametrize("trie_bytes", [1 << 20, 0])
def test_rule_tables(spark, trie_bytes):
    rnd = random.Random(2)
    rules = random_rules(rnd)
    urls = [random_url(rnd) for _ in range(500)]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = filter_urls(frame, table, trie_bytes=trie_bytes).select(*NEW).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(brute(u, rules)) for u in urls)


def test_block_wins_ties_and_empty_inputs(spark):
    both = [Rule("net", "/", "block"), Rule("net", "/", "allow")]
    frame = spark.createDataFrame([("http://x.net/",)], "url string")
    for trie_bytes in (1 << 20, 0):
        assert filter_urls(frame, both, trie_bytes=trie_bytes).first()["verdict"] == "block"
        assert filter_urls(frame, [], trie_bytes=trie_bytes - 1, default="block").first()["verdict"] == "block"
        assert filter_urls(frame.limit(0), RULES, trie_bytes=trie_bytes).count() == 0


def test_clashing_columns_are_replaced(spark):
    frame = spark.createDataFrame([("http://x.net/", 1, "mine", 2)], "host string, rule int, Verdict string, other int")
    out = filter_urls(frame, RULES, url="host")
    assert out.columns == ["other", *NEW]
    assert tuple(out.first()) == (2, "x.net", "/", "net/", "block")


def test_unusable_rules(spark):
    frame = spark.createDataFrame([("http://x.net/",)], "url string")
    for bad in [Rule("", "/", "block"), Rule("a/b", "/", "block"), Rule("a", "x", "block"), Rule("a", "/", "drop")]:
        with pytest.raises(ValueError):
            filter_urls(frame, [bad])
