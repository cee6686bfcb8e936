from doctally.llm import url_filter as U

URLS = [
    "https://a.example.net/en/x?y#z", "http://example.net/en", "HTTP://EXAMPLE.NET/en/", "http://example.net?q", "net", None, "", "x://net/", "x://internet/", "x://example.com/de/1", "x://my.example.com/de/", "x://example.com/DE/",
    "x://a.org/fr/", "x://org/fr/#", "x://org/f", "://", "a://b://c", "x://é.NET/", "x://" + "a." * 3000 + "net/" + "p" * 9000,
]


def judged(url, rules=U.RULES):
    """Straight from the definition."""
    host, path = U.split_url(url)
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, "allow")))


def test_against_definition(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x"), (None, URLS[0], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    found = U.judge_urls(pages, U.RULES).collect()
    wanted = [(i, *judged(u)) for i, u, _ in rows]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    assert U.judge_urls(pages.limit(0), U.RULES).count() == 0
    assert {r["verdict"] for r in U.judge_urls(pages, []).collect()} == {"allow"}


def test_collisions_do_not_decide():
    array = U.DigestArray(U.RULES, digest=lambda s: len(s) % 3)
    for u in URLS:
        got = array.judge([u], "allow").iloc[0]
        assert (got["host"], got["path"], got["rule"], got["verdict"]) == judged(u)


def test_long_hosts_and_many_lengths():
    """A megabyte of labels costs no more than the rules' lengths; no label is cut."""
    import time

    array, began = U.DigestArray(U.RULES), time.time()
    for host in ("a." * 500_000 + "net", "a" * 1_000_000 + ".org", "." * 1_000_000 + "example.com", "xnet." * 200_000 + "inet"):
        url = f"x://{host}/de/" + "p" * 1_000_000
        got = array.judge([url], "allow").iloc[0]
        assert (got["host"], got["path"], got["rule"], got["verdict"]) == judged(url)
    assert time.time() - began < 4
    rules = [("." .join("ab"[: i % 3]) + f"h{i}.net", "/" * (i % 5), "block" if i % 2 else "allow") for i in range(300)] + U.RULES
    array = U.DigestArray(rules)
    for i in range(0, 300, 7):
        for url in (f"x://sub.h{i}.net///", f"x://a.b.h{i}.net/////x", f"x://xh{i}.net/"):
            assert tuple(array.judge([url], "allow").iloc[0]) == judged(url, rules)


def test_rules_in_passes(spark):
    rules = [*U.RULES, ("a.example.net", "/", "block"), ("example.net", "/", "allow"), ("example.net", "/", "allow"), ("my.example.com", "/de", "allow")]
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    for most in (1, 3):
        found = U.judge_urls(pages, rules, most=most).collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(repr((i, *judged(u, rules))) for i, u in enumerate(URLS))
