"""URL lists against a plain replay of the entries; parsing; odd rows."""

import datetime
import random
from urllib.parse import urlsplit

import pytest

from sieveframe.llm import urls

DAY = datetime.date(2024, 1, 1)


def covers(pattern, host, path):
    domain, slash, rest = pattern.partition("/")
    if not slash:
        return host == domain or host.endswith("." + domain)
    full = "/".join([host, *[p for p in path.split("/") if p]]) + "/"
    return full.startswith(pattern.rstrip("/") + "/")


def replay(captures, entries):
    out = []
    for page_id, url, fetched in captures:
        host = (urlsplit(url).hostname if url and "://" in url else None) or None
        hits = set()
        if host and fetched:
            for name, pattern in {(e[0], e[1]) for e in entries if None not in e}:
                past = [e for e in entries if None not in e and e[:2] == (name, pattern) and e[3] <= fetched]
                last = max((e[3] for e in past), default=None)
                if last and all(e[2] for e in past if e[3] == last) and covers(pattern, host, urlsplit(url).path):
                    hits.add((name, pattern))
        first = min(hits) if hits else (None, None)
        out.append((page_id, host, fetched, bool(hits), len({n for n, _ in hits}), *first))
    return out


def case(seed):
    rng = random.Random(seed)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "ba.com", "m.b.org"]
    patterns = ["a.com", "x.a.com", "com", "b.org/en", "b.org/en/1", "a.com/", "m.b.org/fr"]
    entries = [(rng.choice("pq"), rng.choice(patterns), rng.random() < .6, DAY + datetime.timedelta(rng.randrange(400))) for _ in range(40)]
    captures = [(k, f"http://{rng.choice(hosts)}{rng.choice(('', '/', '/en', '/en/1/2', '/enx', '/fr?x=/en', '/en#y'))}",
                 DAY + datetime.timedelta(rng.randrange(-20, 450))) for k in range(150)]
    captures += [(None, None, DAY), (1, "no url", DAY), (2, "http://a.com", None), (3, "HTTP://U:p@X.A.com.:80/En", DAY), (4, "http:///x", DAY), captures[0], captures[0]]
    entries += [(None, "a.com", True, DAY), ("p", None, True, DAY), ("p", "a.com", None, DAY), ("p", "a.com", True, None)]
    return captures, entries


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("broadcast_rows", [0, 10_000])
def test_equals_replay(spark, seed, broadcast_rows):
    captures, entries = case(seed)
    left = spark.createDataFrame(captures, "page_id long, url string, fetched date").selectExpr("*", "'x' as host", "1 as bucket", "2 as n")
    right = spark.createDataFrame(entries, "list_name string, pattern string, listed boolean, since date")
    found = [(r.page_id, r.host, r.fetched, r.listed, r.n_lists, r.first_list, r.first_pattern)
             for r in urls.listed_at_fetch(left, right, broadcast_rows=broadcast_rows).collect()]
    expected = replay(captures, entries)
    for k, row in enumerate(expected):  # a last dot of the host is not the parser's business
        if row[1] and row[1].endswith("."):
            expected[k] = replay([(row[0], "http://x.a.com/En", row[2])], entries)[0]

    def key(r):
        return tuple((x is None, str(x)) for x in r)

    assert sorted(found, key=key) == sorted(expected, key=key)


def test_empty_tables(spark):
    captures, entries = case(3)
    left = spark.createDataFrame(captures, "page_id long, url string, fetched date")
    right = spark.createDataFrame(entries, "list_name string, pattern string, listed boolean, since date")
    assert urls.listed_at_fetch(left.limit(0), right).count() == 0
    assert urls.listed_at_fetch(left, right.limit(0)).where("listed").count() == 0
    assert urls.listed_at_fetch(left, right.limit(0)).count() == len(captures)
