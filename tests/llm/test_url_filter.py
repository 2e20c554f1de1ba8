import random
import re

import pytest

from txnwatch.llm import url_filter as uf


def _brute(url, rules, blocked):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(uf.UPPER, uf.LOWER)), m[2]) if m else ("", "")

    def fits(key):
        h, p = uf.split_key(key)
        return host != "" and (host == h or host.endswith("." + h)) and path.startswith(p)
    best = max((k for k in rules if fits(k)), key=len, default=None)
    return host, path, best, rules[best] if best else ("block" if any(map(fits, blocked)) else "allow")


URLS = [None, "", "no scheme", "http://", "http://NET/", "http://net", "http://a.net?x/", "http://a.b.example.net/en/x?y#z",
        "http://example.net/en", "https://x.example.com/de/", "https://xexample.com/de/q", "http://fr.org/fr/#", "ftp://m.ads-track.example.com/a",
        "http://ads-track.example.org/fr/1", "http://h\n.net/e", "x://" + "a." * 5000 + "net/" + "p" * 5000, "a://b://net/", "http://é.NET/É",
        "http://a.net:80/", "http:///x"]


@pytest.mark.parametrize("max_bits", [uf.MAX_BITS, 1])
def test_matches_brute_force(spark, max_bits):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, hits string")
    got = uf.filter_urls(df, max_bits=max_bits).orderBy("page_id").collect()
    assert [tuple(r.u) for r in got] == [_brute(u, uf.RULES, uf.BLOCKED_HOSTS) for u in URLS + URLS[:3]]
    assert uf.filter_urls(df.where("page_id < 0"), max_bits=max_bits).count() == 0
    assert uf.filter_urls(df, rules={}, blocked=()).where("u.verdict = 'allow'").count() == len(URLS) + 3


def test_cascade_is_exact_on_its_universe(spark):
    rng = random.Random(5)
    keys = [f"h{rng.random()}.example" for _ in range(4000)]
    listed = set(keys[:300])
    levels = uf.build_cascade(spark.createDataFrame([(k,) for k in keys], "key string"),
                              spark.createDataFrame([(k,) for k in [*listed, "never.seen"]], "key string"))
    assert len(levels) > 1
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(k,) for k in keys], "key string").where(uf.in_cascade(levels, F.col("key"))).collect()
    assert {r.key for r in got} == listed
