import numpy as np

from causerie.llm import url_filter as uf

PAGES = [
    (1, "https://www.A.com:443/x/index.html?b=2&utm_source=q&a=1#top"),
    (2, "http://a.com/x/?a=1&b=2"),
    (3, "http://a.com/x?a=1"),
    (4, None),
    (5, "  "),
    (None, "HTTP://a.com/x?a=1&b=2"),
    (1, "https://www.A.com:443/x/index.html?b=2&utm_source=q&a=1#top"),
    (6, "http://b.org/" + "y" * 20000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(a, b, "h", True) for a, b in rows], "page_id bigint, url string, html string, blocked boolean")


def listed(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def test_flags(spark):
    rows = uf.flag_listed(pages(spark), listed(spark, ["a.com/x?b=2&a=1", "a.com/x?b=2&a=1", None, ""])).collect()
    assert len(rows) == len(PAGES)
    assert sorted(str(r.page_id) for r in rows if r.blocked) == ["1", "1", "2", "None"]
    assert {r.canonical_url for r in rows if r.blocked} == {"a.com/x?a=1&b=2"}
    assert [r.canonical_url for r in rows if r.page_id in (4, 5)] == [None, None]


def test_a_filter_too_small_gives_the_same(spark):
    urls = [f"http://h{i}.com/p" for i in range(500)]
    have = pages(spark, [(i, u) for i, u in enumerate(urls)])
    for most in (32, uf.MAX_FILTER_BYTES):
        rows = uf.flag_listed(have, listed(spark, urls[::2]), max_bytes=most).collect()
        assert sorted(r.page_id for r in rows if r.blocked) == list(range(0, 500, 2)) and len(rows) == 500


def test_empty(spark):
    assert uf.flag_listed(pages(spark, []), listed(spark, ["a.com"])).collect() == []
    assert not any(r.blocked for r in uf.flag_listed(pages(spark), listed(spark, [])).collect())


def test_no_false_negatives_and_few_false_positives(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, 20000)
    bloom = uf.build(spark.createDataFrame([(int(x),) for x in h[:10000]], "h bigint"), 10000)
    assert uf.might_hold(bloom, h[:10000]).all() and uf.might_hold(bloom, h[10000:]).mean() < 0.01
