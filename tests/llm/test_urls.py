"""URL filter: rules and parts against plain Python, the model against sums by hand."""

import math
import random
from collections import Counter

from tallyline.llm import url_filter
from tallyline.llm.queries import URL_RULES

SCHEMA = "page_id long, url string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = []
    for verdict, rule in URL_RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_parts_and_rules(spark):
    draw = random.Random(1)
    urls = [None, "", "x", "://", "http://", "a://b", "HTTP://ÀEXAMPLE.Net/EN/x", "http://example.net/en", "http://example.net/en/",
            "http://a.b.net?x=/", "https://x.org/fr/#a?b", "http://notnet/", "http://net/", "x://y://z.net/", "http://example.com/de/q\n?r",
            "http://u@net:80/a", "http://sub.example.com/de/", "http://example.com/DE/"]
    urls += ["".join(draw.choice(["http", "://", "/", "?", "#", "example", ".net", ".com", ".org", "/en/", "/fr/", "/de/", "A"]) for _ in range(6))
             for _ in range(300)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), SCHEMA), URL_RULES).collect()}
    assert len(got) == len(urls)
    for n, url in enumerate(urls):
        host, path = parts(url)
        rule, verdict = ruled(host, path)
        assert (got[n].host, got[n].path, got[n].rule) == (host, path, rule)
        assert got[n].verdict == (verdict or ("allow" if got[n].score >= 0 else "block"))


def test_the_model_by_hand(spark):
    urls = ["x://good.org/fr/aa", "x://fine.org/fr/ab", "x://bad.net/", "x://evil.net/q"]
    words = [parts(u)[0] + parts(u)[1] for u in urls]
    grams = {w: [t[i:i + 4] for t in [url_filter.START * 3 + w + url_filter.STOP] for i in range(len(t) - 3)] for w in words}
    rows = [(g, int(w in words[:2]), int(w not in words[:2])) for w in words for g in grams[w]]
    counts = spark.createDataFrame(rows, "gram string, a int, b int").groupBy("gram").sum("a", "b").toDF("gram", "a", "b")
    got = {r.gram: (r.a_p, r.b_p) for r in url_filter._smoothed(counts, ["a", "b"]).collect()}

    def chance(gram, seen):
        if not gram:
            return 1 / url_filter.ALPHABET
        same = Counter(g[-len(gram):] for g in seen)
        context = [g[-len(gram):] for g in seen if g[-len(gram):][:-1] == gram[:-1]]
        kinds = len(set(context))
        below = chance(gram[1:], seen)
        return below if not context else (same[gram] + kinds * below) / (len(context) + kinds)

    for kind, chosen in ((0, words[:2]), (1, words[2:])):
        seen = [g for w in chosen for g in grams[w]]
        for gram in got:
            assert math.isclose(got[gram][kind], chance(gram, seen), rel_tol=1e-9)


def test_unruled_urls_follow_those_they_are_like(spark):
    draw = random.Random(3)
    name = lambda letters: "".join(draw.choice(letters) for _ in range(8))
    good = [f"http://{name('abcde')}.org/fr/{name('abcde')}" for _ in range(200)]
    bad = [f"http://{name('vwxyz')}.net/{name('vwxyz')}" for _ in range(200)]
    new = [(k, f"http://{name(letters)}.info/{name(letters)}") for letters, k in (("abcde", "allow"), ("vwxyz", "block")) for _ in range(50)]
    urls = good + bad + [u for _, u in new]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), SCHEMA), URL_RULES).collect()}
    right = sum(got[400 + n] == k for n, (k, _) in enumerate(new))
    assert right >= 95


def test_nulls_repeats_other_columns_and_empty_tables(spark):
    rows = [(None, None, 1), (1, "http://a.info/x", 2), (1, "http://a.info/x", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int").withColumnRenamed("host", "score")
    got = url_filter.judge_urls(pages, URL_RULES).collect()
    assert [r.verdict for r in got] == ["allow"] * 3
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0
    long = spark.createDataFrame([(1, "http://a.info/" + "abc" * 50_000)], SCHEMA)
    assert url_filter.judge_urls(long, URL_RULES).count() == 1
