import re

from hypothesis import given, settings
from hypothesis import strategies as st

from enthyme.llm.url_filter import BASE_RULES, ShiftAnd, _regex, url_verdicts


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fit = [r for r, _ in BASE_RULES if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fit, key=len, default=None)


URLS = [None, "", "no scheme", "http://example.ORG/es/1", "https://m.example.org/en/12?x=/es/", "http://org", "http://org/", "http://a.com/fr/x#y", "ftp://b.com/de/", "http://evilexample.org/es/", "http://x.net/a.org/", "http://x.net/pic.jpg?x", "http://ads.x.net/", "http://Ünï.com/fr/é", "http://x.com/" + "a/" * 30_000, "x://y://z.com/de/1", "http://x.net/\x02\x03/login", "http://u@h.org:80/"]


def test_against_plain_rules(spark):
    pages = spark.createDataFrame([(i, u, "<p>", 1) for i, u in enumerate(URLS)], "page_id long, url string, html string, host int")
    for r in url_verdicts(pages).collect():
        assert (r.host, r.path, r.rule) == plain(URLS[r.page_id])
        assert r.verdict == (dict(BASE_RULES)[r.rule] if r.rule else "block" if r.own_rule else "allow")
    own = {r.page_id: r.own_rule for r in url_verdicts(pages).collect()}
    assert own[URLS.index("http://x.net/pic.jpg?x")] == "**.jpg" and own[URLS.index("http://ads.x.net/")] == "*.ads.**"
    assert url_verdicts(pages.limit(0)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé日/.*?", min_size=1, max_size=12), min_size=1, max_size=30), st.lists(st.text("abé日/.c", max_size=20), min_size=1, max_size=5))
def test_automaton_is_the_globs(globs, urls):
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    got = ShiftAnd(globs).run(urls)
    for i, u in enumerate(urls):
        for k, g in enumerate(globs):
            assert got[i, k] == bool(re.fullmatch(_regex(g), u, re.S)), (g, u)
