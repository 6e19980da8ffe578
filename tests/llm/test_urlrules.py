from hypothesis import given, settings
from hypothesis import strategies as st

from cloudloom.llm import urlrules as U
from cloudloom.llm.queries import URL_RULES

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.com", "/", "allow"), ("example.com", "/de/x/", "allow"), ("b.org", "", "block"), ("", "/", "block"), (None, "/", "block"), ("xample.com", "/", "block")]
URLS = ["http://a.NET/x", "https://Example.net/en/1?q", "http://www.example.net/fr/", "http://example.com/de/x/y", "http://a.example.com/de/1", "ftp://b.org?x", "http://b.org#f", "no host", None, "", "http://", "http:///de/", "x://org/fr/", "http://sub.org/fr/a://b", "http://myexample.com/de/", "http://example.com", "a://b://c/d", "http://example.net/en"]


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    best = None
    for h, p, v in rules:
        if h and (host == h or host.endswith(f".{h}")) and path.startswith(p or "") and (best is None or len(h + (p or "")) > len(best[0])):
            best = (h + (p or ""), v)
    return host, path, best and best[0], best[1] if best else default


def test_against_plain_rules(spark, monkeypatch):
    for block in (50_000, 2):
        monkeypatch.setattr(U, "BLOCK_RULES", block)
        df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], None)], "page_id long, url string, rule string").repartition(3)
        got = U.judge(df, RULES)
        for r in got.collect():
            assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, RULES), r
        assert got.count() == len(URLS) + 1
    assert U.judge(df.where("false"), URL_RULES).count() == 0
    assert {r.verdict for r in U.judge(df, spark.createDataFrame([], "host string, path string, verdict string")).collect()} == {"allow"}


LABEL = st.sampled_from(["a", "b", "ab", "com", "net"])
HOST = st.lists(LABEL, min_size=1, max_size=4).map(".".join)
PATH = st.sampled_from(["", "/", "/x/", "/x/y", "/y/"])


@given(st.lists(st.tuples(HOST, PATH), unique=True, max_size=12), st.lists(st.tuples(HOST, PATH), max_size=12))
@settings(max_examples=200, deadline=None)
def test_sweep(rules, urls):
    table = sorted((U.host_key(h), p, h + p, len(h + p), "v") for h, p in rules)
    order = sorted(urls, key=lambda u: U.host_key(u[0]))
    found = list(U.sweep([U.host_key(h) for h, _ in order], [p for _, p in order], table))
    for (h, p), best in zip(order, found, strict=True):
        fits = [len(r + q) for r, q in rules if (h == r or h.endswith(f".{r}")) and p.startswith(q)]
        assert (best[1] if best else None) == max(fits, default=None)


def test_many_paths_of_one_host_and_long_urls(spark, monkeypatch):
    import time

    rules = [("a.org", f"/p{i}/", "block" if i % 2 else "allow") for i in range(2000)] + [("a.org", "/", "block"), ("org", "", "allow")]
    urls = [(i, f"http://x.a.org/p{i % 2500}/z") for i in range(5000)] + [(-1, "http://a.org/p7/" + "y" * 200_000), (-2, "http://b.org"), (-3, None)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    start = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(df, rules).collect()}
    assert time.time() - start < 60
    assert all(got[i] == ((f"a.org/p{i % 2500}/", "block" if i % 2 else "allow") if i % 2500 < 2000 else ("a.org/", "block")) for i in range(5000))
    assert got[-1] == ("a.org/p7/", "block") and got[-2] == ("org", "allow") and got[-3] == (None, "allow")
    monkeypatch.setattr(U, "BLOCK_RULES", 700)
    assert {r.page_id: (r.rule, r.verdict) for r in U.judge(df, rules).collect()} == got
