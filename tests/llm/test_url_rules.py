import re
from itertools import combinations

from pickflow.llm import url_rules
from pickflow.llm.queries import op9_url_rules


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def stated(host, path):
    fits = [(len(h) + len(p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_whole_table(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op9_url_rules(spark, sf).collect()
    assert len(got) == len(pages) == len({r.page_id for r in got})
    for r in got:
        host, path = parts(pages[r.page_id])
        rule, verdict = stated(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.mined_label or "allow")


def test_edge_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en", "https://a.b.net/es/", "http://net/fr/q", "x://ñÉ.org/Path#f", "a://b://c/d", "http://h?x=1", "http://example.com.evil/en/", "http://h/a\nb?q"]
    pages = spark.createDataFrame([(i, u, "c", 1) for i, u in enumerate(urls * 2)], "page_id bigint, url string, host string, verdict int")
    got = url_rules.judge_urls(pages).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        url = urls[r.page_id % len(urls)]
        assert (r.host, r.path) == parts(url) and (r.rule, r.verdict) == (stated(*parts(url))[0], r.verdict)
        if r.rule:
            assert r.verdict == stated(*parts(url))[1]
    assert url_rules.judge_urls(pages.limit(0)).collect() == []


def test_mined_rules_against_brute_force(spark):
    rows = []
    for i in range(120):
        tokens = {f"t{j}" for j in range(5) if (i * 7 + j * 3) % (j + 2) == 0}
        rows.append((sorted(tokens), "block" if {"t0", "t1"} <= tokens or (i % 11 == 0) else "allow"))
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    got = {(tuple(r.tokens), r.label): (round(r.confidence, 6), round(r.support, 6)) for r in url_rules.mine_rules(df, 0.05, 0.7).collect()}
    names, found = sorted({t for r in rows for t in r[0]}), {}
    for k in range(1, 6):
        for a in combinations(names, k):
            have = [label for t, label in rows if set(a) <= set(t)]
            for label in ("allow", "block"):
                n = have.count(label)
                if have and n / len(rows) >= 0.05 and n / len(have) >= 0.7:
                    found[a, label] = (n / len(have), n / len(rows))
    kept = {
        (a, label): (round(c, 6), round(s, 6))
        for (a, label), (c, s) in found.items()
        if not any(found.get((tuple(x for x in a if x != t), label), (-1,))[0] >= c for t in a)
    }
    assert got == kept
    sets = df.select("tokens").distinct().withColumnRenamed("tokens", "_tokens")
    best = {tuple(r._tokens): r._best.label for r in url_rules.match_rules(sets, url_rules.mine_rules(df, 0.05, 0.7)).collect()}
    for (tokens,) in {(tuple(t),) for t, _ in rows}:
        fit = [(c, s, label) for (a, label), (c, s) in kept.items() if set(a) <= set(tokens)]
        assert best.get(tokens) == (max(fit)[2] if fit else None)
