import re

import pytest

from tesserae.llm import urlfilter
from tesserae.llm.queries import oracle_sql, queries

from . import cases


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, host string, n int")


def split(url):
    if not url or "://" not in url:
        return "", ""
    host, path = re.fullmatch(r"([^/?#]*)([^?#]*)(?s:.*)", url.split("://", 1)[1]).groups()
    return cases.lower(host), path


def rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else None


def check(rows, data):
    assert len(rows) == len(data)
    urls = dict(data)
    for r in rows:
        host, path = split(urls[r.page_id])
        found = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, found and found[0])
        assert r.verdict == (found[1] if found else r.verdict) and r.verdict in ("allow", "block")


def test_hosts_paths_and_rules(spark):
    urls = [
        "http://A.Example.NET/en/1?x", "https://example.net/en", "https://net/", "https://net", "ftp://xnet/", "http://x.org/fr/a/b/c/d#e?f", "http://org/fr/", "http://borg/fr/",
        "a://EXAMPLE.com/de/é", "example.com/de/1", None, "", "://", "x:///de/", "http://h?a/b", "http://h#/fr/", "http://example.com/de", "http://a://b/c", "HTTP://É.COM/DE/", "http://x.org/\n/y", "http://u:p@Sub.example.com:80/de/",
    ]
    data = [(i, u) for i, u in enumerate(urls)]
    check(urlfilter.filter_urls(frame(spark, data)).collect(), data)


def test_tables(spark):
    pages = cases.table(spark, "sf0.01", "pages")
    data = [(r.page_id, r.url) for r in pages.collect()]
    check(urlfilter.filter_urls(pages).collect(), data)


def brute(data, rules):
    """page_id -> verdict, by the rule as worded: templates, merging and smoothing one page at a time."""
    pages = []
    for page_id, url in data:
        host, path = split(url)
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        segments = re.sub("[0-9]+", "#", path[1:]).split("/")
        segments = [*segments[:2], "/".join(segments[2:])]
        pages.append([page_id, host, max(fit)[2] if fit else None, [*segments, "", "", ""][:3], ()])
    for level in range(3):
        node, branch = {}, {}
        for p in pages:
            node[p[1], p[4]] = node.get((p[1], p[4]), 0) + 1
            branch[p[1], p[4], p[3][level]] = branch.get((p[1], p[4], p[3][level]), 0) + 1
        for p in pages:
            n, s = branch[p[1], p[4], p[3][level]], p[3][level]
            p[4] += (s if s in ("", "#") or (n >= 5 and n >= 0.01 * node[p[1], p[4]]) else "*",)
    out, labelled = {}, {}
    for p in pages:
        for k in range(4):
            for v in {None, p[2]} if p[2] else ():
                labelled[p[1], p[4][:k], v] = labelled.get((p[1], p[4][:k], v), 0) + 1
    for page_id, host, label, _, template in pages:
        held = lambda k, v, h=host, t=template: labelled.get((h, t[:k], v), 0)
        n, b = held(0, None), held(0, "block")
        purity = (b + 2) / (n + 4)
        for k in (1, 2, 3):
            cn, cb = held(k, None), held(k, "block")
            if cn and n:
                p = (b + cb) / (n + cn)
                if (cb / cn - b / n) ** 2 > 3.84 * p * (1 - p) * (1 / cn + 1 / n):
                    n, b, purity = cn, cb, (cb + 4 * purity) / (cn + 4)
        out[page_id] = label or ("block" if purity > 0.8 else "allow")
    return out


def test_template_purity(spark):
    rules = [("bad.com", "/spam/good", "allow"), ("bad.com", "/spam/x", "block"), ("ok.com", "/a/", "allow"), ("mixed.com", "/a/", "allow"), ("mixed.com", "/b/x", "block")]
    data = [(i, f"http://bad.com/spam/x{i}/{i}") for i in range(40)]
    data += [(100 + i, f"http://bad.com/spam/y{i}/{i}") for i in range(3)]  # no label below `*`: the branch's purity
    data += [(200 + i, f"http://bad.com/news/{i}") for i in range(10)]  # no label: the host's
    data += [(300 + i, f"http://ok.com/a/{i}") for i in range(30)] + [(400, "http://ok.com/b/1"), (401, "http://new.com/")]
    data += [(500 + i, f"http://mixed.com/a/{i}") for i in range(30)] + [(600 + i, f"http://mixed.com/b/x{i}") for i in range(20)]
    data += [(700 + i, f"http://mixed.com/{s}/y{i}") for i, s in enumerate("abc")]
    rows = {r.page_id: r for r in urlfilter.filter_urls(frame(spark, data), rules).collect()}
    verdict = {k: r.verdict for k, r in rows.items()}
    assert {verdict[i] for i in range(40)} == {"block"}
    assert {verdict[100 + i] for i in range(3)} == {verdict[200 + i] for i in range(10)} == {"block"}
    assert verdict[400] == verdict[401] == verdict[300] == "allow"
    # A branch that differs from its host is judged by its own labels, one without labels by the host's.
    assert (verdict[700], verdict[701], verdict[702]) == ("allow", "block", "allow")
    assert rows[5].template == "bad.com/spam/x#/#" and rows[100].template == "bad.com/spam/*/#"
    assert verdict == brute(data, rules)


def test_verdicts_against_brute_force(spark):
    pages = cases.table(spark, "sf0.1", "pages")
    data = [(r.page_id, r.url) for r in pages.collect()]
    rows = urlfilter.filter_urls(pages).collect()
    assert {r.page_id: r.verdict for r in rows} == brute(data, urlfilter.RULES)
    assert any(r.rule is None and r.verdict == "block" for r in rows) and any(r.rule is None and r.verdict == "allow" for r in rows)


def test_long_paths(spark):
    data = [(i, "http://net.com/" + "a/" * 50_000 + str(i)) for i in range(3)]
    rows = urlfilter.filter_urls(frame(spark, data)).collect()
    assert len(rows) == 3 and {len(r.path) for r in rows} == {100_002}


def test_repeated_and_null_ids_and_empty(spark):
    data = [(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://a.org/fr/")]
    rows = urlfilter.filter_urls(frame(spark, data)).collect()
    assert sorted((r.page_id is None, r.verdict) for r in rows) == [(False, "block"), (False, "block"), (True, "allow")]
    assert urlfilter.filter_urls(frame(spark, [])).count() == 0


def test_no_python_in_plan(spark):
    plan = urlfilter.filter_urls(cases.table(spark, "sf0.001", "pages"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('/root/testdata/{sf}/pages.parquet')")
    got = queries()["op4_url_filters"](spark, f"/root/testdata/{sf}")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()['op4_url_filters']})").fetchall()
    cases.same(got, want)
