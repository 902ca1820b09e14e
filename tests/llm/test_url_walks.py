"""Trust and distrust walk as far as the links lead."""

from __future__ import annotations

from collections import Counter

from ebbflow.llm import url_filter


def page(i: int, host: str, *targets: str, path: str = "/") -> tuple[int, str, str]:
    return i, f"http://{host}{path}", "".join(f'<a href="http://{t}/">x</a>' for t in targets)


def test_a_long_way_to_a_blocked_host(spark):
    rows = [page(i, f"h{i}.org", f"h{i + 1}.org" if i < 11 else "bad.net") for i in range(12)] + [page(12, "bad.net", path="/es/"), page(13, "apart.org", "else.org")]
    got = {r["host"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [h for h, r in got.items() if r["verdict"] == "allow"] == ["apart.org"]
    for i in range(12):
        assert abs(got[f"h{i}.org"]["distrust"] / (0.15 * 0.85 ** (12 - i)) - 1) < 1e-9


def test_walks_end_at_the_converged_rank(spark):
    edges = [("a", "b", 3), ("a", "out", 1), ("b", "c", 1), ("b", "out", 1), ("c", "a", 2), ("c", "d", 2)]
    total, want = Counter(), {"a": 0.15}
    for s, _, n in edges:
        total[s] += n
    for _ in range(400):
        new = Counter({"a": 0.15})
        for s, d, n in edges:
            new[d] += want.get(s, 0.0) * n / total[s] * 0.85
        want = dict(new)
    score = url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, links long"), spark.createDataFrame([("a", 1.0)], "host string, weight double"))
    got = {r["host"]: r["score"] for r in score.collect()}
    assert {h for h, s in want.items() if s} == set(got) and all(abs(s / want[h] - 1) < 1e-9 for h, s in got.items())


def test_the_sql_walks_as_far(spark):
    import duckdb
    import pandas as pd

    from ebbflow.llm import sql

    rows = [page(i, f"h{i}.org", f"h{i + 1}.org" if i < 11 else "bad.net") for i in range(12)]
    rows += [page(30, "bad.net", path="/es/"), page(31, "good.com", "h9.org", "good.com"), (None, "http://h4.org/", None), (None, None, None), page(33, "apart.org", "else.org")]
    pages = pd.DataFrame({"page_id": pd.array([r[0] for r in rows], "Int64"), "url": [r[1] for r in rows], "html": [r[2] for r in rows]})  # noqa: F841
    cols = ["page_id", "host", "path", "rule", "verdict", "ruled", "trust", "distrust"]
    want = duckdb.sql(f"SELECT {', '.join(cols)} FROM ({sql.op10()})").fetchall()
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).select(*cols).collect()
    for g, w in zip(sorted(map(tuple, got), key=str), sorted(want, key=str), strict=True):
        assert g[:6] == w[:6] and abs(g[6] - w[6]) < 2e-9 and abs(g[7] - w[7]) < 2e-9
