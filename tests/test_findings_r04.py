"""Cases of the fourth round's findings."""

import random

from corpuscle.operators import graph, lists
from corpuscle.plans import audit_queries
from corpuscle.plans import queries as own


def test_equal_pages_leave_the_smallest_id(spark, tmp_path):
    """Text and url are equal: the smallest id stays, in whatever order rows come; a page without a url stays only where no copy has one."""
    x, y, z = ("http://a.example/x", "<p>one</p>"), (None, "<p>two</p>"), ("http://a.example/z", "")
    rows = [(9, *x), (2, *x), (5, *x), (1, *y), (4, "http://a.example/long", "<p>two</p>"), (8, None, "<p>three</p>"), (7, None, "<p>three</p>"), (3, *z), (6, *z)]
    for n, given in enumerate((rows, rows[::-1])):
        spark.createDataFrame(given, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/{n}/pages.parquet")
        assert sorted(r.page_id for r in own.deduped_pages(spark, f"{tmp_path}/{n}").collect()) == [2, 3, 4, 6, 7]


def test_representative_pages_are_near_home(spark, tmp_path):
    """Of pages with four links each the nearest to home come first, /c/76 before /c/151, though their urls would sort the other way."""
    spark.createDataFrame([(k,) for k in range(1, 330, 25)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = audit_queries.representative_pages(spark, str(tmp_path)).orderBy("place").collect()
    want = ["/c/1", "/list?a=1&b=1", "/c/76", "/c/151", "/c/226", "/c/301"]
    assert [tuple(r) for r in got] == [("s1.example", i + 1, "http://s1.example" + path) for i, path in enumerate(want)]


def whole(nodes, edges, home, most, far):
    """Home and the first ``most`` pages, by all depths in a loop."""
    depth, row = {home: 0}, [home]
    for n in row:
        for d in sorted({d for s, d in edges if s == n} - depth.keys()):
            depth[d] = depth[n] + 1
            row.append(d)
    count = {n: sum(d == n for _, d in edges) for n in nodes}
    return [home, *sorted((n for n in nodes if n != home), key=lambda n: (-count[n], depth.get(n, far), n))[:most]]


def test_search_ends_once_lists_are_settled(spark, monkeypatch):
    """The lists are those of all depths, also where pages are farther than FAR or not reached; a long chain is not walked to its end."""
    roll, given = random.Random(4), {}
    for h in range(12):
        nodes = [f"h{h}/{c}" for c in "kbxadmqet"]
        given[f"h{h}"] = nodes, [e for e in ((roll.choice(nodes), roll.choice(nodes)) for _ in range(7 + h)) if e[0] != e[1]]
    chain = [f"long/{99 - i}" for i in range(40)]
    given["long"] = chain, list(zip(chain, chain[1:]))
    for far, hosts in ((99, [*given]), (2, [*given][:-1])):
        monkeypatch.setattr(lists, "FAR", far)
        nodes = spark.createDataFrame([(h, n) for h in hosts for n in given[h][0]], "host string, node string")
        homes = spark.createDataFrame([(h, given[h][0][0]) for h in hosts], "host string, node string")
        links = spark.createDataFrame([e for h in hosts for e in given[h][1]], "src string, dst string")
        found = lists.ranked_nodes(nodes, graph.in_degree(links, nodes.select("node")), None, homes).drop("depth").cache()
        depths = graph.depths(links, homes, onward=lists.unsettled(found, 3)).cache()
        got = lists.representative_pages(found.join(depths, "node", "left"), 3).orderBy("host", "place").collect()
        for h in hosts:
            assert [r.node for r in got if r.host == h] == whole(*given[h], given[h][0][0], 3, far)
        if far == 99:
            assert depths.filter("node LIKE 'long%'").count() == 4
