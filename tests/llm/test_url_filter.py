import duckdb
import pytest

from marquee.llm import queries as Q
from marquee.llm import url_filter as U

CASES = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"),
    ("http://net", "net", "", None, None),
    ("https://WWW.Example.NET/en/1?x=/de/#y", "www.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/EN/", "example.net", "/EN/", "net/", "block"),
    ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("http://b.example.com/de/", "b.example.com", "/de/", "example.com/de/", "block"),
    ("http://x.org/fr/#", "x.org", "/fr/", "org/fr/", "allow"),
    ("http://x.org?a=/fr/", "x.org", "", None, None),
    ("http://ÄB.Org/fr/ü", "Äb.org", "/fr/ü", "org/fr/", "allow"),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("no scheme", "", "", None, None),
    ("://", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://h/" + "p" * 50_000, "h", "/" + "p" * 50_000, None, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, c[0], "x", "y") for i, c in enumerate(CASES)] + [(0, CASES[0][0], "x", "y"), (None, None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, score string")


def test_hosts_paths_and_rules(spark, pages):
    got = U.judge_urls(pages).collect()
    assert len(got) == pages.count()
    by_id = {r.page_id: r for r in got}
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        r = by_id[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert by_id[None].host == "" and by_id[None].score == 0


def test_model_tells_unruled_urls_apart(spark):
    rows = [(i, f"http://x.org/fr/story{i}/good") for i in range(80)] + [
        (100 + i, f"http://x.net/casino{i}?win=1") for i in range(80)]
    rows += [(300, "http://y.com/story/good"), (301, "http://y.com/casino?win=1")]
    got = {r.page_id: r for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[300].verdict, got[301].verdict) == ("allow", "block")
    assert got[300].rule is None and got[300].score > got[301].score


def test_empty_table(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_plan_has_no_python(spark, sf0001):
    plan = Q.QUERIES["op8_url_language_model"](spark, sf0001)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


def test_sql_gives_the_same(spark, pages, sf0001):
    given = {"pages": pages.select("page_id", "url").toPandas()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf0001}/pages.parquet'")
    cases = [(con, Q.QUERIES["op8_url_language_model"](spark, sf0001))]
    other = duckdb.connect()
    other.register("pages", given["pages"])
    cases.append((other, U.judge_urls(pages)))
    for c, df in cases:
        want = [tuple(r) for r in c.execute(f"SELECT host, path, rule, verdict, score FROM ({U.ORACLE})").fetchall()]
        got = [tuple(r) for r in df.select("host", "path", "rule", "verdict", "score").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
