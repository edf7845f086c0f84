from pyspark.sql import functions as F

from terrajobs.llm import hosts, url_filter as op

from .common import SMALL

URLS = [
    (1, "http://NET/"), (2, "https://a.b.net/x"), (3, "http://example.net/en/a"), (4, "http://www.example.net/de/"), (5, "http://www.example.com/de/1?x#y"), (6, "http://example.com/de"),
    (7, "http://q.org/fr/"), (8, None), (9, "no scheme"), (10, "http://user@Host.co.uk:80/p?q://z"), (11, "x://y?net/"), (12, "http://badnet/"), (13, "http://10.0.0.1/a"), (14, "://"), (13, "http://10.0.0.1/a"), (None, "http://a.net#/"),
]


def test_rules_and_parts(spark):
    df = spark.createDataFrame([(p, u, "h") for p, u in URLS], "page_id long, url string, host string").drop("host")
    out = op.judge(df, spark.createDataFrame([], "page_id long, bad int"))
    assert out.count() == len(URLS)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got[1] == ("net", "/", "net/", "block") and got[2][2:] == ("net/", "block")
    assert got[3][2:] == ("example.net/en/", "allow") and got[4][2:] == ("net/", "block")
    assert got[5] == ("www.example.com", "/de/1", "example.com/de/", "block") and got[6][2:] == (None, "allow")
    assert got[7][2:] == ("org/fr/", "allow") and got[8] == ("", "", None, "allow") == got[9]
    assert got[10][:2] == ("user@host.co.uk:80", "/p") and got[11][:2] == ("y", "") and got[12][2] is None
    assert got[14] == ("", "", None, "allow") and got[None] == ("a.net", "", None, "allow")


def test_domains(spark):
    names = ["a.b.example.co.uk", "example.com", "com", "", "10.0.0.1:80", "u@x.y.org.", "co.uk"]
    rows = spark.createDataFrame([(h,) for h in names], "h string").select("h", hosts.domain_of("h").alias("d"), hosts.suffix_of("h").alias("s")).collect()
    assert [(r["d"], r["s"]) for r in rows] == [("example.co.uk", "co.uk"), ("example.com", "com"), ("com", "com"), ("", ""), ("10.0.0.1", ""), ("y.org", "org"), ("co.uk", "co.uk")]


def test_reputation_shrinks_and_blocks_only_beyond_doubt(spark):
    pages = [(i, "bad.example.org" if i < 200 else "good.example.org" if i < 400 else "new.example.org" if i < 402 else f"h{i % 20}.other.com") for i in range(1000)]
    outcomes = [(i, int(i < 190 or i == 400)) for i in range(1000) if i != 401]
    out = op.host_reputation(spark.createDataFrame(pages, "page_id long, host string"), spark.createDataFrame(outcomes, "page_id long, bad int"))
    got = {r["host"]: r for r in out.collect()}
    assert got["bad.example.org"]["bad_bound"] > 0.5 > got["new.example.org"]["bad_bound"]
    assert got["good.example.org"]["bad_mean"] < 0.1
    assert got["new.example.org"]["n_labelled"] == 1 and got["h3.other.com"]["bad_mean"] < got["new.example.org"]["bad_mean"] < 1


def test_repeated_and_null_labels(spark):
    pages = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "b")], "page_id long, host string")
    said = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "page_id long, bad int")
    got = {r["host"]: r["n_labelled"] for r in op.host_reputation(pages, said).collect()}
    assert got == {"a": 2, "b": 0}


def test_empty_and_query(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert op.judge(none, spark.createDataFrame([], "page_id long, bad int")).count() == 0
    assert op.op5_url_filter(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/pages.parquet").count()
