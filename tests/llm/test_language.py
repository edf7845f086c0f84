import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from terrajobs.llm import language as op

from .common import SMALL, awkward

MEDIUM = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    out = op.op1_language_id(spark, MEDIUM)
    truth = docs.select("doc_id", F.col("lang").alias("truth"), op._fold("doc_id").alias("fold"))
    held = out.join(truth, "doc_id").where(F.col("fold") == op.HELD_OUT)
    assert held.count() > 100 and held.where("lang <> truth").count() <= 0.02 * held.count()
    assert out.where("doc_id IS NOT NULL").count() == docs.count() and out.where("confidence NOT BETWEEN 0 AND 1.0000001").count() == 0


def test_evidence_decides_where_text_is_silent(spark):
    """A document without text takes the language that its page declares, else that of its host."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(9001, "", None), (9002, None, None), (9003, "", None)], "doc_id long, text string, lang string")
    french = docs.where("lang = 'fr'").limit(30).select((F.col("doc_id") + 10000).alias("doc_id"), "text", "lang")
    shown = french.select((F.col("doc_id") * 10).alias("page_id"), F.concat(F.lit("http://tous.example.fr/x/"), "doc_id").alias("url"), F.lit("<p>x").alias("html"))
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet").unionByName(shown).unionByName(
        spark.createDataFrame([(7001, "http://tous.example.fr/y/9001", "<p>"), (7002, "http://z.example.com/9002", "<HTML lang='DE-at'>"), (7003, "http://lone.example/", "<html lang=es><p>la casa de los que no")], "page_id long, url string, html string")
    )
    out = op.identify(docs.unionByName(extra).unionByName(french), pages)
    got = {r["doc_id"]: r["lang"] for r in out.where("doc_id BETWEEN 9001 AND 9003").collect()}
    assert got[9001] == "fr" and got[9002] == "de" and got[9003] is not None
    lone = out.where("page_id = 7003").collect()
    assert len(lone) == 1 and lone[0]["doc_id"] is None and lone[0]["lang"] == "es"


def test_awkward_and_empty(spark):
    docs = awkward(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "fr").otherwise(F.col("lang")))
    pages = spark.createDataFrame([(None, None, None), (1, "http://h/1", "<html lang='fr'>"), (1, "http://h/1", "<html lang='fr'>"), (2, "x", None)], "page_id long, url string, html string")
    out = op.identify(docs, pages)
    got = Counter(r["doc_id"] for r in out.where("doc_id IS NOT NULL OR page_id IS NULL").select("doc_id").collect())
    assert got[10] == 2 and got[11] == 2 and got[1] == 1
    assert Counter(r["page_id"] for r in out.collect() if r["doc_id"] is not None or r["page_id"] is not None)[1] == 2
    assert out.where("lang IS NULL").count() == 0
    none = awkward(spark, [])
    assert op.identify(none, pages.limit(0)).count() == 0
    assert op.identify(none, pages).where("doc_id IS NOT NULL").count() == 0


def test_every_page_counts(spark):
    """Later pages of a document are rows, and their hosts' tallies hold them."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text", "lang").where("lang IS NOT NULL")
    french = docs.where("lang = 'fr'").limit(30).select((F.col("doc_id") + 10000).alias("doc_id"), "text", "lang")
    first = french.select("doc_id", F.concat(F.lit("http://first.example/"), "doc_id").alias("url"))
    later = french.select(F.col("doc_id") + 50000, F.concat(F.lit("http://mirror.example/"), "doc_id").alias("url"))
    silent = spark.createDataFrame([(9001, "", None)], "doc_id long, text string, lang string")
    pages = first.unionByName(later.toDF("doc_id", "url")).toDF("page_id", "url").withColumn("html", F.lit("<p>x"))
    pages = pages.unionByName(pages.where("page_id > 60000").limit(1)).unionByName(spark.createDataFrame([(99999, "http://mirror.example/9001", "<p>")], pages.schema))
    out = op.identify(docs.unionByName(french).unionByName(silent), pages)
    assert Counter(r["page_id"] for r in out.where("page_id IS NOT NULL").collect()) == Counter(r["page_id"] for r in pages.collect())
    mirror = out.where("host = 'mirror.example' AND doc_id IS NULL").collect()
    assert len(mirror) == 31 and all(r["text_lang"] == "fr" for r in mirror)
    assert out.where("doc_id = 9001").first()["lang"] == "fr"


def test_declared_language(spark):
    cases = {"<html lang=\"en-GB\">": "en", "<!doctype html>\n<HTML class=x xml:lang='FR'>": "fr", "<html>": None, "<p lang=de>": None, None: None, "": None, "<html lang = es dir=ltr>": "es"}
    rows = spark.createDataFrame([(k,) for k in cases], "h string").select("h", op.declared_language("h").alias("l")).collect()
    assert {r["h"]: r["l"] for r in rows} == cases


def test_pages_that_repeat_or_have_no_id_come_through_each(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat and the dog", "en")], "doc_id long, text string, lang string")
    rows = [(None, None, None)] * 5 + [(7, "http://h.example/none", "<html lang=en><p>the cat")] * 3 + [(None, "http://h.example/77", "<p>x")] * 4 + [(8, "http://h.example/1", "<p>y")] * 2
    out = op.identify(docs, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows) and Counter(r["page_id"] for r in out) == Counter(r[0] for r in rows)


def brute_fuse(units, k):
    """The posterior's best language of every unit, by dictionaries and without Spark. Units: (guess, likelihood, host, domain, suffix, declared)."""
    total = [op.PSEUDO] * k
    tally = defaultdict(lambda: [0.0] * k)
    for guess, _, *keys in units:
        total[guess] += 1
        for level, key in zip(("host", "domain", "suffix", "declared"), keys):
            if key is not None and (keys[0] is not None or keys[3] is not None):
                tally[level, key][guess] += 1
    base = [x / sum(total) for x in total]
    out = []
    for guess, likelihood, *keys in units:
        own = [float(i == guess) for i in range(k)]
        has = dict(zip(("host", "domain", "suffix", "declared"), keys))

        def shrunk(level, parent):
            if has[level] is None:
                return parent
            c = tally[level, has[level]]
            return [max(c[i] + op.STRENGTH * parent[i] - own[i], 1e-9) / (sum(c) - 1 + op.STRENGTH) for i in range(k)]

        def evidence(level):
            if has[level] is None:
                return [0.0] * k
            c = tally[level, has[level]]
            return [math.log((max(c[i] - own[i], 0.0) + op.PSEUDO * base[i]) / (sum(c) - 1 + op.PSEUDO) / base[i]) for i in range(k)]

        prior, said, ends = shrunk("host", shrunk("domain", base)), evidence("declared"), evidence("suffix")
        score = [likelihood[i] + math.log(prior[i]) + said[i] + ends[i] for i in range(k)]
        best = max(score)
        out.append((score.index(best), 1 / sum(math.exp(x - best) for x in score)))
    return out


def test_fusion_against_brute_force(spark):
    """Also where tallies do not fit in a broadcast: hot values go by broadcast, others are dealt."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        host = rng.choice([None, "hot.example", "hot.example", f"h{rng.randrange(30)}.site{rng.randrange(6)}.fr"])
        domain = None if host is None else ".".join(host.split(".")[-2:])
        likelihood = [round(rng.uniform(-3, 0), 6) for _ in range(3)]
        rows.append((i, likelihood, host, domain, None if host is None else host.split(".")[-1], rng.choice([None, None, "fr", "en", "x"])))
    df = spark.createDataFrame(rows, "id int, likelihood array<double>, host string, domain string, suffix string, declared string")
    want = brute_fuse([(r[1].index(max(r[1])), *r[1:]) for r in rows], 3)
    for limit in (1 << 20, 1200):
        got = {r["id"]: r for r in op.fuse(df, ["a", "b", "c"], limit).collect()}
        assert len(got) == len(rows)
        for i, (best, confidence) in enumerate(want):
            assert got[i]["lang"] == "abc"[best] and abs(got[i]["confidence"] - confidence) < 1e-9
    assert sum(g["lang"] != g["text_lang"] for g in got.values()) > 20


def test_evidence_overturns_weak_texts(spark):
    """Texts cut to a few letters on hosts of one language: what the page and its host say mends what the letters do not."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text", "lang").where("lang IS NOT NULL")
    weak = docs.where("length(text) > 200").select((F.col("doc_id") + 100_000).alias("doc_id"), F.substring("text", 60, 3).alias("text"), "lang")
    both = docs.unionByName(weak.withColumn("lang", F.lit(None).cast("string")))
    pages = weak.union(docs.select(F.col("doc_id"), "text", "lang")).select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("http://"), F.col("lang"), F.pmod(F.col("doc_id"), F.lit(5)), F.lit(".example."), "lang", F.lit("/p/"), "doc_id").alias("url"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<html lang="), "lang", F.lit(">"))).otherwise("<html>").alias("html"),
    )
    out = op.identify(both, pages).join(weak.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    n, text, fused = out.agg(F.count("*"), F.avg((F.col("text_lang") == F.col("truth")).cast("double")), F.avg((F.col("lang") == F.col("truth")).cast("double"))).first()
    print(f"{n} weak texts: by text alone {text:.3f}, with evidence {fused:.3f}")
    assert n > 500 and text < 0.8 and fused > 0.9
