import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.llm.reputation import SUFFIX_RULES, filtered_pages, host_of, host_reputation, labelled_outcomes, suffix_rules, with_domains

from .conftest import LONG


def _parts(spark, *urls, rules=SUFFIX_RULES):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").select("i", host_of(F.col("url")).alias("host"))
    return [tuple(r) for r in df.join(with_domains(df.select("host").distinct(), rules), "host").orderBy("i").select("host", "domain", "suffix").collect()]


def test_hosts_domains_and_suffixes(spark):
    assert _parts(spark, "http://a.b.Example.com/x?y", "https://u:p@shop.site.co.uk:80/", "http://co.uk", "ftp://localhost/x", "http://10.1.2.3/", "http://x.com./", None, "", "not a url", "HTTP://É.example.org#f") == [
        ("a.b.example.com", "example.com", "com"), ("shop.site.co.uk", "site.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("localhost", "localhost", "localhost"), ("10.1.2.3", "10.1.2.3", "10.1.2.3"),
        ("x.com", "x.com", "com"), ("", "", ""), ("", "", ""), ("", "", ""), ("é.example.org", "example.org", "org"),
    ]


def test_suffixes_from_a_list(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// comment\n\ncom\nck-like\n*.ck\n!www.ck\nCom.Ar  note\na.b.c\n")
    rules = suffix_rules(spark, str(tmp_path / "list.dat"))
    assert sorted(rules) == ["!www.ck", "*.ck", "a.b.c", "ck-like", "com", "com.ar"]
    assert _parts(spark, "http://x.y.co.ck/", "http://x.www.ck/", "http://www.ck/", "http://ck/", "http://co.ck/", "http://s.good.com.ar/", "http://z.a.b.c/", "http://b.c/", "http://x..com/", rules=rules) == [
        ("x.y.co.ck", "y.co.ck", "co.ck"), ("x.www.ck", "www.ck", "ck"), ("www.ck", "www.ck", "ck"), ("ck", "ck", "ck"), ("co.ck", "co.ck", "co.ck"), ("s.good.com.ar", "good.com.ar", "com.ar"),
        ("z.a.b.c", "z.a.b.c", "a.b.c"), ("b.c", "b.c", "c"), ("x..com", "x..com", "com"),
    ]
    assert _parts(spark, "http://good.com.ar/", "http://me.github.io/x") == [("good.com.ar", "good.com.ar", "com.ar"), ("me.github.io", "me.github.io", "github.io")]


def _strength(groups):
    top = sum((x - n * m) ** 2 - n * m * (1 - m) for n, x, m in groups)
    bottom = sum(n * (n - 1) * m * (1 - m) for n, x, m in groups)
    rho = min(0.99, max(0.001, top / bottom)) if bottom else 0.5
    return (1 - rho) / rho


def test_shrinkage_by_hand(spark):
    rng = random.Random(0)
    hosts = [f"{h}.{d}.{s}" for s in ("com", "org") for d in ("aa", "bb", "cc") for h in ("x", "y", "z")]
    rate = {h: rng.choice([0.02, 0.1, 0.9]) for h in hosts}
    rows = [(f"http://{h}/{i}", int(rng.random() < rate[h])) for h in hosts for i in range(rng.choice([0, 1, 4, 60]))]
    pages = spark.createDataFrame([(f"http://{h}/",) for h in hosts], "url string")
    got = {r["host"]: r for r in host_reputation(pages, spark.createDataFrame(rows, "url string, bad int")).collect()}
    n, x = defaultdict(float), defaultdict(float)
    for u, b in rows:
        h = u.split("/")[2]
        for key in (h, h.split(".", 1)[1], h.split(".")[2], "all"):
            n[key] += 1
            x[key] += b
    mean = {"all": (x["all"] + 1) / (n["all"] + 2)}
    var = {"all": mean["all"] * (1 - mean["all"]) / (n["all"] + 3)}
    for level, up in ((["com", "org"], lambda k: "all"), (sorted({h.split(".", 1)[1] for h in hosts}), lambda k: k.split(".")[1]), (hosts, lambda k: k.split(".", 1)[1])):
        s = _strength([(n[k], x[k], mean[up(k)]) for k in level])
        for k in level:
            mean[k] = (x[k] + s * mean[up(k)]) / (n[k] + s)
            var[k] = mean[k] * (1 - mean[k]) / (n[k] + s + 1) + (s / (n[k] + s)) ** 2 * var[up(k)]
    assert {h: got[h]["lower"] for h in hosts} == pytest.approx({h: max(0, mean[h] - 1.645 * var[h] ** 0.5) for h in hosts})
    assert {h: got[h]["mean"] for h in hosts} == pytest.approx({h: mean[h] for h in hosts})
    assert all(0 <= r["lower"] <= r["mean"] <= r["upper"] <= 1 for r in got.values())


def test_a_host_goes_with_its_domain_and_doubt_keeps_it(spark):
    pages = spark.createDataFrame([(1, "http://bad.a.com/1"), (2, "http://once.a.com/1"), (3, "http://good.b.com/"), (4, "http://new.c.com/"), (None, None), (1, "http://bad.a.com/1")], "page_id bigint, url string")
    seen = [("http://bad.a.com/1", 1)] * 60 + [("http://once.a.com/1", 1)] + [("http://good.b.com/", 0)] * 60 + [("http://g2.b.com/", None)]
    df = pages.select(F.lit("x").alias("host"), F.lit(1).alias("n"), F.lit(1).alias("mean"), "*")
    rows = filtered_pages(df, spark.createDataFrame(seen, "url string, bad int"), 0.5).collect()
    # all 61 labelled pages of a.com are bad, and that is what once.a.com, with one of them, is judged by
    assert sorted((r["page_id"] or 0, r["kept"]) for r in rows) == [(0, True), (1, False), (1, False), (2, False), (3, True), (4, True)]

    # where hosts of a domain differ, one bad page says little: the mean is past 0.5 but its lower bound isn't
    pages = spark.createDataFrame([(1, "http://x.d.com/"), (2, "http://y.d.com/"), (3, "http://once.d.com/")], "page_id bigint, url string")
    seen = [(f"http://{h}.d.com/", int(i < bad)) for h, n, bad in (("x", 200, 140), ("y", 200, 60), ("once", 1, 1)) for i in range(n)]
    rows = {r["page_id"]: r for r in filtered_pages(pages, spark.createDataFrame(seen, "url string, bad int"), 0.5).collect()}
    assert not rows[1]["kept"] and rows[2]["kept"] and rows[3]["kept"] and rows[3]["lower"] < 0.5 < rows[3]["mean"]


def test_one_bad_label_keeps_unrelated_hosts(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.site{i}.com/") for i in range(20)], "page_id bigint, url string")
    rows = filtered_pages(pages, spark.createDataFrame([("http://h0.site0.com/", 1)], "url string, bad int"), 0.15).collect()
    assert all(r["kept"] for r in rows if r["page_id"]) and len(rows) == 20


def test_hosts_no_worse_than_the_rest_stay_and_worse_ones_go(spark):
    """At the query's parameters, where the rate of all pages is above the bound."""
    rng = random.Random(4)
    hosts = [f"h{i}.d{i % 7}.com" for i in range(40)] + ["bad.farm.net"]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id bigint, url string")
    seen = [(f"http://{h}/", int(rng.random() < (0.9 if h == "bad.farm.net" else 0.25))) for h in hosts for _ in range(40)]
    rows = {r["host"]: r["kept"] for r in filtered_pages(pages, spark.createDataFrame(seen, "url string, bad int"), highest=0.15).collect()}
    assert not rows.pop("bad.farm.net") and sum(rows.values()) >= 38
    alike = [(f"http://{h}/", int(i % 4 == 0)) for h in hosts for i in range(16)]
    assert all(r["kept"] for r in filtered_pages(pages, spark.createDataFrame(alike, "url string, bad int"), highest=0.15).collect())


def test_odd_pages(spark):
    rows = [(1, None), (None, "http://a.com/x"), (2, ""), (3, "http://a.com/" + LONG), (3, "http://a.com/" + LONG), (4, "no url at all")]
    names = ["host", "domain", "suffix", "pages", "n", "bad", "mean", "lower", "kept", "overall", "k", "s", "mu", "v", "var", "tail"]
    plain = spark.createDataFrame(rows, "page_id bigint, url string")
    seen = spark.createDataFrame([("http://a.com/x", 0), (None, 1), ("", 0)], "url string, bad int")
    for df in (plain, plain.select(*(F.lit("x").alias(c) for c in names), "*")):
        got = filtered_pages(df, seen).collect()
        assert sorted(((r["page_id"], r["host"]) for r in got), key=repr) == sorted([(1, ""), (None, "a.com"), (2, ""), (3, "a.com"), (3, "a.com"), (4, "")], key=repr)
        assert all(r["kept"] for r in got)


def test_nothing_seen_and_no_pages(spark):
    none = spark.createDataFrame([], "url string, bad int")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    row = filtered_pages(pages, none).first()
    assert row["kept"] and row["mean"] == 0.5 and row["n"] == 0
    assert filtered_pages(pages.limit(0), none).count() == 0


def test_outcomes_from_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/7?x"), (2, "http://a.com/en/8.html"), (3, "http://a.com/en/9/"), (4, "http://a.com/"), (5, None), (6, "http://a.com/en/99999999999999999999"), (7, "http://a.com/en/1234567890123456789"), (8, "http://a.com/en/7abc"), (9, "http://a.com/en/07/y")], "page_id bigint, url string")
    labels = spark.createDataFrame([(7, 0, 0), (8, 1, 0), (8, 1, 1), (9, None, None), (None, 0, 0), (123456789012345678, 0, 1), (1234567890123456789, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert sorted((r["url"][-1], r["bad"]) for r in labelled_outcomes(pages, labels).collect()) == [("9", 0), ("l", 1), ("x", 1), ("y", 1)]
