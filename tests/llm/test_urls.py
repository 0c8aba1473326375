"""URL rules against a plain matcher, with lists of several sizes and pages that all hit one rule."""

import random

import pytest
from pyspark.sql import functions as F

from velarium.llm import urlfilter


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fits, default=(0, 0, None, "allow"))
    return host, path, rule, verdict


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "clash", i) for i, u in enumerate(urls)], "page_id long, url string, verdict string, _row long").repartition(3)
    out = urlfilter.judge(pages, urlfilter.rules_table(spark, rules)).collect()
    assert len(out) == len(urls)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}


@pytest.mark.parametrize("limits", [(1 << 22, 100_000), (16, 100_000), (1 << 22, 10)])
def test_long_lists_small_filters_and_shuffled_joins(spark, monkeypatch, limits):
    monkeypatch.setattr(urlfilter, "MOST_BLOCKS", limits[0])
    monkeypatch.setattr(urlfilter, "MOST_BROADCAST", limits[1])
    draw = random.Random(limits[0] + limits[1])
    rules = [(f"h{i % 40}.org" if i % 3 else "org", f"/p{i}/"[: 2 + i % 5], draw.choice(["allow", "block"])) for i in range(700)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{draw.choice(['', 'a.', 'b.a.'])}h{draw.randrange(45)}.{draw.choice(['org', 'ORG', 'net'])}/p{draw.randrange(900)}/{draw.randrange(9)}?q" for _ in range(1500)]
    urls += [None, "", "no scheme", "x://", "x:///", *urls[:20]]
    assert judged(spark, urls, rules) == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_one_hot_rule(spark):
    urls = ["https://www.example.com/en/70"] * 3000 + ["https://other.de/x"] * 50
    assert judged(spark, urls, urlfilter.RULES) == {i: plain(u, urlfilter.RULES) for i, u in enumerate(urls)}


def test_the_plan_has_no_python_and_exchanges_hits_only(spark):
    pages = spark.range(100).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.de/"), F.col("id")).alias("url"))
    out = urlfilter.judge(pages, urlfilter.rules_table(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "ExistingRDD", "Pandas"))
    assert "BroadcastHashJoin" in plan and "Union" in plan


def test_columns_with_the_names_used_inside(spark):
    names = ["_h", "_p", "_v", "_probe", "_row", "_probes", "_words", "own", "row", "probe", "c0"]
    pages = spark.createDataFrame([(1, "http://x.com/en/1", *names), (2, "http://x.de/", *names)], ["page_id", "url", *names])
    for rules in (urlfilter.RULES, []):
        listed = urlfilter.rules_table(spark, rules) if rules else spark.createDataFrame([], "host string, path string, verdict string")
        out = urlfilter.judge(pages, listed)
        assert out.columns == ["page_id", "url", *names, "host", "path", "rule", "verdict"]
        assert all([r[n] for n in names] == names for r in out.collect()) and out.count() == 2
