"""The URL filter on hosts that its table does not name, and its parts against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from greenspark.llm import url_filter

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.train(url_filter.labelled_urls(spark))


def blocked(spark, model, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    return {r["url"] for r in url_filter.judge(df, model, rules=()).collect() if r["verdict"] == "block"}


def test_ordinary_hosts_are_not_blocked(spark, model):
    rnd = random.Random(8)
    words = """paper orange bridge window silver harbor lantern meadow copper basket thunder pencil violin anchor marble
    tunnel ribbon candle forest engine saddle helmet bottle magnet rocket turtle falcon cactus glacier canyon""".split()
    letters = ["".join(rnd.choice("etaoinshrdlcumwfgypbvk") for _ in range(rnd.randrange(5, 12))) for _ in range(200)]
    joined = [rnd.choice(words) + rnd.choice(["", "-"]) + rnd.choice(words) for _ in range(200)]
    urls = [f"https://{rnd.choice(['', 'www.', 'm.', 'blog.'])}{h}.example.net/{rnd.choice(['en', 'fr', 'x'])}/{k}" for k, h in enumerate(letters + joined)]
    assert len(blocked(spark, model, urls)) <= 0.03 * len(urls)
    assert not blocked(spark, model, ["https://github.com/apache/spark", "https://www.essex.ac.uk/study", "https://en.wikipedia.org/wiki/Alphabet",
                                      "https://www.python.org/doc", "https://arxiv.org/abs/1234"])


def test_unwanted_hosts_are_blocked(spark, model):
    urls = [f"http://{h}/en/3" for h in ("my-casino-online.net", "livepoker.net", "casino777.net", "freepornvideos.net", "viagra-pills.net", "xxxtube.net")]
    assert len(blocked(spark, model, urls)) >= 5


def test_table_names_no_host_of_the_pages(spark):
    def site(host):
        return re.sub(r"^(www|m|blog)\.", "", host).split(".")[0]

    ours = {site(r["url"].split("://")[1].split("/")[0]) for r in url_filter.labelled_urls(spark).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(url_filter.host_of(F.col("url")).alias("h")).distinct().collect()
    assert pages and not ours & {site(r["h"] or "") for r in pages}


def test_parts_rules_and_n_grams_equal_plain_python(spark):
    urls = [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    urls += ["HTTP://A.COM/de/1?x://y", "x://", "://h", "http://example.org?q/es/", "http://a.b.example.org/en/15#f", "é://ÄB.org/ü", "a://b://c/d", "", None, "no"]
    df = url_filter.with_parts(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"))
    rule = url_filter.rule_for(F.col("_host"), F.col("_path"))["rule"]
    for r in df.select("url", "_host", "_path", "_grams", rule.alias("rule")).collect():
        rest = (r["url"] or "").partition("://")[2]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [d + p for _, d, p in url_filter.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
        assert (r["_host"], r["_path"], r["rule"]) == (host, path, max(fits, key=len, default=None))
        parts = ["^" + re.sub(r"\.[^.]*$", "", host) + "$", re.sub("[0-9]+", "0", path)]
        assert r["_grams"] == [p[i:i + n] for p in parts for n in (3, 4, 5) for i in range(len(p) - n + 1)]


def test_empty_table_and_clashing_columns(spark, model):
    df = spark.createDataFrame([(1, "http://a.net/x", 0.5, "h", 1.0)], "page_id bigint, url string, prediction double, host string, probability double")
    assert url_filter.url_digest(df.limit(0)).count() == 0
    assert [(r["host"], r["path"]) for r in url_filter.url_digest(df).collect()] == [("a.net", "/x")]
