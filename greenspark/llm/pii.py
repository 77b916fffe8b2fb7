r"""Personal data: four kinds by rule, more by bootstrapped contexts.

The rules find e-mail addresses, IP addresses, card and phone numbers.  They seed the bootstrap: the two words before a
found identifier are a lexical pattern of its kind; every token with a digit or an at sign is an instance, and tokens that only a
blank (or a hyphen or dot in blanks) parts, digits or a bracket on both sides, are one.  Patterns and
instances form a graph that is scored in rounds: a pattern by the mean score of its instances, an instance by the mean
score of its patterns, seeds fixed at one.  Instances without a span that follow a pattern of high score and enough distinct
seeds become spans of the pattern's kind.

The regular expressions are rewritten so that a Java matcher needs no recursion on long texts: separators that continue an
entity are first replaced by a marker of the same length, after which one character class is enough, and a lookbehind keeps
failed matches from starting anew inside a run.

Defined results: null and empty texts have no spans; repeated rows and ids get the spans of their own text; ties in scores do
not matter, as only thresholds are used; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenspark.llm.common import let, small_side
from greenspark.operators.lineage import cut

KINDS = ("email", "ip", "card", "phone")
MARK, STAND_IN = "\x01", "\x02"
ROUNDS, MIN_SCORE, MIN_SEEDS = 3, 0.6, 3
CONTEXT = 64
BROADCAST_DOCS = 200_000

_LOCAL, _LABEL = r"A-Za-z0-9._%+\x01-", "A-Za-z0-9-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]+\x01[A-Za-z0-9\x01-]+"
IP = r"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9][0-9\x01]*[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
BETWEEN_GROUPS = r"(?<=[0-9)]|[0-9)]\x20[.-])\x20(?=\(?[0-9]|[.-]\x20\(?[0-9])"
SPAN = "array<struct<kind:int,start:int,end:int,found:string>>"


def _blocks(items: Column) -> Column:
    """An array cut into stretches of about the square root of its size, so that no fold grows a long array; ``items`` is bound."""
    width = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), width), lambda k: F.slice(items, k, width))


def _steps(text: Column, pattern: str, body: Callable[[Column], Column]) -> Column:
    """``body`` of the matches of a text as structs (hits, gaps): each match and the part between it and the one before."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return let(both, lambda x: let(
        F.arrays_zip(x["hits"].alias("hits"), F.slice(x["gaps"], 1, F.size(x["hits"])).alias("gaps")), body))


def _walked(steps: Column, kind: int) -> Column:
    """Bound ``steps`` as structs (kind, start, end, found), in code points.

    The parts between the matches and the matches themselves have the same number of characters as the text.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, e: Column) -> Column:
        begin = acc["at"] + F.length(e["gaps"])
        end = begin + F.length(e["hits"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(
            F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), e["hits"].alias("found")))).alias("spans"))

    def shifted(parts: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(parts, none, lambda acc, b: F.struct(
            (acc["at"] + b["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]
        return F.flatten(F.zip_with(parts, starts, lambda b, at: F.transform(b["spans"], lambda s: F.struct(
            s["kind"].alias("kind"), (s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["found"].alias("found")))))

    return let(F.transform(_blocks(steps), lambda b: F.aggregate(b, start, step)), shifted)


def _placed(text: Column, pattern: str, kind: int) -> Column:
    """Matches as structs (kind, start, end, found), in code points."""
    return _steps(text, pattern, lambda steps: _walked(steps, kind))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    numbers = F.transform(F.reverse(F.split(digits, "")), lambda d: d.cast("int"))
    weighed = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> Column:
    """The spans of the four rules, by kind as listed, then by start."""
    none = F.array().cast(SPAN)
    plain = F.coalesce(text, F.lit(""))
    plain = F.when(F.instr(plain, MARK) > 0, F.regexp_replace(plain, MARK, STAND_IN)).otherwise(plain)
    dotted = F.regexp_replace(plain, rf"(?<=[{_LABEL}])\.(?=[{_LABEL}])", MARK)
    joined = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", MARK)
    octet = r"0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    email = F.when(F.instr(plain, "@") > 0, let(dotted, lambda t: _placed(t, EMAIL, 0))).otherwise(none)
    ip = F.filter(_placed(plain, IP, 1), lambda s: s["found"].rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"))
    card = F.filter(let(joined, lambda t: _placed(t, CARD, 2)), lambda s: let(
        _digits(s["found"]), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False))))
    phone = F.when(F.instr(plain, "+") > 0, F.filter(
        _placed(plain, PHONE, 3), lambda s: F.length(_digits(s["found"])).between(8, 15))).otherwise(none)
    some = F.when(plain.rlike("[0-9]"), F.concat(ip, card, phone)).otherwise(none)
    return F.concat(email, some)


def _instances(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, end, kind or null, instance, pattern) of every token with a digit or an at sign, digit groups joined."""
    having = docs.where(F.col("text").rlike("[0-9@]")).select(
        "doc_id", F.unhex(F.md5("text")).alias("text_key"), "text", base_spans(F.col("text")).alias("base"))
    tokens = having.select("doc_id", "text_key", F.explode(let(F.col("base"), lambda base: _steps(
        F.regexp_replace("text", BETWEEN_GROUPS, MARK), TOKEN, lambda steps: _in_context(steps, base)))).alias("t"))
    words = F.filter(F.split(F.lower(F.col("t")["before"]), r"[^\p{L}]+"), lambda w: w != "")
    pattern = F.when(F.size(words) >= 2, F.concat_ws(" ", F.slice(words, -2, 2)))
    return tokens.select(
        "doc_id", "text_key", F.col("t")["start"].alias("start"), F.col("t")["end"].alias("end"), F.col("t")["seed"].alias("kind"),
        F.unhex(F.md5(F.col("t")["found"])).alias("instance"), pattern.alias("pattern"),
        F.length(_digits(F.col("t")["found"])).alias("n_digits"), F.contains(F.col("t")["found"], F.lit("@")).alias("has_at"))


def _in_context(steps: Column, base: Column) -> Column:
    """Tokens as structs (start, end, found, before, seed): the CONTEXT characters before, the kind of the first span of ``base`` over it.

    A token and the blank after it are two characters or more, so CONTEXT / 2 tokens before hold them all.
    """
    most = CONTEXT // 2

    def before(e: Column, i: Column) -> Column:
        near = F.slice(steps, F.greatest(i - (most - 1), F.lit(1)), F.least(i, F.lit(most)))
        text = F.concat(F.array_join(F.transform(near, lambda s: F.concat(s["gaps"], s["hits"])), ""), e["gaps"])
        return F.substring(text, -CONTEXT, CONTEXT)

    def seeded(block: Column) -> Column:
        first, last = F.get(block, F.lit(0))["at"]["start"], F.get(block, F.size(block) - 1)["at"]["end"]
        return let(F.filter(base, lambda b: (b["start"] < last) & (b["end"] > first)), lambda near: F.transform(block, lambda t: F.struct(
            t["at"]["start"].alias("start"), t["at"]["end"].alias("end"), t["at"]["found"].alias("found"), t["before"].alias("before"),
            F.get(F.filter(near, lambda b: (b["start"] < t["at"]["end"]) & (b["end"] > t["at"]["start"])), F.lit(0))["kind"].alias("seed"))))

    both = F.arrays_zip(_walked(steps, -1).alias("at"), F.transform(steps, before).alias("before"))
    return let(both, lambda tokens: F.flatten(F.transform(_blocks(tokens), seeded)))


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, score, n_seeds): patterns scored on the pattern-instance graph."""
    edges = cut(found.where("pattern is not null").groupBy("pattern", "instance").agg(F.max("kind").alias("seed")))
    seeds = edges.where("seed is not null").groupBy("instance").agg(F.max("seed").alias("kind"))
    scores = seeds.select("instance", "kind", F.lit(1.0).alias("score"))
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    degrees = edges.groupBy("instance").agg(F.count(F.lit(1)).alias("n"))
    for _ in range(rounds):
        by_pattern = (edges.select("pattern", "instance").join(scores, "instance").groupBy("pattern", "kind")
                      .agg(F.sum("score").alias("mass")))
        patterns = cut(by_pattern.join(sizes, "pattern").select("pattern", "kind", (F.col("mass") / F.col("n")).alias("score")))
        spread = (edges.where("seed is null").select("pattern", "instance").join(patterns, "pattern")
                  .groupBy("instance", "kind").agg(F.sum("score").alias("mass")).join(degrees, "instance")
                  .select("instance", "kind", (F.col("mass") / F.col("n")).alias("score"))
                  .join(seeds.select("instance"), "instance", "left_anti"))
        scores = cut(seeds.select("instance", "kind", F.lit(1.0).alias("score")).unionByName(spread))
    support = (edges.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind"))
               .agg(F.count(F.lit(1)).alias("n_seeds")))
    return patterns.join(support, ["pattern", "kind"])


def discovered(docs: DataFrame, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(doc_id, text_key, added): spans that high-confidence patterns add, one row per document with any."""
    found = cut(_instances(docs))
    trusted = cut(bootstrap(found).where((F.col("score") >= min_score) & (F.col("n_seeds") >= min_seeds))
                  .groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("best"))
                  .select("pattern", F.col("best")["kind"].alias("as_kind")))
    fresh = found.where("kind is null").join(small_side(trusted, BROADCAST_DOCS), "pattern")
    shaped = fresh.where(F.when(F.col("as_kind") == 0, F.col("has_at")).otherwise(F.col("n_digits") >= 4))
    return shaped.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct(
        F.col("as_kind").alias("kind"), "start", "end"))).alias("added"))


def personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` (rule spans) and ``spans`` (all spans), arrays of (kind, start, end)."""
    added = cut(discovered(docs.select("doc_id", "text"))).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("added").alias("_added"))
    keyed = docs.withColumn("_md5", F.unhex(F.md5("text"))).join(
        small_side(added, BROADCAST_DOCS), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_md5") == F.col("_key")), "left")
    slim = "array<struct<kind:int,start:int,end:int>>"
    base = F.transform(base_spans(F.col("text")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    more = F.coalesce(F.col("_added"), F.array().cast(slim))
    found = let(base, lambda b: F.struct(b.alias("base"), F.sort_array(F.concat(b, more)).alias("spans")))
    return keyed.withColumn("_found", found).withColumn("base", F.col("_found")["base"]).withColumn(
        "spans", F.col("_found")["spans"]).drop("_found", "_md5", "_id", "_key", "_added")


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each stretch of overlapping spans in ``text`` replaced by its first kind in angle brackets."""
    found = personal_data(docs.drop("base", "spans"))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def piece(block: Column, at: Column) -> Column:
        """The text from ``at`` to the end of the block's last span, masked."""
        first = F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))
        length = F.greatest(F.array_max(block["end"]) - at, F.lit(0))

        def step(here: Column, acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            more = F.array(F.substring(here, acc["at"] - at + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                            F.when(fresh, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

        return let(F.substring(F.col("text"), at + 1, length), lambda here: F.array_join(
            F.aggregate(block, first, lambda acc, s: step(here, acc, s))["out"], ""))

    def whole(blocks: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(blocks, none, lambda acc, b: F.struct(
            F.greatest(acc["at"], F.array_max(b["end"])).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))
        return let(starts, lambda s: F.concat(F.array_join(F.zip_with(blocks, s["starts"], piece), ""),
                                              F.substring(F.col("text"), s["at"] + 1, F.length("text"))))

    masked = let(ordered, lambda spans: let(_blocks(spans), whole))
    return found.withColumn("text", F.when(F.size("spans") > 0, masked).otherwise(F.col("text"))).select(*docs.columns)


def pii_digest(docs: DataFrame) -> DataFrame:
    found = personal_data(docs.select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))
