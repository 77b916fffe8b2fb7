"""N-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets are one node.  The tokens are dealt into BANDS classes by hash; the BAND_ROWS smallest
of a class are its band.  Nodes that share a band are compared with the band's node that shares most bands with others and,
if similar, form a group with it.  Two bounds then say which sets can still have a partner in another group: a share of their
first tokens (``PAIR_PART``), and after that all but a (100 - pct)-th of their tokens, must stand in other groups
("met").  The matrix of the sets left has a row for each token of the union of a group's prefixes; a set opens a group of
it only if it shares ``SHARED`` of its prefix tokens with the union, if sizes agree, and if the overlap can be
large enough; the last is bounded by the sum over CLASSES token classes of the lesser number of met tokens.  The same bound holds for the
members of an opened group, and what is left is compared exactly, on whole texts.

Why nothing is lost.  With similarity t, two similar sets of sizes n and m share at least ceil(t * max(n, m)) tokens.
Order all tokens alike; then the first n - ceil(t * n) + k tokens of one set and the first m - ceil(t * m) + k of the
other share at least k tokens, for any k up to the smaller overlap.  Any order will do: the first prefixes go by hash, the
matrix by (met or not, number of sets, token), rare ones first.  All shared tokens of two groups are met, also in each class.  Different sets of fewer
tokens than ``smallest_set`` (six at 0.85, four at 0.8) are never similar; two similar sets share at least that many
tokens, so fewer than SHARED are asked where it is less.

Defined results: null, blank and empty texts have an empty set and link with nothing; a text of fewer words than a
shingle has its whole word sequence as its one shingle; a null id is skipped as a component id but keeps its row;
repeated rows are copies and link with each other; other columns stay unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greenspark.llm.common import ASCII_LOWER, small_side  # noqa: F401 (the case rule of the words)
from greenspark.llm.shingles import ODD, Shingler
from greenspark.operators.components import connected_components
from greenspark.operators.lineage import cut

SHARED = 3
PAIR_PART = 8
BANDS, BAND_ROWS = 6, 3
CLASSES = 32
BROADCAST_IDS = 1_000_000


def smallest_set(pct: int) -> int:
    """The fewest tokens of a set that is similar to a different one: n with n / (n + 1) at the limit or above."""
    return -(-pct // (100 - pct)) if pct < 100 else 1 << 31


def shared_tokens(pct: int) -> int:
    """Shared tokens asked of every pair: SHARED, or the smallest set if that is less."""
    return min(SHARED, smallest_set(pct))


def _bands(tokens: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """The band of each class that has tokens, for every set."""
    sets = np.arange(len(bounds) - 1)
    own = np.repeat(sets, np.diff(bounds))
    side = (tokens >> np.uint64(7)) % np.uint64(BANDS)
    hashes, there = np.zeros((len(sets), BANDS), np.uint64), np.zeros((len(sets), BANDS), bool)
    for b in range(BANDS):
        at = np.flatnonzero(side == b)
        if not len(at):
            continue
        first = np.searchsorted(own[at], sets)
        count = np.searchsorted(own[at], sets, "right") - first
        there[:, b] = count > 0
        h = np.full(len(sets), b + 1, np.uint64)
        for k in range(BAND_ROWS):
            token = tokens[at[np.minimum(first + k, len(at) - 1)]]
            h = (h ^ np.where(k < count, token, np.uint64(0))) * ODD[50 + k]
            h ^= h >> np.uint64(31)
        hashes[:, b] = h
    return [row[some].tolist() for row, some in zip(hashes.view(np.int64), there, strict=True)]


def _totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of the values of every set, as signed numbers."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def _sketch(size: int, pct: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, least = Shingler(size), smallest_set(pct)
        for batch in batches:
            ids = batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            for first, last, tokens, bounds in shingler.pieces(batch["text"].tolist()):
                n = np.diff(bounds)
                bands = _bands(tokens, bounds)
                yield pd.DataFrame({
                    "doc_id": ids[first:last], "n": n, "k1": _totals(tokens, bounds),
                    "k2": _totals((tokens ^ (tokens >> np.uint64(31))) * ODD[40], bounds),
                    "bands": [b if k >= least else [] for b, k in zip(bands, n.tolist(), strict=True)]})

    return rows


_ROWS = "node bigint, grp bigint, n int, token bigint"


def _tokens(size: int, pct: int, part: int = 0):
    """(node, grp, n, token) of all tokens of every set that can have a partner; with ``part``, of their first ones.

    These are as many that two similar sets share a ``part``-th of the smaller one, or ``shared_tokens`` if that is more.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, least, asked = Shingler(size), smallest_set(pct), shared_tokens(pct)
        for batch in batches:
            nodes, groups = batch["node"].to_numpy(np.int64), batch["grp"].to_numpy(np.int64)
            for first, last, tokens, bounds in shingler.pieces(batch["text"].tolist()):
                n = np.diff(bounds)
                taken = n if not part else np.minimum(n, n - -(-pct * n // 100) + np.maximum(asked, n // part))
                own = np.repeat(np.arange(last - first), n)
                some = (np.arange(len(tokens)) - bounds[:-1][own] < taken[own]) & (n >= least)[own]
                own = own[some]
                yield pd.DataFrame({"node": nodes[first:last][own], "grp": groups[first:last][own], "n": n[own].astype(np.int32),
                                    "token": tokens[some].view(np.int64)})

    return rows


def _similar(size: int, pct: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(size)
        for batch in batches:
            made = []
            for side in ("b", "a"):
                codes, _ = pd.factorize(batch[side])
                texts = batch["text_" + side].to_numpy()[np.unique(codes, return_index=True)[1]].tolist()
                sets = [tokens[x:y] for _, _, tokens, bounds in shingler.pieces(texts)
                        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                made.append((codes, sets))
            (code_b, sets_b), (code_a, sets_a) = made
            linked = np.zeros(len(batch), bool)
            for k, (i, j) in enumerate(zip(code_a.tolist(), code_b.tolist(), strict=True)):
                left, right = sets_a[i], sets_b[j]
                both = len(np.intersect1d(left, right, assume_unique=True))
                linked[k] = 100 * both >= pct * (len(left) + len(right) - both)
            yield batch.loc[linked, ["a", "b"]]

    return rows


def _verified(pairs: DataFrame, texts: DataFrame, size: int, pct: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar.  Only texts that stand in a pair are moved."""
    needed = small_side(cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), BROADCAST_IDS)
    those = texts.join(needed, "node", "left_semi")
    left = pairs.join(those.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(those.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(_similar(size, pct), "a bigint, b bigint")


def _stars(nodes: DataFrame) -> DataFrame:
    """(a, b): every node and, for each of its bands, the node of the band that shares most bands with others."""
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("there")).where("there > 1"))
    met = cut(banded.join(shared, "band"))
    fame = met.groupBy("node").agg(F.sum("there").alias("fame"))
    leaders = met.select("node", "band").join(fame, "node").groupBy("band").agg(
        F.min_by("node", F.struct(-F.col("fame"), F.col("node"))).alias("b"))
    return cut(met.join(leaders, "band").where("node <> b").select(F.col("node").alias("a"), "b").distinct())


def _met(rows: DataFrame) -> DataFrame:
    """The rows whose token stands in two groups or more.

    A set has a token once, so no token has more than one in as many rows as the sets have tokens here.
    """
    here = Window.partitionBy("token")
    return (rows.withColumn("_lo", F.min("grp").over(here)).withColumn("_hi", F.max("grp").over(here))
            .where("_lo < _hi").drop("_lo", "_hi"))


def _can_be(n: Column, m: Column, reach: Column, other: Column, pct: int) -> Column:
    """Whether sets of ``n`` and ``m`` tokens can be similar, given their met tokens in each class."""
    needed = (n + m) * pct

    def enough(most):
        return most * (100 + pct) >= needed

    total = F.least(reach[CLASSES], other[CLASSES])  # the last entry is the sum, which is cheap to look at first
    by_class = F.aggregate(F.zip_with(reach, other, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)  # the total counts in both sums
    return enough(total) & enough(by_class - total)


def _candidates(grouped: DataFrame, size: int, pct: int) -> DataFrame:
    """(a, b) of all nodes of different groups that can be similar by the bounds of the matrix."""
    first = _met(grouped.mapInPandas(_tokens(size, pct, PAIR_PART), _ROWS))
    asked = F.greatest(F.lit(shared_tokens(pct)), F.floor(F.col("n") * pct / (100 * PAIR_PART)))
    near = cut(first.groupBy("node").agg(F.count(F.lit(1)).alias("met"), F.max("n").alias("n")).where(F.col("met") >= asked).select("node"))
    rows = cut(_met(grouped.join(small_side(near, BROADCAST_IDS), "node", "left_semi").select("node", "grp", "text")
                    .mapInPandas(_tokens(size, pct), _ROWS)))

    token_class = F.pmod(F.shiftright("token", 20), F.lit(CLASSES))
    count = F.count(F.lit(1)).cast("int")
    sets = cut(rows.groupBy("node").agg(
        F.max("grp").alias("grp"), F.max("n").alias("n"),
        F.array(*[F.count(F.when(token_class == h, 1)).cast("int") for h in range(CLASSES)], count).alias("reach"))
        .where(F.col("reach")[CLASSES] * 100 >= F.col("n") * pct))
    rare = rows.select("node", "token").join(sets, "node").withColumn("_sets", F.count(F.lit(1)).over(Window.partitionBy("token")))
    place = F.row_number().over(Window.partitionBy("node").orderBy("_sets", "token"))
    length = F.col("reach")[CLASSES] - F.ceil(F.col("n") * pct / 100) + shared_tokens(pct)  # what is not met stands before
    prefix = cut(rare.withColumn("_place", place).where(F.col("_place") <= length).drop("_place", "_sets"))

    groups = sets.groupBy(F.col("grp").alias("grp_b")).agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"),
        F.array(*[F.max(F.col("reach")[h]) for h in range(CLASSES + 1)]).alias("reach_b"))
    matrix = prefix.select("token", F.col("grp").alias("grp_b")).distinct().join(groups, "grp_b")
    least = F.greatest(F.col("lo"), F.ceil(F.col("n") * pct / 100))
    fits = ((F.col("grp") < F.col("grp_b")) & (F.col("hi") * 100 >= F.col("n") * pct) & (F.col("n") * 100 >= F.col("lo") * pct)
            & _can_be(F.col("n"), least, F.col("reach"), F.col("reach_b"), pct))
    opened = (prefix.select("node", "grp", "n", "reach", "token").join(matrix, "token").where(fits)
              .groupBy("node", "grp_b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= shared_tokens(pct)))
    mine = cut(opened.select("node", "grp_b")).join(sets.drop("grp"), "node")
    member = sets.select(F.col("grp").alias("grp_b"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("reach").alias("reach_b"))
    alike = ((F.col("m") * 100 >= F.col("n") * pct) & (F.col("n") * 100 >= F.col("m") * pct)
             & _can_be(F.col("n"), F.col("m"), F.col("reach"), F.col("reach_b"), pct))
    return cut(mine.join(member, "grp_b").where(alike).select(F.col("node").alias("a"), "b"))


def similar_components(docs: DataFrame, size: int = 4, pct: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketches = cut(docs.mapInPandas(_sketch(size, pct), "doc_id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>"))
    keyed = sketches.where("n > 0 and doc_id is not null")
    nodes = cut(keyed.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    texts = docs.join(small_side(nodes.where(F.col("n") >= smallest_set(pct)).select(F.col("node").alias("doc_id")), BROADCAST_IDS),
                      "doc_id", "left_semi")
    texts = texts.dropDuplicates(["doc_id"]) if _repeats(sketches) else texts
    texts = texts.select(F.col("doc_id").alias("node"), "text")

    stars = cut(_verified(_stars(nodes), texts, size, pct))
    groups = cut(connected_components(stars))
    grouped = texts.join(small_side(groups, BROADCAST_IDS), "node", "left").withColumn(
        "grp", F.coalesce("component", "node")).drop("component")
    pairs = _candidates(grouped, size, pct)
    labels = groups if pairs.isEmpty() else cut(connected_components(stars.unionByName(_verified(pairs, texts, size, pct))))
    named = cut(nodes.select("n", "k1", "k2", "node").join(labels, "node", "left").select(
        F.col("n").alias("_n"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.coalesce("component", "node").alias("component")))
    same = (F.col("n") == F.col("_n")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    return sketches.join(small_side(named, BROADCAST_IDS), same, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _repeats(sketches: DataFrame) -> bool:
    """Whether some doc_id stands on two rows."""
    return not sketches.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def one_of_each(docs: DataFrame, size: int = 4, pct: int = 85) -> DataFrame:
    """``docs`` with the document of the smallest id of each component; rows without an id stay."""
    found = similar_components(docs, size, pct).where("doc_id is not null")
    gone = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    left = docs.join(small_side(gone, BROADCAST_IDS), F.col("doc_id") == F.col("_gone"), "left_anti")
    repeated = cut(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")))
    if repeated.isEmpty():
        return left
    twice = small_side(repeated, BROADCAST_IDS)
    again = left.join(twice, F.col("doc_id") == F.col("_again"), "left_semi").dropDuplicates(["doc_id"])
    return left.join(twice, F.col("doc_id") == F.col("_again"), "left_anti").unionByName(again)


def jaccard_digest(docs: DataFrame) -> DataFrame:
    return similar_components(docs, 4, 85)
