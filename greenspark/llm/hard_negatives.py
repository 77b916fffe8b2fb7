"""Hard negatives by integer inner products computed in a residue number system.

Vectors of integers are reduced modulo several small odd primes, centred, and multiplied as float32 matrices, one product
per prime.  A slice of the dimensions is chosen so that every sum of products stays below 2**24, where float32 is exact.
The residues of a score are put together by Chinese remaindering with centred mixed-radix digits, which gives the signed
score itself as soon as the product of the primes exceeds twice the largest possible score; the number of primes
follows from the largest vector norm (Cauchy-Schwarz), so scores are exact at any scale of the vectors.

Anchors and rows are dealt by hash into blocks of bounded size; a cell of the grid (anchor block, row block) is one group
of a cogroup and yields at most ``positives`` or ``positives * negatives`` rows per anchor.  The best of all cells are
picked by windows per anchor, whose input Spark limits before it shuffles.  No row is broadcast and no list is cut: the
first rows of the whole table are among the first rows of the cells.

Defined results: rows with a null id, label or vector, or with a null or non-finite component (also after scaling) take no
part; equal rows count once; rows that share an id but differ are different rows, and equal scores go by id, label and
vector; missing components of shorter vectors count as 0; an anchor without positives, or a positive without negatives
in its window, has no rows; scores beyond a long, which only huge components reach, are ordered exactly and
returned as null; an empty table has no rows; other columns stay unread.
"""

from __future__ import annotations

from math import ceil, isqrt, prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greenspark.operators.lineage import cut

ANCHOR_BLOCK, ROW_BLOCK = 4096, 8192
AT_ONCE = 64  # anchors whose scores are sorted together
EXACT = 1 << 24
LONG = 1 << 63


def _primes() -> list[int]:
    """Odd primes from 251 down, then from 257 up."""
    odd = [n for n in range(3, 4096, 2) if all(n % d for d in range(3, isqrt(n) + 1, 2))]
    return sorted(n for n in odd if n < 256)[::-1] + [n for n in odd if n > 256]


def moduli(bound: int) -> list[int]:
    """The fewest primes of the list whose product exceeds ``2 * bound``."""
    chosen: list[int] = []
    for p in _primes():
        if prod(chosen) > 2 * bound:
            return chosen
        chosen.append(p)
    if prod(chosen) > 2 * bound:
        return chosen
    raise ValueError("components are too large for the table of primes")


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """Centred residues modulo ``p`` of whole numbers held as doubles."""
    r = np.fmod(values, p)
    half = (p - 1) // 2
    r = np.where(r > half, r - p, r)
    return np.where(r < -half, r + p, r).astype(np.float32)


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p`` for centred residues, in exact float32 slices."""
    step = max((EXACT - 1) // ((p - 1) // 2) ** 2, 1)
    total = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, a.shape[1], step):
        total += (a[:, k:k + step] @ b[:, k:k + step].T).astype(np.int64)
    return total % p


def combined(parts: list[np.ndarray], primes: list[int], exact: bool) -> np.ndarray:
    """Signed values from residues by centred mixed-radix digits; ``exact`` uses Python integers beyond a long."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        left = parts[k]
        for j in range(k):
            left = (left - digits[j]) * pow(primes[j], -1, p) % p
        digits.append(np.where(left > (p - 1) // 2, left - p, left))
    total, weight = np.zeros(parts[0].shape, object if exact else np.int64), 1
    for digit, p in zip(digits, primes, strict=True):
        # below a long the sum is right even if a partial sum wraps around
        total = total + (digit.astype(object) * weight if exact else digit * np.int64((weight + LONG) % (2 * LONG) - LONG))
        weight *= p
    return total


class Scorer:
    """Exact scores of a few anchors against a block of rows."""

    def __init__(self, rows: np.ndarray, bound: int):
        self.primes, self.exact = moduli(bound), 100 * bound >= LONG
        self.rows = [residues(rows, p) for p in self.primes]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return combined([residue_product(residues(anchors, p), r, p) for p, r in zip(self.primes, self.rows, strict=True)],
                            self.primes, self.exact)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def _cell(anchors: pd.DataFrame, rows: pd.DataFrame, width: int, bound: int):
    """(anchor, keys of the rows best first, their scores) for each anchor of a cell; ties by id, label and vector hash."""
    rows = rows.sort_values(["vec_id", "label", "mark"], kind="stable", ignore_index=True)
    ids, labels, marks = (rows[c].to_numpy() for c in ("vec_id", "label", "mark"))
    scorer = Scorer(_matrix(rows["q"], width), bound)
    for k in range(0, len(anchors), AT_ONCE):
        some = anchors.iloc[k:k + AT_ONCE]
        scores = scorer.scores(_matrix(some["a_q"], width))
        for anchor, line, by in zip(some.itertuples(index=False), scores, np.argsort(-scores, axis=1, kind="stable"), strict=True):
            yield anchor, ids[by], labels[by], marks[by], line[by]


def _table(parts: list[tuple], form: str) -> pd.DataFrame:
    """One row for each entry of the last column of a part; the other entries are arrays as long, or single values."""
    names = [c.split()[0] for c in form.split(", ")]
    columns = [np.concatenate([np.broadcast_to(p[k], p[-1].shape) for p in parts]) if parts else np.empty(0, object)
               for k in range(len(names))]
    return pd.DataFrame(dict(zip(names, columns, strict=True)))


def _text(scores: np.ndarray) -> np.ndarray:
    return np.array([str(s) for s in scores.tolist()], object)


_FOUND = "a_id bigint, a_label int, a_mark bigint, p_id bigint, p_label int, p_mark bigint, score string"


def _positives(count: int, width: int, bound: int):
    def best(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for a, ids, labels, marks, scores in _cell(anchors, rows, width, bound) if len(anchors) and len(rows) else ():
            near = np.flatnonzero((labels == a.a_label) & ((ids != a.a_id) | (marks != a.a_mark)))[:count]
            if len(near):
                parts.append((a.a_id, a.a_label, a.a_mark, ids[near], labels[near], marks[near], _text(scores[near])))
        return _table(parts, _FOUND)

    return best


_MINED = ("a_id bigint, a_label int, a_mark bigint, p_id bigint, p_label int, p_mark bigint, p_score string, "
          "n_id bigint, n_label int, n_mark bigint, score string")


def _negatives(count: int, low: int, high: int, width: int, bound: int):
    def best(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for a, ids, labels, marks, scores in _cell(anchors, rows, width, bound) if len(anchors) and len(rows) else ():
            other = np.flatnonzero(labels != a.a_label)
            against = -100 * scores[other]  # ascending
            for p_id, p_label, p_mark, p_score in zip(a.p_ids, a.p_labels, a.p_marks, a.p_scores, strict=True):
                first = np.searchsorted(against, -high * int(p_score), "left")
                last = np.searchsorted(against, -low * int(p_score), "right")
                k = other[first:max(first, min(first + count, last))]
                if len(k):
                    parts.append((a.a_id, a.a_label, a.a_mark, p_id, p_label, p_mark, p_score, ids[k], labels[k], marks[k], _text(scores[k])))
        return _table(parts, _MINED)

    return best


def _usable(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, q, mark): scaled and floored vectors of the rows that take part, equal rows once."""
    plain = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"),
                           F.col("embedding").cast("array<double>").alias("v"))
    scaled = plain.where("vec_id is not null and label is not null and v is not null").withColumn(
        "q", F.transform("v", lambda x: x * scale))
    # floor of a double as a double: beyond 2**52 every double is whole
    whole = F.transform("q", lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))
    finite = ~F.exists("q", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = scaled.where(finite).select("vec_id", "label", whole.alias("q")).withColumn("mark", F.xxhash64("q"))
    keys = ["vec_id", "label", "mark"]
    repeated = not rows.groupBy(*keys).count().where("count > 1").isEmpty()
    return cut(rows.dropDuplicates(keys)) if repeated else rows


def _best(found: DataFrame, keys: list[str], ties: list[str], count: int, exact: bool) -> DataFrame:
    """The first ``count`` rows per key by score, best first; scores beyond a long are ordered by sign, length and digits."""
    order = [F.col("score").cast("bigint").desc()] if not exact else [
        (F.when(F.col("score").startswith("-"), -F.length("score")).otherwise(F.length("score"))).desc(),
        F.when(F.col("score").startswith("-"), F.lit(None)).otherwise(F.col("score")).desc_nulls_last(),
        F.col("score").asc()]
    by = Window.partitionBy(*keys).orderBy(*order, *ties)
    return found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= count)


def hard_negatives(vectors: DataFrame, is_anchor: Column, scale: float = 1.0, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of each anchor and positive: other labels that score ``low`` to ``high`` per cent of the positive.

    ``vectors(vec_id, label, embedding)``; a component x counts as floor(scale * x).  The positives of an anchor are its
    best rows of the same label.  Gives (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).
    """
    usable = _usable(vectors, scale)
    sizes = usable.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("anchors"), F.max(F.size("q")).alias("width"),
                       F.max(F.aggregate("q", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))).alias("largest"),
                       F.max(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")).first()
    width = max(sizes["width"] or 1, 1)
    norm = sizes["norm"] or 0.0
    bound = ceil(norm * (1 + 1e-9)) + 1 if norm != float("inf") else width * int(sizes["largest"]) ** 2
    exact = 100 * bound >= LONG
    n_anchor, n_row = -(-sizes["anchors"] // ANCHOR_BLOCK) or 1, -(-sizes["n"] // ROW_BLOCK) or 1

    def dealt(df: DataFrame, keys: tuple[str, ...], own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64(*keys), F.lit(n_own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))).groupBy("_ab", "_rb")

    # a cogroup needs columns of its own on each side
    rows = dealt(usable, ("vec_id", "label", "mark"), "_rb", n_row, "_ab", n_anchor)
    key = ("a_id", "a_label", "a_mark")
    anchors = usable.where(is_anchor).select(F.col("vec_id").alias("a_id"), F.col("label").alias("a_label"),
                                             F.col("mark").alias("a_mark"), F.col("q").alias("a_q"))
    near = dealt(anchors, key, "_ab", n_anchor, "_rb", n_row).cogroup(rows).applyInPandas(_positives(positives, width, bound), _FOUND)
    chosen = _best(near, [*key], ["p_id", "p_label", "p_mark"], positives, exact)
    listed = cut(chosen.groupBy(*key).agg(F.collect_list(F.struct("p_id", "p_label", "p_mark", "score")).alias("_p")).select(
        *key, *[F.col(f"_p.{c}").alias(f"{c}s") for c in ("p_id", "p_label", "p_mark")], F.col("_p.score").alias("p_scores")))
    mined = dealt(anchors.join(listed, [*key]), key, "_ab", n_anchor, "_rb", n_row).cogroup(rows).applyInPandas(
        _negatives(negatives, low, high, width, bound), _MINED)
    picked = _best(mined, [*key, "p_id", "p_label", "p_mark"], ["n_id", "n_label", "n_mark"], negatives, exact)
    return picked.select(
        F.col("a_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), F.col("place").alias("rank"),
        F.col("n_id").alias("negative_id"), F.col("p_score").try_cast("bigint").alias("positive_score"),
        F.col("score").try_cast("bigint").alias("negative_score"))


def negatives_digest(vectors: DataFrame) -> DataFrame:
    """Anchors are ids divisible by 100; ids divisible by 7 carry the next label."""
    shifted = vectors.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(
        F.col("label")).cast("int").alias("label"), "embedding")
    return hard_negatives(shifted, F.col("vec_id") % 100 == 0, 256.0)


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank,
       s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""
