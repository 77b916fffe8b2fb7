"""Repeated passages by sparse suffix arrays.

Of each text only the suffixes are retained that start at a minimiser: the smallest hash of ``CORE`` words among all that
start within ``PASSAGE - CORE + 1`` words.  Every passage of ``PASSAGE`` words holds one, and equal passages hold the same.
The retained suffixes are sorted by core, some words before it and some after it (as hashes of growing stretches), in
five orders that share the words out differently, and neighbours are compared.  A passage of ``PASSAGE`` words around a core
has at least 8 * a words before and 8 * b after it for some a + b = 4, so its two suffixes agree in one of the orders.  Matches
are then extended left and right on the texts, word by word, and stretches of ``PASSAGE`` words or more are kept.

Texts that are equal as a whole stand for one another: one of them is sorted, and each of them counts as one passage.
Sorting is a range shuffle on the whole suffix key, so a core that very many texts share is spread over tasks; the rows at the
ends of the ranges are compared in a second step, two rows per range.

Limits: a suffix is compared with its neighbours in five orders, not with all suffixes of its core.  Where three or more
texts agree on 40 words around a core and differ in the next ten, a match can be missed at that core; it is mostly found at
another core of the passage.

Defined results: null, blank and short texts have no passages; rows that repeat id and text are one document; a passage that
repeats inside one document counts; rows without an id take no part; extra columns stay unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from greenspark.llm.common import pandas_rows, small_side, words_bytes
from greenspark.operators.lineage import cut

PASSAGE, CORE = 50, 8
STRETCHES = (8, 16, 24, 32)
ORDERS = ((0, 32), (8, 24), (16, 16), (24, 8), (32, 0))
BROADCAST_IDS, BROADCAST_CORES = 4_000_000, 2_000_000
FLUSH_ROWS = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Hasher:
    """Word hashes of a text; remembers words."""

    def __init__(self, limit: int = 1 << 18):
        self.memo, self.limit = {}, limit

    def words(self, text: str | None) -> np.ndarray:
        words = words_bytes(text)
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w, 11)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Stretches:
    """Hashes of word ranges in constant time, from prefix sums."""

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, self.n), dtype=np.uint64)])
        self.back = _powers(_INVERSE, self.n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ranges are cut at the ends of the text; the length is part of the hash."""
        a, b = np.clip(start, 0, self.n), np.clip(end, 0, self.n)
        x = (self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def minimisers(keys: np.ndarray, width: int) -> np.ndarray:
    """Positions of the leftmost smallest key of each run of ``width`` keys (of all, if there are fewer)."""
    if not len(keys):
        return np.empty(0, np.int64)
    if len(keys) <= width:
        return np.array([int(keys.argmin())])
    runs = np.lib.stride_tricks.sliding_window_view(keys, width)
    return np.unique(np.concatenate([
        runs[at:at + 8192].argmin(axis=1) + np.arange(at, min(at + 8192, len(runs))) for at in range(0, len(runs), 8192)]))


def _suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher, held, parts = Hasher(), 0, []

    def packed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return ((first & np.uint64(0xFFFFFFFF00000000)) | (second >> np.uint64(32))).view(np.int64)

    for batch in batches:
        for doc, text in pandas_rows([batch], "doc", "text"):
            h = hasher.words(text)
            if len(h) < PASSAGE:
                continue
            ranges = Stretches(h)
            starts = np.arange(len(h) - CORE + 1)
            keys = ranges.of(starts, starts + CORE)
            at = minimisers(keys, PASSAGE - CORE + 1)
            right = [ranges.of(at + CORE, at + CORE + s) for s in STRETCHES]
            left = [ranges.of(at - s, at) for s in STRETCHES]
            parts.append(pd.DataFrame({
                "core": keys[at].view(np.int64), "doc": np.full(len(at), doc, np.int64), "pos": at.astype(np.int32),
                "r1": packed(right[0], right[1]), "r2": packed(right[2], right[3]),
                "l1": packed(left[0], left[1]), "l2": packed(left[2], left[3])}))
            held += len(at)
            if held > FLUSH_ROWS:
                yield pd.concat(parts)
                held, parts = 0, []
    if parts:
        yield pd.concat(parts)


SUFFIX = "core bigint, doc bigint, pos int, r1 bigint, r2 bigint, l1 bigint, l2 bigint"
FOUND = "kind int, part int, core bigint, near bigint, doc bigint, pos int, other bigint, other_pos int"


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of neighbours with equal core and equal near stretch (kind 0); the first and last row (kinds 1 and 2)."""
    last = None
    columns = ["part", "core", "near", "doc", "pos"]
    for batch in batches:
        if not len(batch):
            continue
        rows = batch[columns]
        if last is None:
            yield rows.iloc[:1].assign(kind=1, other=0, other_pos=0)[FOUND_COLUMNS]
        else:
            rows = pd.concat([last, rows])
        a, b = rows.iloc[:-1].reset_index(drop=True), rows.iloc[1:].reset_index(drop=True)
        same = (a["core"].to_numpy() == b["core"].to_numpy()) & (a["near"].to_numpy() == b["near"].to_numpy())
        found = b[same].assign(kind=0, other=a["doc"][same], other_pos=a["pos"][same])
        yield found[FOUND_COLUMNS]
        last = rows.iloc[-1:]
    if last is not None:
        yield last.assign(kind=2, other=0, other_pos=0)[FOUND_COLUMNS]


FOUND_COLUMNS = [c.split()[0] for c in FOUND.split(", ")]


def _orders(suffixes: DataFrame) -> DataFrame:
    """Each suffix once per order: ``near`` stands for the words before and after that must agree, then the next stretches."""
    low = F.lit(0xFFFFFFFF)
    right = {0: F.lit(0), 8: F.shiftright("r1", 32), 16: F.col("r1").bitwiseAND(low),
             24: F.shiftright("r2", 32), 32: F.col("r2").bitwiseAND(low)}
    left = {0: F.lit(0), 8: F.shiftright("l1", 32), 16: F.col("l1").bitwiseAND(low),
            24: F.shiftright("l2", 32), 32: F.col("l2").bitwiseAND(low)}
    keys = [F.struct(
        F.xxhash64(F.lit(k), left[a], right[b]).alias("near"),
        F.xxhash64(left[min(a + 8, 32)], right[min(b + 8, 32)]).alias("then"),
        right[min(b + 8, 32)].cast("bigint").alias("more")) for k, (a, b) in enumerate(ORDERS)]
    return suffixes.select("core", "doc", "pos", F.inline(F.array(*keys)))


def _sorted_pairs(suffixes: DataFrame) -> DataFrame:
    """(doc, pos, other, other_pos) of neighbours in all orders."""
    order = ["core", "near", "more", "then", "doc", "pos"]
    ranged = _orders(suffixes).repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    found = cut(ranged.select(F.spark_partition_id().alias("part"), "core", "near", "doc", "pos")
                .mapInPandas(_neighbours, FOUND))
    seam = Window.orderBy("part", "kind")  # two rows per range partition
    ends = found.where("kind > 0").select("*", *[F.lag(c).over(seam).alias("_" + c) for c in ("kind", "core", "near", "doc", "pos")])
    across = ends.where("kind = 1 and _kind = 2 and core = _core and near = _near").select(
        "doc", "pos", F.col("_doc").alias("other"), F.col("_pos").alias("other_pos"))
    return found.where("kind = 0").select("doc", "pos", "other", "other_pos").unionByName(across)


def _extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans (doc, start, end) of stretches of PASSAGE words or more around the matches of two texts."""
    hasher = Hasher()
    for batch in batches:
        out = []
        for a, b, left, right, seeds in pandas_rows([batch], "a", "b", "text_a", "text_b", "seeds"):
            x, y = hasher.words(left), hasher.words(right)
            shifts: dict[int, list[int]] = {}
            for s in seeds:
                shifts.setdefault(s["other_pos"] - s["pos"], []).append(s["pos"])
            for shift, places in shifts.items():
                low, high = max(0, -shift), min(len(x), len(y) - shift)
                equal = np.concatenate([[False], x[low:high] == y[low + shift:high + shift], [False]])
                edges = np.flatnonzero(equal[1:] != equal[:-1]) + low
                runs = edges.reshape(-1, 2)
                runs = runs[runs[:, 1] - runs[:, 0] >= PASSAGE]
                for start, end in runs:
                    if any(start <= p < end for p in places):
                        out.append((a, int(start), int(end)))
                        out.append((b, int(start + shift), int(end + shift)))
        yield pd.DataFrame(out, columns=["doc", "start", "end"]).astype({"doc": "int64", "start": "int32", "end": "int32"})


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_repeated, spans) of the documents that hold a repeated passage; spans are word ranges."""
    rows = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text") >= 2 * PASSAGE - 1)
    keyed = cut(rows.select("doc_id", F.unhex(F.md5("text")).alias("key")).distinct())
    copies = cut(keyed.groupBy("key").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n_copies")))
    chosen = small_side(copies.select(F.col("doc").alias("_doc"), F.col("key").alias("_key")), BROADCAST_IDS)
    texts = rows.join(chosen, (F.col("doc_id") == F.col("_doc")) & (F.unhex(F.md5("text")) == F.col("_key")), "left_semi").select(
        F.col("doc_id").alias("doc"), "text")

    suffixes = cut(texts.mapInPandas(_suffixes, SUFFIX))
    cores = cut(suffixes.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"))
    shared = suffixes.join(small_side(cores, BROADCAST_CORES), "core", "left_semi")
    shared = cut(shared)
    turned = F.col("doc") < F.col("other")
    pairs = _sorted_pairs(shared).where("doc <> other or pos <> other_pos").select(
        F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b"),
        F.when(turned, F.col("pos")).otherwise(F.col("other_pos")).alias("pos"),
        F.when(turned, F.col("other_pos")).otherwise(F.col("pos")).alias("other_pos"))
    matches = cut(pairs.groupBy("a", "b").agg(F.collect_set(F.struct("pos", "other_pos")).alias("seeds")))
    needed = small_side(cut(matches.select(F.explode(F.array("a", "b")).alias("doc")).distinct()), BROADCAST_IDS)
    those = texts.join(needed, "doc", "left_semi").dropDuplicates(["doc"])
    left = matches.join(those.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(those.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    spans = both.mapInPandas(_extend, "doc bigint, start int, end int").groupBy("doc").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    whole = cut(copies.where("n_copies > 1"))
    lengths = texts.join(small_side(whole.select("doc"), BROADCAST_IDS), "doc", "left_semi").select("doc", words.alias("n"))
    lengths = lengths.where(F.col("n") >= PASSAGE).dropDuplicates(["doc"])
    whole_spans = lengths.select("doc", F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end"))).alias("spans"))
    merged = _merged(spans.unionByName(whole_spans).groupBy("doc").agg(
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans")))
    members = keyed.join(copies.select("key", "doc"), "key").select("doc_id", "doc")
    return members.join(merged, "doc").select("doc_id", "n_repeated", "spans")


def _merged(found: DataFrame) -> DataFrame:
    """Overlapping spans joined; the sorted list of a document is walked once."""
    span = "array<struct<start:int,end:int>>"
    first = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.array().cast(span).alias("done"))

    def step(acc, s):
        apart = s["start"] > acc["end"]
        closed = F.when(acc["end"] > 0, F.concat(acc["done"], F.array(F.struct(
            acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["done"])
        return F.struct(F.when(apart, s["start"]).otherwise(acc["start"]).alias("start"),
                        F.greatest(acc["end"], s["end"]).alias("end"),
                        F.when(apart, closed).otherwise(acc["done"]).alias("done"))

    joined = F.aggregate("spans", first, step, lambda acc: F.concat(
        acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))))
    return found.select("doc", joined.alias("spans")).withColumn("n_repeated", F.aggregate(
        "spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("bigint"))
