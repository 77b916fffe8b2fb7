"""Benchmark decontamination by template windows.

Words are canonicalised: punctuation at the ends goes, letters become lower case, numbers become <num>, a unit after a
number <unit>, a capitalised word inside a sentence <name>.  Windows of template tokens of the benchmark and of the
documents are hash-joined; the replaced words of a joined window are its slots.  A document holds an item if the joined
windows cover enough of it and the slots are consistent: one benchmark value always meets the same document value.
So a question with other numbers or names is caught, while texts that share only a frame are not.  The windows of the plain
lower-case words are joined as well, so that a copy in other case is found whatever stands as a name in it.

Defined results: null and empty texts hold nothing; shorter items than a window are matched as a whole, those under
``MIN_WINDOW`` tokens by their plain words only; repeated rows of one id count once; null ids form one group of their own; extra columns
stay unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenspark.llm.common import small_side
from greenspark.operators.lineage import cut

WINDOW, MIN_WINDOW, MIN_COVERED = 8, 4, 13
BROADCAST_WINDOWS = 2_000_000
FILTER_BITS = 22
MEMO_WORDS = 1 << 18
NAME, CAPITAL, NUMBER, UNIT, ENDS, EMPTY = 1, 2, 4, 8, 16, 32

# Words that are units after a number.
UNITS = frozenset("""mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer
kilometers kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml
cl l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week
weeks month months year years kmh mph hz khz mhz ghz w kw mw v a j kj cal kcal pa kpa k c f degrees percent dollar dollars
euro euros cent cents usd eur gbp""".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?$")
_WORD = np.uint64(0x9E3779B97F4A7C15)
_SLOT = {k: np.uint64(xxhash.xxh64_intdigest(k)) for k in ("<num>", "<unit>", "<name>")}
_MULT = np.random.default_rng(77).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Templates:
    """Template hashes and words of a text; remembers words."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.memo = {}
        self._h, self._f = np.zeros(1024, np.uint64), np.zeros(1024, np.int64)

    def _learn(self, word: str) -> None:
        core = word.strip("\"'`()[]{}<>|*#$%&!?.,;:-_=+~/\\“”‘’«»…–—") or ""
        flags = EMPTY if not core else 0
        if core:
            if _NUMBER.match(core):
                flags |= NUMBER
            elif core[0].isupper() and not core.isupper():
                flags |= CAPITAL
            if core.lower() in UNITS:
                flags |= UNIT
        if word.rstrip("\"')]”’*#$%&|!")[-1:] in (".", "!", "?", ":") or word[-1:] in "!?":
            flags |= ENDS
        at = self.memo[word] = len(self.memo)
        if at == len(self._h):
            self._h, self._f = np.concatenate([self._h, np.zeros_like(self._h)]), np.concatenate([self._f, np.zeros_like(self._f)])
        self._h[at] = xxhash.xxh64_intdigest(core.lower())
        self._f[at] = flags

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(plain hashes, template hashes, whether each is a slot, words)."""
        words = text.split() if text else []
        if len(self.memo) > MEMO_WORDS:
            self.clear()
        for w in set(words).difference(self.memo):
            self._learn(w)
        at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        if not len(at):
            return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool), []
        h, f = self._h[at], self._f[at]
        ended = np.concatenate([[True], (f[:-1] & ENDS) > 0])
        keep = (f & EMPTY) == 0
        if not keep.all():
            carried = np.maximum.accumulate(np.where(keep, np.arange(len(f)), -1))
            before = np.concatenate([[-1], carried[:-1]])
            ended |= (before < 0)
            h, f, ended = h[keep], f[keep], ended[keep]
            words = [w for w, k in zip(words, keep, strict=True) if k]
        number = (f & NUMBER) > 0
        unit = ((f & UNIT) > 0) & np.concatenate([[False], number[:-1]]) if len(f) else number
        name = ((f & CAPITAL) > 0) & ~ended
        plain = h
        h = np.where(number, _SLOT["<num>"], np.where(unit, _SLOT["<unit>"], np.where(name, _SLOT["<name>"], h)))
        return plain, h, number | unit | name, words


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    last = len(h) - size + 1
    if last < 1:
        return np.empty(0, np.uint64)
    out = np.full(last, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k:k + last]) * _MULT[k]
        out ^= out >> np.uint64(31)
    return out


def _slots(words: list[str], slot: np.ndarray, at: int, size: int) -> list[str]:
    return [words[i].strip(".,;:!?\"'()").lower() for i in range(at, at + size) if slot[i]]


def _windows(id_column: str, sizes: tuple[int, ...], seen: np.ndarray | None):
    """(id, key, pos, size, n_tokens, slots) of the windows; with ``seen``, of those that may be in the benchmark.

    Each window of plain words, without slots, and each template window that has a slot.  A text holds a whole short item once.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates()
        for batch in batches:
            out = []
            for ident, text in zip(batch[id_column].astype(object), batch["text"], strict=True):
                plain, h, slot, words = templates.read(text)
                before = np.concatenate([[0], np.cumsum(slot)])
                for size in sizes if seen is not None else (min(WINDOW, len(h)),) if len(h) else ():
                    kinds = [(window_hashes(plain, size), False)]
                    if size >= MIN_WINDOW and before[-1]:
                        kinds.append((window_hashes(h, size), True))
                    for keys, slotted in kinds:
                        some = seen[keys >> np.uint64(64 - FILTER_BITS)] if seen is not None else np.ones(len(keys), bool)
                        if slotted:
                            some &= before[size:] > before[:-size]
                        at = np.flatnonzero(some)
                        if size < MIN_WINDOW and len(at):
                            at = at[np.unique(keys[at], return_index=True)[1]]
                        for i in at:
                            out.append((None if pd.isna(ident) else int(ident), int(keys[i].astype(np.int64)), int(i), size, len(h),
                                        _slots(words, slot, i, size) if slotted else []))
            made = pd.DataFrame(out, columns=["id", "key", "pos", "size", "n_tokens", "slots"])
            made["id"] = made["id"].astype("Int64")
            yield made

    return rows


SCHEMA = "id bigint, key bigint, pos int, size int, n_tokens int, slots array<string>"


def leaks(docs: DataFrame, benchmark: DataFrame, min_covered: int = MIN_COVERED) -> DataFrame:
    """(doc_id, item_id, n_covered, n_tokens, n_slots, reparameterised): the benchmark items that documents hold.

    An item counts as held if min(``min_covered``, all but the first, whose case may differ) of its tokens lie in joined windows on one diagonal, at least half of
    them plain words or that many in windows with equal slots, and at most a tenth of its slot values meet more than one document value.
    """
    items = cut(benchmark.select(F.col("item_id").cast("bigint").alias("id"), "text").mapInPandas(
        _windows("id", (WINDOW,), None), SCHEMA))
    sizes = tuple(sorted(r["size"] for r in items.select("size").distinct().collect()))
    seen = np.zeros(1 << FILTER_BITS, bool)
    cells = items.select(F.shiftrightunsigned("key", 64 - FILTER_BITS).alias("cell")).distinct().toPandas()
    seen[cells["cell"].to_numpy(np.int64)] = True
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumnRenamed("doc_id", "id").mapInPandas(
        _windows("id", sizes, seen), SCHEMA)
    b = items.select(F.col("id").alias("item_id"), "key", "size", F.col("pos").alias("at"), "n_tokens",
                     F.col("slots").alias("values"))
    joined = found.drop("n_tokens").join(small_side(b, BROADCAST_WINDOWS), ["key", "size"])
    joined = joined.where(F.size("slots") == F.size("values")).withColumn("shift", F.col("pos") - F.col("at"))
    by_diagonal = joined.groupBy("id", "item_id", "n_tokens", "shift", "size").agg(
        F.collect_set("at").alias("places"), F.collect_set(F.when(F.col("slots") == F.col("values"), F.col("at"))).alias("equal"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("values", "slots")))).alias("pairs"))

    def cover(places: str) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + F.col("size") - 1)))))

    counted = by_diagonal.select(
        "id", "item_id", "n_tokens", "size", cover("places").alias("n_covered"), cover("equal").alias("n_equal"), F.size("pairs").alias("n_slots"),
        F.size(F.array_distinct(F.transform("pairs", lambda p: p["values"]))).alias("n_values"),
        F.exists("pairs", lambda p: p["values"] != p["slots"]).alias("reparameterised"))
    asked = F.least(F.lit(min_covered), F.greatest(F.col("n_tokens") - 1, F.col("size")))
    held = counted.where(
        (F.col("n_covered") >= asked)
        & ((F.col("n_slots") * 2 <= F.col("n_covered")) | (F.col("n_equal") >= asked))
        & ((F.col("n_slots") - F.col("n_values")) * 10 <= F.col("n_values")))
    best = held.groupBy("id", "item_id").agg(F.max(F.struct("n_covered", "n_tokens", "n_slots", "reparameterised")).alias("m"))
    return best.select(F.col("id").alias("doc_id"), "item_id", *[
        F.col("m")[c].alias(c) for c in ("n_covered", "n_tokens", "n_slots", "reparameterised")])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows without an id stay."""
    held = cut(leaks(docs, benchmark).where("doc_id is not null").select("doc_id").distinct())
    return docs.join(small_side(held.select(F.col("doc_id").alias("_held")), BROADCAST_WINDOWS),
                     F.col("doc_id") == F.col("_held"), "left_anti")
