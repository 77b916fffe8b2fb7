"""Periodic runs of words by a suffix automaton with link-cut access.

The suffix automaton of a stretch of words has a tree of suffix links; the states above the state of a prefix are the
suffixes of that prefix.  A link-cut tree keeps, for every state, the end of its last occurrence: appending word i is an
access to the state of the prefix ending at i, which recolours the whole path to the root with i.  The path falls into
segments of one colour.  A segment whose longest suffix has ``reach`` words and last ended at p gives a distance
d = i - p; if d <= reach, the last d words stand twice in a row (a square), and the stretch of period d that ends at i
begins exactly reach words before p.  It is reported where the next word breaks the period, so every run comes out once,
with its smallest period: a smaller one would have left a later end in the segment.

Only words that can stand in a run enter the automaton: a run of at least 12 words and twice its period q holds each of
its words inside six words that occur again q words on, in the same run.  Words that are in no such repeated six
are split off until nothing changes.  The rest are whole stretches, never pieces of a run.

Defined results: a null, empty or blank text has no words, no run, and the SHA-256 of the empty string twice; a null id
rearranges nothing in ``runs_digest``; repeated rows give equal rows; ties for the longest run go to the smallest start,
then the smallest period; other columns stay unread.  Memory grows with the longest text (under 1 kB for each word of its
longest stretch), never with the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from greenspark.llm.common import pandas_rows, words_bytes

LEAST_WORDS = 12
HALF = LEAST_WORDS // 2

_ODD = np.random.default_rng(20250312).integers(0, 1 << 63, HALF, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class SuffixAutomaton:
    """States, suffix links and lengths of all substrings of ``word_ids``; ``ends[i]`` is the state of the prefix ending at i.

    State 0 stands for "none", state 1 for the empty string.
    """

    def __init__(self, word_ids: list[int]):
        self.length, self.link, self.ends = [0, 0], [0, 0], []
        moves: list[dict[int, int]] = [{}, {}]
        length, link, ends = self.length, self.link, self.ends
        last = 1
        for word in word_ids:
            new = len(length)
            length.append(length[last] + 1)
            moves.append({})
            link.append(1)
            at = last
            while at and word not in moves[at]:
                moves[at][word] = new
                at = link[at]
            if at:
                target = moves[at][word]
                if length[target] == length[at] + 1:
                    link[new] = target
                else:
                    copy = len(length)
                    length.append(length[at] + 1)
                    moves.append(moves[target].copy())
                    link.append(link[target])
                    link[target] = link[new] = copy
                    while at and moves[at].get(word) == target:
                        moves[at][word] = copy
                        at = link[at]
            last = new
            ends.append(new)


class LastEnds:
    """Link-cut tree over the suffix links whose preferred paths carry the end of their last occurrence.

    Every preferred path is a splay tree ordered by depth; its root holds the colour of the path.
    """

    def __init__(self, link: list[int]):
        size = len(link)
        self.up = link.copy()  # parent in the splay tree, or the path above
        self.left, self.right, self.colour = [0] * size, [0] * size, [-1] * size

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        if left[p] != x and right[p] != x:
            return
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            below = g and (left[g] == p or right[g] == p)
            if not below:
                self.colour[x] = self.colour[p]  # p was the root of the path
            elif (left[g] == p) == (left[p] == x):  # zig-zig: turn the parent first
                gg = up[g]
                if not (gg and (left[gg] == g or right[gg] == g)):
                    self.colour[x] = self.colour[g]
                if left[g] == p:
                    b = right[p]
                    left[g], right[p] = b, g
                else:
                    b = left[p]
                    right[g], left[p] = b, g
                if b:
                    up[b] = g
                up[g] = p
                up[p] = gg
                if gg:
                    if left[gg] == g:
                        left[gg] = p
                    elif right[gg] == g:
                        right[gg] = p
                g = gg
            if left[p] == x:
                b = right[x]
                left[p], right[x] = b, p
            else:
                b = left[x]
                right[p], left[x] = b, p
            if b:
                up[b] = p
            up[p] = x
            up[x] = g
            if g:
                if left[g] == p:
                    left[g] = x
                elif right[g] == p:
                    right[g] = x
            p = g

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """(deepest state, last end) of each coloured segment above ``state``; then all of the path gets colour ``end``."""
        up, right, colour = self.up, self.right, self.colour
        found = []
        x, lower = state, 0
        while x:
            self._splay(x)
            c = colour[x]
            if c >= 0:
                found.append((x, c))
            deeper = right[x]
            if deeper:
                colour[deeper] = c  # its own path from now on
            right[x] = lower
            lower, x = x, up[x]
        self._splay(state)
        colour[state] = end
        return found


def stretch_runs(word_ids: list[int], least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words, by start and period."""
    automaton = SuffixAutomaton(word_ids)
    tree, length, ends = LastEnds(automaton.link), automaton.length, automaton.ends
    n, out = len(word_ids), []
    for i in range(n):
        following = word_ids[i + 1] if i + 1 < n else None
        for state, before in tree.access(ends[i], i):
            period, reach = i - before, length[state]
            if period <= reach and reach + period >= least and (following is None or following != word_ids[before + 1]):
                out.append((before - reach + 1, reach + period, period))
    return sorted(out, key=lambda run: (run[0], run[2]))


def _repeated_stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the stretches that can hold a run; together they hold all runs of at least ``LEAST_WORDS`` words."""
    open_, done = [(0, len(ids))], []
    while open_:
        start, end = open_.pop()
        n = end - start
        if n < LEAST_WORDS:
            continue
        part = ids[start:end]
        grams = np.zeros(n - HALF + 1, np.uint64)
        for k in range(HALF):
            grams = (grams ^ part[k:n - HALF + 1 + k]) * _ODD[k]
            grams ^= grams >> np.uint64(31)
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        if not same.any():
            continue
        again = np.zeros(len(grams), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        edge = np.zeros(n + 1, np.int32)
        at = np.flatnonzero(again)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + HALF, -1)
        covered = np.concatenate([[False], np.cumsum(edge[:n]) > 0, [False]])
        turns = np.flatnonzero(covered[1:] != covered[:-1])
        parts = list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))
        if parts == [(0, n)]:
            done.append((start, end))
        else:
            open_ += [(start + a, start + b) for a, b in parts]
    return sorted(done)


class RunFinder:
    """Runs of texts given as lists of words; remembers numbers of words."""

    MEMO_WORDS = 1 << 18

    def __init__(self):
        self.numbers: dict[bytes, int] = {}

    def runs(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        if len(words) < LEAST_WORDS:
            return []
        numbers = self.numbers
        if len(numbers) > self.MEMO_WORDS:
            numbers.clear()
        for w in set(words).difference(numbers):
            numbers[w] = len(numbers)
        ids = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
        found = []
        for start, end in _repeated_stretches(ids):
            found += [(start + s, length, period) for s, length, period in stretch_runs(ids[start:end].tolist())]
        return found


def rearranged(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the contract: those of one id in ten are periodic from a place of their own on."""
    n = len(words)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    repeats = -(-(n - a) // p)
    return words[:a] + (words[a:a + p] * repeats)[:n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(edge).tolist(), strict=False) if not gone]


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, text) of ``docs(doc_id, text)``: runs collapsed to their first period, words joined by one blank."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = RunFinder()
        for batch in batches:
            out = []
            for doc_id, text in pandas_rows([batch], "doc_id", "text"):
                words = words_bytes(text)
                runs = finder.runs(words)
                out.append((doc_id, len(runs), b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["doc_id", "n_runs", "text"])

    return docs.selectExpr("cast(doc_id as string) as doc_id", "text").mapInPandas(
        rows, "doc_id string, n_runs bigint, text string").selectExpr("cast(doc_id as bigint) as doc_id", "n_runs", "text")


_DIGEST = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
           "runs_sha256 string, collapsed_sha256 string")


def runs_digest(docs: DataFrame) -> DataFrame:
    """Runs of the rearranged words of ``docs(doc_id, text)``: their number, the longest, and digests of all."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = RunFinder()
        for batch in batches:
            out = []
            for key, text in pandas_rows([batch], "doc_id", "text"):
                doc_id = None if key is None else int(key)
                words = rearranged(words_bytes(text), doc_id)
                runs = finder.runs(words)
                best: tuple = (None,) * 4
                if runs:
                    start, length, period = min(runs, key=lambda run: (-run[1], run[0], run[2]))
                    best = (start, length, period, 1000 * length // period)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                out.append((doc_id, len(runs), *best, sha256(listed.encode()).hexdigest(),
                            sha256(b" ".join(collapsed(words, runs))).hexdigest()))
            made = pd.DataFrame(out, columns=[c.split()[0] for c in _DIGEST.split(", ")], dtype=object)
            yield made.astype({c: "Int64" for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")})

    return docs.selectExpr("cast(doc_id as string) as doc_id", "text").mapInPandas(rows, _DIGEST)
