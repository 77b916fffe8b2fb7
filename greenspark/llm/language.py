"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is parsed greedily into the longest stretches that
stand in that language's labelled text; the language in which the text takes the fewest bits wins.  A phrase takes the logarithm
of the size of that language's sample (where it stands there) and ``LENGTH_BITS`` (how long it is), so that languages with more
and with less labelled text compare; a letter that the sample of the language lacks takes ``LETTER_BITS``.  The parse walks the
automaton from its root, one letter at a time; where it has no way on, a phrase ends and the next starts with that letter.

Texts are reduced to lower-case letters and single separators and parsed in blocks of ``BLOCK`` symbols (a phrase does not
cross blocks), so that many blocks walk all automata in step as numpy arrays.  The whole text counts.

Training text is bounded: per language at most ``TRAIN_DOCS`` documents (those of smallest hash) and ``TRAIN_SYMBOLS``
symbols of each, so the automata have a fixed size however large the corpus is.  Texts under ``SHORT`` characters come in,
up to ``TRAIN_SHORT`` of them, where a language has fewer than ``TRAIN_DOCS`` longer ones.  Every letter of the sample counts: the
``DENSE`` most frequent ones of a language have a table of transitions, the others a sorted list.

Defined results: a null text, an empty one or one without a letter is ``und`` with score 0; ties go to the first language
in alphabetical order; rows without a label or an id in the training share teach nothing; rows of one id and label teach one text, so the
sample stays bounded; a language whose labelled texts have no letter is not learned; repeated rows get equal results;
without any labelled row all texts are ``und``; extra columns stay unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from greenspark.llm.common import small_side
from greenspark.operators.lineage import cut

BLOCK = 256
TRAIN_DOCS, TRAIN_SYMBOLS = 48, 1200
SHORT, TRAIN_SHORT = 200, 2400
DENSE = 94
LENGTH_BITS, LETTER_BITS = 2, 21
STEP_BLOCKS = 16_384
UNKNOWN, SEPARATOR = 1, 0


class Alphabet:
    """Symbols of code points: 0 separator, 1 any letter not seen in training, 2.. the letters seen."""

    def __init__(self, texts: list[str]):
        kept = sorted({c for t in texts for c in t.lower() if c.isalpha()})
        self.size = len(kept) + 2
        self.kind = np.uint16 if self.size < 0xFFFF else np.uint32
        self.table = np.zeros(0x110000, self.kind)
        for c in map(chr, range(0x110000)):
            if c.isalpha():
                self.table[ord(c)] = UNKNOWN
        for k, c in enumerate(kept):
            self.table[ord(c)] = k + 2

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text, separators joined and none at its ends."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.table[codes]
        keep = s != SEPARATOR
        keep[1:] |= s[:-1] != SEPARATOR
        s = s[keep]
        return s[:-1] if len(s) and s[-1] == SEPARATOR else s


def _ways(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all factors of ``symbols``; state 1 is the root."""
    moves, link, length, last = [{}, {}], [0, 0], [0, 0], 1
    for c in symbols.tolist():
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[state] = copy
                while p and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
        last = state
    return moves


def suffix_automaton(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """Transitions (states x alphabet, 0 for none) of the automaton of all factors of ``symbols``; state 1 is the root."""
    return _dense(_ways(symbols), alphabet)


def _dense(moves: list[dict[int, int]], alphabet: int) -> np.ndarray:
    """Transitions by the symbols under ``alphabet``."""
    table = np.zeros((len(moves), alphabet), np.int32)
    for state, ways in enumerate(moves):
        for c, to in ways.items():
            if c < alphabet:
                table[state, c] = to
    table[:, UNKNOWN] = 0
    return table


class Automaton:
    """Automaton of one language over its own letters, numbered from the most frequent on."""

    def __init__(self, symbols: np.ndarray, alphabet: Alphabet):
        seen, counts = np.unique(symbols[symbols > UNKNOWN], return_counts=True)
        self.local = np.full(alphabet.size, UNKNOWN, alphabet.kind)
        self.local[SEPARATOR] = SEPARATOR
        self.local[seen[np.argsort(-counts, kind="stable")]] = np.arange(len(seen)) + 2
        self.size, self.width = len(seen) + 2, min(len(seen), DENSE) + 2
        moves = _ways(self.local[symbols])
        self.table = _dense(moves, self.width).ravel()
        rare = sorted((state * self.size + c, to) for state, ways in enumerate(moves) for c, to in ways.items() if c >= self.width)
        self.keys, self.targets = np.array(rare, np.int64).reshape(-1, 2).T.copy()
        self.bits = float(np.log2(len(symbols))) + LENGTH_BITS

    def moved(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next states, 0 for none; ``state`` counts in rows of the table."""
        if self.size == self.width:
            return self.table[state + c]
        to = self.table[state + np.where(c < self.width, c, UNKNOWN)]
        rare = np.flatnonzero(c >= self.width)
        if len(rare):
            key = state[rare].astype(np.int64) // self.width * self.size + c[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            to[rare] = np.where(self.keys[at] == key, self.targets[at], 0)
        return to


class Parser:
    """Phrase counts of blocks against the automata of all languages."""

    def __init__(self, samples: dict[str, list[str]]):
        self.alphabet = Alphabet([t for texts in samples.values() for t in texts])
        symbols = {k: [self.alphabet.symbols(t) for t in texts] for k, texts in samples.items()}
        joined = {k: np.concatenate([np.append(s, SEPARATOR) for s in some]).astype(self.alphabet.kind)
                  for k, some in symbols.items() if any(len(s) for s in some)}
        self.languages = sorted(joined)
        self.automata = [Automaton(joined[k], self.alphabet) for k in self.languages]

    def phrases(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) number of phrases, letters that are phrases of their own included, and number of bits."""
        none, lengths = np.iinfo(self.alphabet.kind).max, np.array([len(t) for t in texts], np.int64)
        n_blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        out, letters = np.zeros((2, len(texts), len(self.automata)), np.int64)
        padded = [np.pad(t, (0, int(b) * BLOCK - len(t)), constant_values=none).reshape(-1, BLOCK)
                  for t, b in zip(texts, n_blocks, strict=True) if b]
        if not padded:
            return out, out.astype(float)
        blocks = np.concatenate(padded)
        for at in range(0, len(blocks), STEP_BLOCKS):
            part = blocks[at:at + STEP_BLOCKS]
            used = (part != none).sum(axis=1)
            order = np.argsort(-used, kind="stable")
            part, used = np.ascontiguousarray(part[order].T), used[order]
            active = len(order) - np.searchsorted(used[::-1], np.arange(1, BLOCK + 1))
            for k, automaton in enumerate(self.automata):
                root = automaton.width
                state = np.full(len(order), root, np.int32)
                count, alone = np.zeros((2, len(order)), np.int32)
                for step in range(BLOCK):
                    n = active[step]
                    if not n:
                        break
                    c = automaton.local[part[step, :n]]
                    to = automaton.moved(state[:n], c)
                    dead = np.flatnonzero(to == 0)
                    if len(dead):
                        fresh = automaton.moved(np.full(len(dead), root, np.int32), c[dead])
                        count[dead] += state[dead] != root
                        # a letter that no labelled text has is a phrase of its own, and the next starts at the root
                        to[dead] = np.where(fresh == 0, 1, fresh)
                        alone[dead[fresh == 0]] += 1
                    state[:n] = to * automaton.width
                mine = owner[at:at + STEP_BLOCKS][order]
                np.add.at(out[:, k], mine, count + (state != root))
                np.add.at(letters[:, k], mine, alone)
        return out + letters, out * np.array([a.bits for a in self.automata]) + letters * float(LETTER_BITS)


def sample(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_symbols: int = TRAIN_SYMBOLS) -> DataFrame:
    """(lang, text): the bounded training sample of ``docs(doc_id, text, lang)``."""
    ids = docs.where("lang is not null and text is not null and length(text) > 0").select(
        "lang", "doc_id", F.xxhash64("doc_id").alias("_h"), (F.length("text") < SHORT).alias("_short"))

    def least(some: DataFrame, n: int) -> DataFrame:
        ranked = some.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id")))
        return cut(ranked.where(F.col("_k") <= n).select("lang", F.col("doc_id").alias("_id")))

    long = least(ids.where("not _short"), train_docs)
    full = small_side(cut(long.groupBy("lang").count().where(F.col("count") >= train_docs).select("lang")), 1_000_000)
    short = least(ids.where("_short").join(full, "lang", "left_anti"), TRAIN_SHORT)
    few = cut(long.unionByName(short).select("_id").distinct())
    return docs.where("lang is not null and text is not null").join(
        small_side(few, 1_000_000), F.col("doc_id") == F.col("_id"), "left_semi").groupBy("lang", "doc_id").agg(
        F.min(F.substring("text", 1, train_symbols)).alias("text")).select("lang", "text")


def _predict(samples: dict[str, list[str]]):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser(samples)
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.iloc[at:at + 4096]
                texts = [parser.alphabet.symbols(t) if isinstance(t, str) and t else np.empty(0, parser.alphabet.kind) for t in batch["text"]]
                counts, bits = parser.phrases(texts)
                made = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64")})
                made["held_out"] = batch["held_out"].to_numpy()
                some = np.array([len(t) > 0 for t in texts]) if parser.languages else np.zeros(len(texts), bool)
                best = bits.argmin(axis=1) if parser.languages else np.zeros(len(texts), int)
                names = np.array([*parser.languages, "und"], object)
                made["lang_pred"] = np.where(some, names[best], "und")
                lengths = np.array([max(len(t), 1) for t in texts])
                needed = counts[np.arange(len(texts)), best] if parser.languages else 0
                made["score"] = np.where(some, np.clip(1 - needed / lengths, 0, 1), 0.0)
                yield made

    return rows


def identify(docs: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of ``docs(doc_id, text, held_out)``; score is 1 - phrases per symbol."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "held_out").mapInPandas(
        _predict(samples), "doc_id bigint, held_out boolean, lang_pred string, score double")


def language_digest(docs: DataFrame) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(-1))
    marked = docs.select("doc_id", "text", "lang", (fold == 1).alias("held_out"))
    rows = sample(marked.where("not held_out and doc_id is not null")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return identify(marked, samples)
