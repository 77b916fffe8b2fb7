"""SentencePiece encoding and decoding by streaming Viterbi.

A lattice over the characters keeps, for every position in a window as long as the longest piece, the best piece that
ends there and a pointer back.  When the pointer paths of all positions of the window meet in one boundary, the ids before
it are final and are given out, so memory does not grow with the text.

For a unigram vocabulary the best path has the largest sum of scores.  For a merge (BPE) vocabulary the scores are merge
ranks and their sum means nothing; there a path is admissible if each pair of neighbours is stable, that is if merging
their joined text gives the same two pieces, and exactly one admissible path leads to each position.  Both give the ids of
the public library.

No piece holds a space mark after another character, so paths always meet before a space; the ids of such a stretch
depend on the stretch alone.  Every distinct stretch goes through the lattice once and the ids of texts are joined from the stretches'
(the last ``MEMO_CHARS`` to twice as many characters of them are remembered; results do not depend on it).  The new stretches of
some texts go through in sorted order, so the lattice of each goes on from where its characters part from those of the one before.

Defined results: null gives null ids, empty text an empty list; characters outside the vocabulary become their bytes;
control pieces in a text are ordinary text; repeated rows give equal rows; other columns are kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MEMO = 400_000
MEMO_CHARS = 1_500_000
AT_ONCE = 512  # texts encoded together
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class PieceModel:
    """Vocabulary of a model file, given as bytes."""

    def __init__(self, proto: bytes, kind: str = "bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.kind, size = kind, sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(size)]
        odd = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        self._fill({p: (i, sp.get_score(i)) for i, p in enumerate(self.piece) if not odd[i]},
                   {int(p[3:5], 16): i for i, p in enumerate(self.piece) if sp.is_byte(i)}, sp.unk_id(),
                   {i for i in range(size) if sp.is_control(i)})

    @classmethod
    def of(cls, scores: dict[str, float], kind: str) -> PieceModel:
        """A model made from piece scores (for tests): ids in order, id 0 for anything unknown."""
        self = cls.__new__(cls)
        self.kind, self.piece = kind, ["<unk>", *scores]
        self._fill({p: (i + 1, s) for i, (p, s) in enumerate(scores.items())}, {}, 0, set())
        return self

    def _fill(self, vocabulary, byte_ids, unknown, control):
        self.vocabulary, self.byte_ids, self.unknown, self.control = vocabulary, byte_ids, unknown, control
        self.longest = max(map(len, vocabulary), default=1)
        self.letters = set("".join(vocabulary))
        self.forms = {p[k:]: False for p in vocabulary for k in range(len(p))} | dict.fromkeys(vocabulary, True)  # endings of pieces
        self.splits = not any(MARK in p.lstrip(MARK) for p in vocabulary)
        self.byte_value = {i: b for b, i in byte_ids.items()}
        self.high = {i for i, b in self.byte_value.items() if b > 127}
        self.shown = ["" if i in control else chr(self.byte_value[i]) if i in self.byte_value else p
                      for i, p in enumerate(self.piece)]
        self.worst = min((s for _, s in vocabulary.values()), default=0.0) - 10.0
        self.pairs: dict[tuple[str, str], bool] = {}
        self.own: dict[str, tuple[str, str] | None] = {}
        self.known: Stretches | None = None
        self.stretch = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if "\n" not in self.letters else f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def stretches(self) -> Stretches:
        """The table of stretches; when it holds ``MEMO_CHARS`` characters a new one begins, which looks words up in the last one."""
        if self.known is None:
            self.known = Stretches(self)
        elif self.known.chars > MEMO_CHARS:
            self.known.older = None
            self.known = Stretches(self, self.known)
        return self.known

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes a piece, found by merging its characters; None for one character."""
        known = self.own.get(piece, 0)
        if known == 0:
            parts, known = list(piece), None
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    entry = self.vocabulary.get(parts[i] + parts[i + 1])
                    if entry and (best is None or entry[1] > best):
                        best, at = entry[1], i
                if at < 0:
                    known = ("", "")
                    break
                known = parts[at], parts[at + 1]
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.own[piece] = known
        return known

    def is_stable(self, piece: str) -> bool:
        """Whether the characters of a piece merge to the piece."""
        return self.halves(piece) != ("", "")

    def are_neighbours(self, left: str, right: str) -> bool:
        """Whether no merge across the seam of two stable pieces comes before the merges that make them.

        The two pieces are taken apart at the seam, the later merge first; at each state a merge across the seam
        must rank behind the merge just undone.  Of equal ranks the left one is made first.
        """
        pair = left, right
        known = self.pairs.get(pair)
        if known is not None:
            return known
        if len(self.pairs) > MEMO:
            self.pairs.clear()
        vocabulary, limit, left_limit, ok = self.vocabulary, None, False, True
        while True:
            across = vocabulary.get(left + right)
            if across and (limit is None or across[1] > limit or (across[1] == limit and not left_limit)):
                ok = False
                break
            one, two = self.halves(left), self.halves(right)
            if one is None and two is None:
                break
            if two is None or (one is not None and vocabulary[left][1] < vocabulary[right][1]):
                limit, left_limit, left = vocabulary[left][1], True, one[1]
            else:
                limit, left_limit, right = vocabulary[right][1], False, two[0]
        self.pairs[pair] = ok
        return ok

    def ids_of(self, piece: str) -> list[int]:
        entry = self.vocabulary.get(piece)
        if entry:
            return [entry[0]]
        if self.byte_ids:
            return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]


def viterbi_stream(model: PieceModel, text: Iterable[str]) -> Iterator[list[str]]:
    """Pieces of the characters of ``text`` (given in blocks), given out as soon as all surviving paths agree on a boundary.

    ``tail`` holds the characters since the last agreed boundary, after the piece before it (``lead`` characters, given
    out already), which the next piece must fit.  ``last[p]`` is the last piece of the best path to ``p``, None without a path.
    """
    window, tail, lead = model.longest, "", 0
    last: list[str | None] = [""]
    scores = [0.0]

    def path(upto: int) -> list[int]:
        cuts = []
        while upto > 0:
            cuts.append(upto)
            upto -= len(last[upto])
        return cuts[::-1]

    def pieces(cuts: list[int]) -> list[str]:
        return [tail[a:b] for a, b in zip([0, *cuts], cuts, strict=False)][1 if lead else 0:]

    extend = _extend_stable if model.kind == "bpe" else _extend_scored
    tried = 0
    for block in text:
        for k in range(0, len(block), window):
            tail += block[k:k + window]
            extend(model, tail, last, scores)
            here = len(tail)
            if here < max(2 * window, tried + window):
                continue
            tried = here
            alive = [path(p) for p in range(here - window + 1, here + 1) if last[p]]
            agreed = 0
            for agreed, steps in enumerate(zip(*alive, strict=False)):
                if len(set(steps)) > 1:
                    break
            else:
                agreed = min(map(len, alive))
            cuts = alive[0][:agreed]
            if len(cuts) > (1 if lead else 0):
                yield pieces(cuts)
                start, end = cuts[-2] if len(cuts) > 1 else 0, cuts[-1]
                lead = end - start
                tail, tried = tail[start:], here - start
                last[:] = ["", *[None] * (lead - 1), last[end], *last[end + 1:]]
                del scores[:start]
    yield pieces(path(len(tail)))


def _extend_stable(model: PieceModel, tail: str, last: list[str | None], scores: list[float]) -> None:
    """Merge vocabulary: one admissible path leads to each position, so the longest stable piece that fits its neighbour is the one."""
    forms, pairs, window = model.forms.get, model.pairs, model.longest
    is_stable, are_neighbours = model.is_stable, model.are_neighbours
    for here in range(len(last), len(tail) + 1):
        starts = []
        for before in range(here - 2, max(here - window, 0) - 1, -1):
            whole = forms(tail[before:here])
            if whole is None:
                break
            if whole and last[before] is not None:
                starts.append(before)
        found = None
        for before in reversed(starts):
            left, piece = last[before], tail[before:here]
            known = pairs.get((left, piece)) if left else is_stable(piece)
            if known or (known is None and is_stable(piece) and are_neighbours(left, piece)):
                found = piece
                break
        else:
            left = last[here - 1]
            if left is not None and (not left or are_neighbours(left, tail[here - 1])):
                found = tail[here - 1]
        last.append(found)


def _extend_scored(model: PieceModel, tail: str, last: list[str | None], scores: list[float]) -> None:
    """Unigram vocabulary: the largest sum of scores, the shortest last piece of equals."""
    for here in range(len(last), len(tail) + 1):
        best, found = 0.0, None
        for length in range(1, min(model.longest, here) + 1):
            before = here - length
            piece = tail[before:here]
            if length > 1 and piece not in model.forms:
                break
            entry = model.vocabulary.get(piece)
            if (entry is None and length > 1) or last[before] is None:
                continue
            score = scores[before] + (entry[1] if entry else model.worst)
            if found is None or score > best:
                best, found = score, piece
        last.append(found)
        scores.append(best)


class Stretches(dict):
    """Codes of stretches; ``flat[starts[code]:starts[code + 1]]`` are the ids, found by the lattice when first asked for."""

    def __init__(self, model: PieceModel, older: Stretches | None = None):
        self.model, self.flat, self.starts, self.same, self.chars = model, array("i"), array("q", [0]), array("b"), 0
        self.older = older

    def __missing__(self, stretch: str) -> int:
        self.learn([stretch])
        return self[stretch]

    def learn(self, stretches: Iterable[str]) -> None:
        """Enter new stretches.  ``last`` is the lattice of the characters ``tail``; the next stretch keeps what belongs to their common start."""
        model, older, short = self.model, self.older, 2 * self.model.longest
        extend = _extend_stable if model.kind == "bpe" else _extend_scored
        vocabulary = model.vocabulary
        tail: str = ""
        last: list[str | None] = [""]
        scores = [0.0]
        for stretch in sorted(stretches):
            known = older.get(stretch) if older is not None else None
            if known is not None:
                ids, same = older.flat[older.starts[known]:older.starts[known + 1]], older.same[known]
            else:
                if len(stretch) < short:  # as long as the stream holds characters back
                    shared = 0
                    for a, b in zip(tail, stretch, strict=False):
                        if a != b:
                            break
                        shared += 1
                    del last[shared + 1:], scores[shared + 1:]
                    tail = stretch
                    extend(model, tail, last, scores)
                    pieces, at = [], len(tail)
                    while at:
                        pieces.append(last[at])
                        at -= len(last[at])
                    pieces.reverse()
                else:
                    pieces = [piece for some in viterbi_stream(model, (stretch,)) for piece in some]
                try:
                    ids, same = [vocabulary[piece][0] for piece in pieces], True  # whole pieces show as they are
                except KeyError:
                    ids = [i for piece in pieces for i in model.ids_of(piece)]
                    same = _shown(model, ids) == stretch
            self[stretch] = len(self.same)
            self.flat.extend(ids)
            self.same.append(same)
            self.starts.append(len(self.flat))
            self.chars += len(stretch)


def _parts(model: PieceModel, text: str) -> list[str]:
    marked = MARK + text.replace(" ", MARK)
    return model.stretch.findall(marked) if model.splits else [marked]


def encode(model: PieceModel, text: str | None) -> list[int] | None:
    if text is None:
        return None
    if not text:
        return []
    table = model.stretches()
    codes = [table[p] for p in _parts(model, text)]
    return [i for c in codes for i in table.flat[table.starts[c]:table.starts[c + 1]]]


def encode_batch(model: PieceModel, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bool | None]]:
    """(ids of all texts, number of ids of each, whether decoding gives the text again); every distinct stretch is encoded and decoded once.

    Texts are joined from stretches: where all of a text's stretches come back, the text does, unless it holds the space mark itself.
    """
    table = model.stretches()
    parts = [_parts(model, text) if text else [] for text in texts]
    table.learn(set().union(*parts).difference(table))
    sizes = list(map(len, parts))
    at = np.fromiter(map(table.__getitem__, chain.from_iterable(parts)), np.int64, sum(sizes))
    flat, starts = np.array(table.flat, np.int32), np.array(table.starts)
    lengths = starts[at + 1] - starts[at]
    ends = np.cumsum(lengths)
    ids = flat[np.repeat(starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.diff(np.concatenate([[0], ends])[cuts])
    lost = np.concatenate([[0], np.cumsum(~np.array(table.same, bool)[at])])[cuts]
    last, back = 0, []
    for text, n, n_lost in zip(texts, counts.tolist(), np.diff(lost).tolist(), strict=True):
        if text is None:
            back.append(None)
        elif n_lost:
            back.append(decode(model, ids[last:last + n].tolist()) == text)
        else:
            back.append(MARK not in text)
        last += n
    return ids, counts, back


def decode(model: PieceModel, ids: list[int] | None) -> str | None:
    """The text of ids; a wrong byte sequence becomes U+FFFD, control pieces vanish."""
    if ids is None:
        return None
    text = _shown(model, ids).replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def _shown(model: PieceModel, ids: list[int]) -> str:
    """The characters of ids, space marks included."""
    if model.high.isdisjoint(ids):
        return "".join(map(model.shown.__getitem__, ids))
    out, raw = [], bytearray()
    for i in ids:
        if i in model.byte_value:
            raw.append(model.byte_value[i])
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
        out.append(model.shown[i])
    out.append(raw.decode("utf-8", "replace"))
    return "".join(out)


@lru_cache(maxsize=1)
def _model(proto: bytes, kind: str) -> PieceModel:
    """One model for all tasks of a worker."""
    return PieceModel(proto, kind)


def _rows(proto: bytes, kind: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(proto, kind)
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                ids, counts, back = encode_batch(model, batch.column("text").to_pylist())
                gone = batch.column("text").is_null()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()), mask=gone)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), lists, pa.array(counts, pa.int64(), mask=gone.to_numpy(False)), pa.array(back, pa.bool_())],
                    ["doc_id", "ids", "n_ids", "round_trip"])

    return rows


def encode_documents(docs: DataFrame, model_path: str = DEFAULT_MODEL, kind: str = "bpe") -> DataFrame:
    """(doc_id, ids, n_ids, round_trip): ids of the text, and whether decoding gives the text again.

    The model file (half a megabyte, its size fixed by the vocabulary) is read once by the driver and sent with the task.
    """
    with open(model_path, "rb") as f:
        proto = f.read()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _rows(proto, kind), "doc_id bigint, ids array<int>, n_ids bigint, round_trip boolean")
