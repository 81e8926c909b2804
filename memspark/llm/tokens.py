"""Byte-level BPE over a whole corpus, with vectorised pre-tokenisation.

The texts of a batch become one array of code points and one of classes
(letter, number, white space, other). What a piece can begin with depends on
the classes around it and on where the run of its class began and ends: the
transition functions of the splitting automaton are constant on a run, so
their composition is a running maximum (an associative scan), and all borders
come from array operations, with no regular expression. The slices between
borders are looked up in a cache; only pieces not met before are merged.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memspark.tables import spread

#: Where the public vocabulary lies; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces a worker remembers before it forgets all.
MOST_CACHED = 400_000
OTHER, LETTER, NUMBER, SPACE = range(4)
#: The code points with the property White_Space.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings split off after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        made = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        made[WHITE_SPACE] = SPACE
        _classes = made
    return _classes


def borders(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin, ascending: points are code points of texts laid end to end, first the places where a text that isn't empty begins."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    kind = classes()[points]
    opens = np.zeros(n + 1, bool)
    opens[first] = opens[n] = True
    ends_text = opens[1:]  # the last code point of its text
    run = opens[:n] | np.r_[True, kind[1:] != kind[:-1]]
    ends_run = np.r_[run[1:], True]
    run_start = np.maximum.accumulate(np.where(run, at, 0))
    space = kind == SPACE
    # a run of spaces goes whole at the end of a text; else its last one stands apart, a blank leading the next piece
    last = space & ends_run & ~ends_text
    begins = run.copy()
    begins[last] = True
    led = np.zeros(n, bool)
    led[1:] = last[:-1] & (points[:-1] == 0x20)
    begins[led] = False
    # an apostrophe alone, not led by a blank, takes an ending from the letters after it
    alone = np.flatnonzero((points == 0x27) & begins & ends_run & (run_start == at) & ~ends_text)
    if len(alone):
        padded = np.r_[points, 0, 0]
        text_end = np.r_[np.flatnonzero(opens[1:]) + 1]
        limit = text_end[np.searchsorted(text_end, alone, side="right")]
        size = np.zeros(len(alone), np.int64)
        for e in ENDINGS:
            fits = (size == 0) & (alone + len(e) < limit)
            for i, ch in enumerate(e, 1):
                fits &= padded[alone + i] == ord(ch)
            size[fits] = 1 + len(e)
        taken, size = alone[size > 0], size[size > 0]
        begins[taken + 1] = False
        after = taken + size
        begins[after[after < n]] = True
    return np.flatnonzero(begins)


class Bpe:
    """The vocabulary, the merges and the pieces met so far."""

    def __init__(self, ranks_file: bytes):
        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks_file.splitlines())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.lengths = np.array([len(t) for t in self.tokens], np.int32)
        self._forget()

    def _forget(self) -> None:
        bpe = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> int:
                ids = bpe.merge(piece.encode())
                bpe.flat.extend(ids)
                bpe.ends.append(len(bpe.flat))
                self[piece] = k = len(bpe.ends) - 2
                return k

        self.pieces, self.flat, self.ends = Pieces(), [], [0]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: of all neighbours the pair of least rank merges first, of equal ones the leftmost."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        part: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has merged since
            part[i], part[j] = part[i] + part[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.ranks.get(both := part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(both)))
            if (h := before[i]) >= 0 and (r := self.ranks.get(both := part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(both)))
        return [self.ranks[p] for p in part if p is not None]

    def _looked_up(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """For every piece of the texts its place among those met; how many pieces each text has."""
        if len(self.pieces) > MOST_CACHED:
            self._forget()
        whole = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.r_[0, np.cumsum(sizes)]
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        at = borders(points, starts[:-1][sizes > 0])
        cuts = at.tolist()
        places = list(map(self.pieces.__getitem__, map(whole.__getitem__, map(slice, cuts, [*cuts[1:], len(whole)]))))
        return np.array(places, np.int64), np.diff(np.searchsorted(at, starts))

    def count(self, texts: Sequence[str]) -> np.ndarray:
        """Tokens of each text."""
        places, pieces = self._looked_up(texts)
        sizes = np.diff(np.array(self.ends))[places]
        return np.diff(np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(pieces)]])

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end to end, and where those of each text begin (and the last ends)."""
        places, pieces = self._looked_up(texts)
        ends = np.array(self.ends)
        sizes = np.diff(ends)[places]
        upto = np.r_[0, np.cumsum(sizes)]
        take = np.arange(upto[-1]) - np.repeat(upto[:-1] - ends[:-1][places], sizes)
        return np.array(self.flat, np.int32)[take], upto[np.r_[0, np.cumsum(pieces)]]

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode()


_made: dict[bytes, Bpe] = {}


def _bpe(ranks_file: bytes) -> Bpe:
    """One per worker and vocabulary."""
    if ranks_file not in _made:
        _made[ranks_file] = Bpe(ranks_file)
    return _made[ranks_file]


def _chunks(column: pa.Array, most: int = 1 << 21) -> Iterator[list[str]]:
    """The texts of a column, null as empty, in lists of about `most` code points."""
    out, size = [], 0
    for t in column.to_pylist():
        out.append(t or "")
        size += len(out[-1])
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def _mapped(df: DataFrame, keep: list[str], text: str, vocabulary: str, columns: dict[str, str], make) -> DataFrame:
    rows = df.select(*keep, df[text].alias("_text"))
    # the vocabulary has a fixed size, about 1 MB
    ranks = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks.value)
        for b in batches:
            at = 0
            for texts in _chunks(b.column("_text")):
                kept = [b.column(i).slice(at, len(texts)) for i in range(len(keep))]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*kept, *make(bpe, texts)], [*keep, *columns])

    return spread(rows).mapInArrow(run, ", ".join([*fields, *[f"{c} {t}" for c, t in columns.items()]]))


def encoded(df: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """The columns to keep and ids (array<int>): the tokens of the text, special tokens taken as ordinary text.

    One row per row of df; null and empty texts both have the empty list.
    Texts are encoded whole, whatever their length. With offsets, `ends` tells
    for each id where it ends in the UTF-8 bytes of the text.
    """

    def make(bpe: Bpe, texts: list[str]) -> list[pa.Array]:
        ids, begin = bpe.encode(texts)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(x, pa.int32()))
        if not offsets:
            return [lists(ids)]
        upto = np.r_[0, np.cumsum(bpe.lengths[ids])]
        return [lists(ids), lists(upto[1:] - np.repeat(upto[begin[:-1]], np.diff(begin)))]

    return _mapped(df, keep, text, vocabulary, {"ids": "array<int>"} | ({"ends": "array<int>"} if offsets else {}), make)


def counted(df: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns to keep and n_tokens (long), which is 0 for null and empty texts."""
    return _mapped(df, keep, text, vocabulary, {"n_tokens": "bigint"}, lambda bpe, texts: [pa.array(bpe.count(texts), pa.int64())])
