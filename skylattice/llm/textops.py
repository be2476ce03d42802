"""Vectorised word handling on Arrow batches, shared by the operators of this subpackage.

A batch of texts is viewed as one byte buffer.  Word boundaries, word hashes and hashes of runs of
consecutive words all come from sums over that buffer, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored as stored  # noqa: PLC0414

#: Words are maximal runs of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit affects every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_NEAR = 64  # bytes of a word whose values come from a table
_FACTORS: dict[int, np.ndarray] = {}


def factors(n: int, seed: int = 0) -> np.ndarray:
    """The first n of a fixed sequence of odd random numbers: what the k-th element of a run counts.

    They are unrelated to each other, unlike the powers of one base, whose sums modulo 2**64 agree on well-known pairs
    of runs (those of Thue and Morse) whatever the base is.  One table for each seed and Python worker, as long as the longest run.
    """
    if len(_FACTORS.get(seed, ())) < n:
        at = np.arange(1 << max(5, int(n - 1).bit_length()), dtype=np.uint64)
        _FACTORS[seed] = mix(mix(at + np.uint64(1)) + np.uint64((seed + 1) * int(_BASE) & ((1 << 64) - 1))) | np.uint64(1)
    return _FACTORS[seed][:n]


def _byte_values(byte: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    return mix((byte.astype(np.uint64) + np.uint64(256) * place.astype(np.uint64) + np.uint64(1)) * _BASE + np.uint64(seed * 0xD6E8FEB86659FD93 & ((1 << 64) - 1)))


@lru_cache(4)
def _near_values(seed: int) -> np.ndarray:
    k = np.arange(256 * _NEAR)
    return _byte_values(k & 255, k >> 8, seed)


class Words:
    """The words of a batch of texts.

    ``starts``/``ends`` are byte positions of all words in ``data``; those of text i are the words
    ``first[i]:first[i + 1]``.  A null text has no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, values = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
        if len(bounds) == 0:
            bounds = np.zeros(1, np.int64)
        data = data[bounds[0] : bounds[-1]]
        self.bounds = bounds - bounds[0]
        self.data = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)) if lower else data  # A-Z
        # one virtual separator between texts keeps words of neighbours apart
        inside = (self.data != 0x20) & (self.data - np.uint8(0x09) > 4)  # bytes below wrap round
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.bounds] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(self.first)

    def hashes(self, seed: int = 1, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``most`` bytes: a sum over its bytes of random values of (byte, place in the word)."""
        return self._hashes((seed,), (most,))[0]

    def several(self, seeds: tuple[int, ...], most: int | None = None) -> list[np.ndarray]:
        """Independent hashes of each word, one array for each seed."""
        return self._hashes(seeds, (most,))

    def prefixes(self, lengths: tuple[int | None, ...], seed: int = 1) -> list[np.ndarray]:
        """Hashes of each word's first bytes, one array for each number of bytes (None: all); the bytes are summed once for all."""
        return self._hashes((seed,), lengths)

    def _hashes(self, seeds: tuple[int, ...], lengths: tuple[int | None, ...]) -> list[np.ndarray]:
        out = [np.empty(len(self.starts), np.uint64) for _ in range(len(seeds) * len(lengths))]
        step, at = 1 << 17, 0
        while at < len(self.starts):  # in slices, so that the temporary sums stay small
            begin = self.starts[at]
            upto = max(at + 1, int(np.searchsorted(self.ends, begin + step, "right")))
            piece = self.data[begin : self.ends[upto - 1]]
            kind = np.int32 if len(piece) < 1 << 31 else np.int64
            s, e = self.starts[at:upto] - begin, self.ends[at:upto] - begin
            place = np.arange(len(piece), dtype=kind)
            place -= np.repeat(s.astype(kind), np.diff(np.append(s, len(piece))))
            long = int((e - s).max()) > _NEAR
            near = (np.minimum(place, _NEAR - 1) << 8) | piece  # blanks after a word count for nothing
            far = np.flatnonzero(place >= _NEAR) if long else None
            ends = [np.minimum(e, s + most) if most else e for most in lengths]
            for k, seed in enumerate(seeds):
                total = np.empty(len(piece) + 1, np.uint64)
                total[0] = 0
                value = _near_values(seed).take(near)
                if long:
                    value[far] = _byte_values(piece[far], place[far], seed)
                np.cumsum(value, out=total[1:])
                before = total[s]
                for hashes, e in zip(out[k * len(lengths) :], ends):  # noqa: B905
                    hashes[at:upto] = mix(total[e] - before + (e - s).astype(np.uint64))
            at = upto
        return out

    def owners(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and text number of every run of ``length`` consecutive words within one text."""
        runs = np.maximum(self.counts - length + 1, 0)
        text = np.repeat(np.arange(len(runs)), runs)
        offset = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
        return self.first[text] + offset, text


def run_hashes(hashes: np.ndarray, starts: np.ndarray, lengths, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of words, given hashes of the words.  Another seed gives an independent one.

    Every word of every run is visited: runs that overlap much and are long are for ``rolling_hashes``.
    """
    if np.ndim(lengths) == 0 and lengths <= 32:
        total = np.zeros(len(starts), np.uint64)
        for k, factor in enumerate(factors(32, seed)[:lengths]):
            total += hashes[starts + k] * factor
        return mix(total + np.uint64(lengths))
    lengths = np.broadcast_to(np.asarray(lengths, np.int64), len(starts))
    total = np.zeros(len(starts), np.uint64)
    few = np.flatnonzero(lengths <= 32)
    for k, factor in enumerate(factors(32, seed)):
        few = few[lengths[few] > k]
        if not len(few):
            break
        total[few] += hashes[starts[few] + k] * factor
    many = np.flatnonzero(lengths > 32)
    upto = np.cumsum(lengths[many])
    at = 0
    while at < len(many):  # in slices, so that the products stay small
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 20), "right")))
        some = many[at:end]
        n = lengths[some]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        total[some] = np.add.reduceat(hashes[np.repeat(starts[some], n) + place] * factors(int(n.max()), seed)[place], first)
        at = end
    return mix(total + lengths.astype(np.uint64))


_PRIME = np.uint64((1 << 31) - 1)


def _modulo(x: np.ndarray) -> np.ndarray:
    """Remainders modulo the prime 2**31 - 1 of numbers below 2**63."""
    x = (x & _PRIME) + (x >> np.uint64(31))
    x = (x & _PRIME) + (x >> np.uint64(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    power, value = np.ones(1, np.uint64), base
    while len(power) < n:
        power, value = np.concatenate([power, _modulo(power * np.uint64(value))]), value * value % int(_PRIME)
    return power


def rolling_hashes(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of the runs of one length, by two polynomials modulo a prime: the work does not grow with the length."""
    out, n = np.zeros(len(starts), np.uint64), len(hashes)
    size = 1 << n.bit_length()
    for half, base in ((0, 1_103_515_245), (32, 1_220_703_125)):
        value = _modulo(hashes >> np.uint64(half) & np.uint64(0xFFFFFFFF)) + np.uint64(1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_modulo(value * _powers(base, size)[:n]), out=total[1:])  # terms below 2**31: no overflow up to 2**32 words
        run = _modulo(_modulo(total[starts + length] - total[starts]) * _powers(pow(base, -1, int(_PRIME)), size)[starts])
        out = (out << np.uint64(31)) ^ run
    return mix(out + np.uint64(length))


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return h.view(np.int64)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of a text or binary column (a longer value stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column).cast(pa.large_binary())
        total = np.cumsum(np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]))
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(total, before + most, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that text operators read, under fixed names; other columns play no part."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive slices of ``values``, of the given lengths, as a list column."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def plainly_named(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1 and so on, for functions on Arrow batches that return rows as they are: names may hold dots or backquotes.
    ``toDF(*df.columns)`` gives the names back."""
    return df.select(*[c.alias(f"c{k}") for k, c in enumerate(own_columns(df))])
