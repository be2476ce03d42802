"""Removal of passages that a document with a smaller id has too (operator 10), by relative Lempel-Ziv factors.

The documents are factored against each other: a factor (start, words, ref_doc, ref_start) says that a run of words also stands
in a document with a smaller id, from ``ref_start`` on.  A window is ``window`` consecutive words; a factor has that length or more.

1. *Reference blocks.*  A window is anchored at the smallest seed hash inside it, so equal windows have equal anchors.  The
   windows that share an anchor form a block: the anchor with all the words around it that those windows cover.  The
   blocks of all documents, each with its document and place, are the index of the reference.
2. *Hits.*  Blocks meet by anchor.  A block that a smaller document has too is a hit with a place in the reference: the first
   document that has it.
3. *Factor boundaries.*  Where blocks with one anchor differ, a factor may begin or end inside them.  Only there the
   windows themselves are looked up, so that a passage is caught to the word whatever stands around it.
4. *Parse.*  From left to right a factor takes up hit after hit, block or window, as long as the next one continues the same
   reference document at the next word; else a new factor begins.  The spans of factors go.

Of several documents that hold a hit, the first is the reference; a factor therefore ends where the first holder changes, and the
next one goes on from there.  The words under factors do not depend on that choice.

Within a batch, a hit in a smaller document of the batch is decided at once, and of blocks that share an anchor but differ only two
take part in the shuffle; the others are boundaries.  So the rows that a popular passage or seed sends are bounded by twice the number of
batches.

A null or empty text has no words.  Rows with a null id are kept whole and remove nothing from others.  Rows that
repeat an id are judged one by one against smaller ids.  An empty table gives an empty result.  Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import Words, mix, run_hashes, signed, small_batches, stored, texts_of


class Blocks:
    """Windows of a batch (``start`` word, ``text`` number) and the block of each (``block``, with ``anchor`` and ``content`` hashes)."""

    def __init__(self, texts: pa.Array, window: int, seed: int):
        self.words = Words(texts)
        self.window = window
        self.hashes = self.words.hashes()
        self.start, self.text = self.words.owners(window)
        n = len(self.start)
        seeds = np.zeros(len(self.hashes), np.uint64)
        at = np.arange(max(0, len(self.hashes) - seed + 1))
        seeds[: len(at)] = run_hashes(self.hashes, at, seed)  # those across two texts lie in no window
        best, where = np.full(n, np.iinfo(np.uint64).max, np.uint64), self.start.copy()
        for k in range(window - seed + 1):
            here = seeds[self.start + k]
            less = here < best
            best[less], where[less] = here[less], self.start[less] + k
        head = np.ones(n, bool)
        head[1:] = (where[1:] != where[:-1]) | (self.text[1:] != self.text[:-1])
        begin = np.flatnonzero(head)
        self.block = np.cumsum(head) - 1
        size = np.diff(np.append(begin, n))
        self.begin = first = self.start[begin]
        self.of = self.text[begin]
        self.anchor = seeds[where[begin]]
        self.content = mix(run_hashes(self.hashes, first, size + window - 1, 1) + (where[begin] - first).astype(np.uint64))

    def keys(self, which: np.ndarray) -> np.ndarray:
        """Hashes of the windows selected by a mask."""
        return run_hashes(self.hashes, self.start[which], self.window)

    def checks(self, which: np.ndarray) -> np.ndarray:
        """Second hashes of those windows, independent of the first: two windows count as equal if both agree."""
        return run_hashes(self.hashes, self.start[which], self.window, 1)


def _first_here(ids: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Among rows of a batch: those that are the first (one for each key, of the smallest id); whether a smaller id has a row's key; and the first row of its key."""
    order = np.lexsort((ids, *keys))
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    group = np.cumsum(fresh) - 1
    first, of = order[fresh], np.empty(len(order), np.int64)
    of[order] = first[group]
    return first, ids > ids[of], of


def _apart(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys for rows that are decided already: spread evenly however popular the key was."""
    return mix(keys + mix(ids.astype(np.uint64)))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)


#: Rows that meet by ``key``.  A known one is decided: a hit at (ref, pos), or without ``ref`` a boundary; for others ``pos`` is their own place.
_ROW = pa.schema([("key", pa.int64()), ("value", pa.int64()), ("doc_id", pa.int64()), ("known", pa.bool_()), ("ref", pa.int64()), ("pos", pa.int32())])
_ROW_SQL = "key long, value long, doc_id long, known boolean, ref long, pos int"


def _rows(key: np.ndarray, value: np.ndarray, ids: np.ndarray, place: np.ndarray, ask: np.ndarray, hit: np.ndarray, of: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
    """Rows that ask, rows whose hit is known (the row ``of`` them), and rows known as boundaries."""
    rows = np.concatenate([ask, hit, edge])
    n = len(ask)
    dealt, pos, ref = key[rows], place[rows], np.zeros(len(rows), np.int64)
    dealt[n:] = _apart(dealt[n:], ids[rows][n:])
    known = slice(n, n + len(hit))
    pos[known], ref[known] = place[of[hit]], ids[of[hit]]
    blank = np.ones(len(rows), bool)
    blank[known] = False
    return pa.RecordBatch.from_arrays([pa.array(signed(dealt)), pa.array(signed(value)[rows]), pa.array(ids[rows]), pa.array(np.arange(len(rows)) >= n), pa.array(ref, mask=blank), pa.array(pos.astype(np.int32))], schema=_ROW)


def _entries(window: int, seed: int):
    """The blocks of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            b = Blocks(batch.column("text"), window, seed)
            ids = _ids(batch)[b.of]
            first, behind, of = _first_here(ids, b.content, b.anchor)
            head = np.flatnonzero(np.diff(b.anchor[first], prepend=~b.anchor[first[:1]]) != 0)
            nth = np.arange(len(first)) - np.repeat(head, np.diff(np.append(head, len(first))))
            yield _rows(b.anchor, b.content, ids, b.begin - b.words.first[b.of], first[nth < 2], np.flatnonzero(behind), of, first[nth >= 2])

    return run


def _edges(window: int, seed: int):
    """The single windows of blocks at the boundaries of factors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            b = Blocks(batch.column("text"), window, seed)
            which = (_Marks(batch.column("open")).find(b.of, b.content) >= 0)[b.block]
            key, check, ids = b.keys(which), b.checks(which), _ids(batch)[b.text[which]]
            first, behind, of = _first_here(ids, check, key)
            yield _rows(key, check, ids, b.start[which] - b.words.first[b.text[which]], first, np.flatnonzero(behind), of, first[:0])

    return run


class _Marks:
    """Per row of a batch, hashes from a list column (of hashes, or of hash, ref and pos): which (row, hash) pairs are in it."""

    def __init__(self, column: pa.Array):
        counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows, flat = np.repeat(np.arange(len(counts)), counts), column.flatten()
        plain = lambda a, kind: a.to_numpy(zero_copy_only=False).astype(kind)
        hashes, self.ref, self.pos = (flat, None, None) if not pa.types.is_struct(flat.type) else flat.flatten()
        pair = self._pair(rows, plain(hashes, np.int64).view(np.uint64))
        order = np.argsort(pair, kind="stable")
        self.have = pair[order]
        if self.ref is not None:
            self.ref, self.pos = plain(self.ref, np.int64)[order], plain(self.pos, np.int64)[order]

    @staticmethod
    def _pair(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return mix(hashes + mix(rows.astype(np.uint64) + np.uint64(1)))

    def find(self, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each pair among the marks, -1 for none."""
        if not len(self.have):
            return np.full(len(rows), -1)
        want = self._pair(rows, hashes)
        at = np.minimum(np.searchsorted(self.have, want), len(self.have) - 1)
        return np.where(self.have[at] == want, at, -1)


def _factors(b: Blocks, blocks: _Marks, windows: _Marks) -> tuple[np.ndarray, ...]:
    """The parse of a batch: text, start, words, reference document and place of each factor, in order."""
    block = blocks.find(b.of, b.content)[b.block]
    ref, pos, hit = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64), block >= 0
    inside = np.flatnonzero(hit)
    if len(inside):
        ref[inside], pos[inside] = blocks.ref[block[inside]], blocks.pos[block[inside]] + b.start[inside] - b.begin[b.block[inside]]
    ask = np.flatnonzero(~hit)
    if len(windows.have) and len(ask):
        at = windows.find(b.text[ask], b.checks(ask))
        ask, at = ask[at >= 0], at[at >= 0]
        ref[ask], pos[ask], hit[ask] = windows.ref[at], windows.pos[at], True
    on = np.flatnonzero(hit)
    text, start, ref, pos = b.text[on], b.start[on], ref[on], pos[on]
    head = np.ones(len(on), bool)
    head[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1) | (ref[1:] != ref[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(head)
    words = np.diff(np.append(first, len(on))) + b.window - 1
    return text[first], start[first] - b.words.first[text[first]], words, ref[first], pos[first]


_FACTOR = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("ref_doc", pa.int64()), ("ref_start", pa.int64())])


def _kept(window: int, seed: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.string()), ("factors", pa.list_(_FACTOR))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            b = Blocks(batch.column("text"), window, seed)
            text, start, length, ref, pos = _factors(b, _Marks(batch.column("factors")), _Marks(batch.column("windows")))
            cover = np.zeros(len(b.hashes) + 1, np.int64)
            at = start + b.words.first[text]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            covered = np.cumsum(cover[:-1]) > 0
            per = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=batch.num_rows))]).astype(np.int32)
            factors = pa.ListArray.from_arrays(pa.array(per), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, ref, pos)], fields=list(_FACTOR)))
            texts, spans, kept, removed = batch.column("text"), [], [], []
            for i, (at, upto) in enumerate(zip(b.words.first[:-1], b.words.first[1:], strict=True)):
                words, out = (texts[i].as_py() or "").encode().split(), covered[at:upto]
                removed.append(int(out.sum()))
                if removed[-1]:
                    spans.append(np.flatnonzero(np.diff(np.concatenate([[0], out, [0]]))).tolist())
                    words = compress(words, ~out)
                else:
                    spans.append([])
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(b.words.counts), pa.array(removed, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.string()), factors], schema=schema)

    return run, "doc_id long, n_words long, n_removed long, spans array<long>, kept string, factors array<struct<start:long,words:long,ref_doc:long,ref_start:long>>"


def _decided(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, value, hit, ref, pos, edge): ``hit`` if a smaller document has the same value under the key, and where;
    ``edge`` if only other values are there.  Rows known within their batch pass through."""
    group, same = Window.partitionBy("key"), Window.partitionBy("key", "value")
    met = rows.withColumn("n", F.count("*").over(group)).filter("n > 1 OR known")
    met = met.withColumn("differs", F.min("value").over(group) != F.max("value").over(group)).withColumn("first", F.min(F.struct("doc_id", "pos")).over(same))
    met = met.withColumn("hit", F.when(F.col("known"), F.col("ref").isNotNull()).otherwise(F.col("first.doc_id") < F.col("doc_id")))
    place = lambda own, first: F.when(F.col("known"), F.col(own)).otherwise(F.col(f"first.{first}")).alias(own)
    return met.select("doc_id", "value", "hit", place("ref", "doc_id"), place("pos", "pos"), (~F.col("hit") & (F.col("known") | F.col("differs"))).alias("edge"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, seed: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, spans (start and end word of each removed passage,
    in turn), kept (the other words, joined by one space) and factors (start, words, ref_doc, ref_start)."""
    source = texts_of(docs, id_col, text_col)
    known_ids = source.filter("doc_id IS NOT NULL")
    met = _decided(known_ids.mapInArrow(_entries(window, seed), _ROW_SQL)).filter("hit OR edge")
    place = F.struct("value", "ref", "pos")
    notes = stored(met.groupBy("doc_id").agg(F.collect_set(F.when(F.col("hit"), place)).alias("factors"), F.collect_set(F.when(F.col("edge"), F.col("value"))).alias("open")), "factors")
    edges = known_ids.join(notes.filter(F.size("open") > 0).select("doc_id", "open"), "doc_id").mapInArrow(_edges(window, seed), _ROW_SQL)
    windows = _decided(edges).filter("hit").groupBy("doc_id").agg(F.collect_set(place).alias("windows"))
    marks = notes.select("doc_id", "factors").join(windows, "doc_id", "full")
    run, schema = _kept(window, seed)
    return source.join(marks, "doc_id", "left").mapInArrow(run, schema)
