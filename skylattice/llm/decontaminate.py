"""Benchmark decontamination by greedy string tiling (operator 5).

Words are compared in lower case and without ASCII punctuation.  A document meets a benchmark item if they share a seed of
``least`` words (a shorter item is its own seed).  The seeds of all items set bits of a filter of fixed size, which is
all that is broadcast; the documents it lets through join the items by seed.  Covering an item takes a number of its seeds, so
each item may leave its most common ones out of the index, and pairs that share too few seeds go: neither loses a leak.
What is left meets in one sorted stream: a document's text, then its items one by one.  Tiling then marks the longest matches first, found by Karp-Rabin hashes of runs of unmarked words, so that an item cut up and reordered is covered
as well.  An item whose words are covered to ``coverage`` or more has leaked.

Null and empty texts and items meet nothing.  Columns beyond id and text play no part and stay as they are.  Rows that repeat an id are judged one by one.  Empty tables give an
empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import Words, list_array, own_columns, rolling_hashes, run_hashes, signed, small_batches, spare_names, stored

#: The filter has 2**FILTER_BITS bits, whatever the size of the benchmark.
FILTER_BITS = 23
_PUNCTUATION = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def normalized(texts: pa.Array) -> Words:
    return Words(pa.array([None if t is None else t.encode().translate(None, _PUNCTUATION).decode() for t in texts.to_pylist()], pa.string()), lower=True)


def tiles(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two arrays of word hashes: (start in pattern, start in text, length), longest first."""
    free_p, free_t = np.ones(len(pattern), bool), np.ones(len(text), bool)
    least = max(1, min(least, len(pattern)))
    size, found = max(least, len(pattern) // 2), []

    def runs(values: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.arange(max(0, len(values) - size + 1))
        taken = np.concatenate([[0], np.cumsum(~free)])
        starts = starts[taken[starts + size] == taken[starts]] if len(starts) else starts
        return starts, rolling_hashes(values, starts, size)

    def longest() -> list[tuple[int, int, int]]:
        """Left-most matches of ``size`` free words or more, extended to the right."""
        p, hp = runs(pattern, free_p)
        t, ht = runs(text, free_t)
        hit = np.isin(ht, hp)
        by_hash: dict[int, list[int]] = {}
        for i, h in zip(p.tolist(), hp.tolist(), strict=True):
            by_hash.setdefault(h, []).append(i)
        out = []
        for j, h in zip(t[hit].tolist(), ht[hit].tolist(), strict=True):
            for i in by_hash[h]:
                if i and j and free_p[i - 1] and free_t[j - 1] and pattern[i - 1] == text[j - 1]:
                    continue  # part of a match that begins before
                most = min(len(pattern) - i, len(text) - j)
                same = (pattern[i : i + most] == text[j : j + most]) & free_p[i : i + most] & free_t[j : j + most]
                n = most if same.all() else int(np.argmin(same))
                if n >= size:
                    out.append((n, i, j))
        return out

    while True:
        matches = longest()
        if matches and max(matches)[0] > 2 * size:
            size = max(matches)[0]
            continue
        queue = [(-n, i, j) for n, i, j in matches]
        heapq.heapify(queue)
        while queue:  # the longest first; of one that is marked in part, what is left comes up again by its length
            n, i, j = heapq.heappop(queue)
            free = free_p[i : i - n] & free_t[j : j - n]
            if free.all():
                free_p[i : i - n] = free_t[j : j - n] = False
                found.append((i, j, -n))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], free, [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= size:
                    heapq.heappush(queue, (a - b, i + a, j + a))
        if size == least:
            return found
        size = max(least, size // 2)


def _seeds(w: Words, least: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    h = w.hashes()
    hashes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for n in lengths:
        start, owner = w.owners(n)
        hashes.append(run_hashes(h, start, n))
        owners.append(owner)
    return np.concatenate(hashes), np.concatenate(owners)


def item_seeds(items: DataFrame, least: int, coverage: float) -> DataFrame:
    """Rows (seed, length, item, m, spare, need): the seeds by which items are found, and how often each stands in its item.

    An item of n words has leaked if its tiles cover ``coverage * n`` of them.  A tile holds a seed for every ``length`` words at least, so
    ``need`` seeds are shared.  Of the most common seeds, up to ``need - 1`` (``spare`` in all) stay out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "item_text"):
            w = normalized(batch.column("item_text"))
            h = w.hashes()
            start, owner = w.owners(least)
            short = np.flatnonzero((w.counts > 0) & (w.counts < least))
            seeds = np.concatenate([run_hashes(h, start, least), run_hashes(h, w.first[short], w.counts[short])])
            length = np.concatenate([np.full(len(start), least), w.counts[short]])
            owner = np.concatenate([owner, short])
            yield pa.RecordBatch.from_arrays([pa.array(signed(seeds)), pa.array(length.astype(np.int64)), batch.column("item").take(pa.array(owner)), pa.array(w.counts[owner].astype(np.int64))], names=["seed", "length", "item", "n"])

    found = items.mapInArrow(run, "seed long, length long, item long, n long").groupBy("seed", "length", "item", "n").agg(F.count("*").alias("m"))
    need = F.ceil(F.lit(coverage) * F.col("n") / F.col("length") - 1e-9).cast("long")
    popular = found.groupBy("seed", "length").agg(F.count("*").alias("held"))
    common = Window.partitionBy("item").orderBy(F.desc("held"), "seed")
    ranked = found.join(popular, ["seed", "length"]).withColumn("need", need).withColumn("upto", F.sum("m").over(common.rowsBetween(Window.unboundedPreceding, 0)))
    out = (F.col("upto") < F.col("need")) & (F.col("held") > 1)
    spare = F.coalesce(F.max(F.when(out, F.col("upto"))).over(Window.partitionBy("item")), F.lit(0))
    return ranked.withColumn("spare", spare).filter(~out).select("seed", "length", "item", "m", "spare", "need")


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per leaked pair: doc_id, row (key of the document's text), item_id, coverage, and tiles (start in the item, start in the document, words; in turn)."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col("text").cast("string").alias("item_text"))
    items = items.filter("item_text IS NOT NULL").withColumn("item", F.xxhash64("item_id", "item_text")).dropDuplicates(["item"])
    seeds = stored(item_seeds(items.select("item", "item_text"), least, coverage), "seeds")
    lengths = sorted(r.length for r in seeds.select("length").distinct().collect())  # at most ``least`` numbers
    slot = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    words = seeds.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 AS INT))").alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
    table = words.toArrow()  # at most 2**(FILTER_BITS - 6) rows
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[table.column("word").to_numpy().astype(np.int64)] = table.column("bits").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            hashes, owners = _seeds(normalized(batch.column("text")), least, lengths)
            at = hashes >> np.uint64(64 - FILTER_BITS)
            hit = (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) > 0
            order = np.lexsort((hashes[hit], owners[hit]))
            h, o = hashes[hit][order], owners[hit][order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            n = np.bincount(o[fresh], minlength=batch.num_rows)
            some = pa.array(np.flatnonzero(n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(some), batch.column("row").take(some), batch.column("text").take(some), list_array(signed(h[fresh]), n[n > 0], pa.int64())], names=["doc_id", "row", "text", "seeds"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text"))
    near = stored(rows.select("doc_id", "row", "text").mapInArrow(passing, "doc_id long, row long, text string, seeds array<long>"), "near")
    pairs = near.select("doc_id", "row", "seeds").dropDuplicates(["doc_id", "row"]).select("doc_id", "row", F.explode("seeds").alias("seed")).join(seeds.drop("length"), "seed")
    pairs = pairs.groupBy("doc_id", "row", "item").agg(F.sum("m").alias("shared"), F.first("spare").alias("spare"), F.first("need").alias("need")).filter("shared + spare >= need")
    kind = items.schema["item_id"].dataType.simpleString()
    # a document and then its items, one row each, stream through a task: no row holds more than one text
    asked = pairs.join(items, "item").select("doc_id", "row", F.lit(True).alias("asks"), "item_id", F.col("item_text").alias("text"))
    texts = near.select("doc_id", "row", F.lit(False).alias("asks"), F.lit(None).cast(kind).alias("item_id"), "text")
    both = texts.union(asked).repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "asks")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text = None, np.empty(0, np.uint64)
        for batch in small_batches(batches, "text"):
            w, share, found, at = normalized(batch.column("text")), [], [], []
            h = w.hashes()
            for k, (doc, row, asks) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "asks")), strict=True)):
                own = h[w.first[k] : w.first[k + 1]]
                if not asks:
                    key, text = (doc, row), own.copy()
                elif key == (doc, row):
                    got = tiles(own, text, least)
                    share.append(sum(n for *_, n in got) / len(own))
                    found.append([x for t in got for x in t])
                    at.append(k)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("doc_id", "row", "item_id")), pa.array(share, pa.float64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "row", "item_id", "coverage", "tiles"])

    tiled = both.mapInArrow(tile, f"doc_id long, row long, item_id {kind}, coverage double, tiles array<long>")
    return tiled.filter(F.col("coverage") >= coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per contaminated document: doc_id, row, n_items, coverage (the largest), item_ids."""
    return leaks(docs, benchmark, **options).groupBy("doc_id", "row").agg(F.count("*").alias("n_items"), F.max("coverage").alias("coverage"), F.sort_array(F.collect_list("item_id")).alias("item_ids"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no leaked item, with their columns."""
    doc, row, key = spare_names(docs, "of_doc", "of_row", "text_key")
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(doc), F.col("row").alias(row))
    own = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return own.join(bad, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(row)), "left_anti").select(*own_columns(docs))
