"""Runs of periodic text (operator 12), by string synchronising sets.

A run is a stretch of words with smallest period q (words q apart are equal), at least ``power`` periods and ``least`` words long, that no neighbouring word
extends.  All runs of all texts of a batch are found together:

1. *Small periods.*  Those of up to ``least // power`` words are read off directly: stretches where words q apart are equal.  They are
   the highly periodic regions that the sets below leave out.
2. *Synchronising sets* at the scales t = 4, 8, 16, ...  A position is selected if, among the hashes of the t-word fragments that begin in the
   t + 1 places from there, the smallest is the first or the last; fragments with a period of t/3 or less do not take part.
   Whether a position is selected depends on the 2t words from there alone.
3. *Equal contexts.*  A run of period q in [1.5 t, 3 t) holds a selected position and its copy q words later, both with their contexts inside
   the run: otherwise all its fragments of 3t - 1 words would have a period of t/3 or less and, by the theorem of Fine and Wilf, so would the run.  So selected
   positions of one text with equal hashes of their 2t words, that far apart, propose q.  Contexts have no period of t/3 or less, so there are at most
   nine of one kind within 3 t words.
4. A proposal is extended to both sides by comparing words.  Regions found at smaller scales are the fragments that are left out at
   larger ones.  Of equal regions the smallest period counts.

At scale t there are about 2 n / t positions, and only texts that can hold a run of that scale take part; the work is n log n for n words.
Words are compared by 64-bit hashes within one text.

A null or empty text has no words and no runs.  Rows are judged one by one, whatever ids repeat or are null; an empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import mix, small_batches, texts_of, Words

_LAST = np.iinfo(np.uint64).max


def _later(values: np.ndarray, by: int, fill: int = 0) -> np.ndarray:
    """The value ``by`` places later, ``fill`` beyond the end."""
    out = np.full(len(values), fill, values.dtype)
    out[: max(0, len(values) - by)] = values[by:]
    return out


def _least_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of the ``width`` values from each place on."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values, _later(values, span, _LAST))
        span *= 2
    return np.minimum(values, _later(values, width - span, _LAST)) if width > span else values


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _reach(values: np.ndarray, at: int, period: int, low: int, high: int) -> tuple[int, int]:
    """The widest stretch of ``values[low:high]`` around ``at`` in which values ``period`` apart are equal."""
    right, step = at, 64
    while right + period < high:
        upto = min(right + step, high - period)
        differ = values[right:upto] != values[right + period : upto + period]
        if differ.any():
            right += int(differ.argmax())
            break
        right, step = upto, 2 * step
    left, step = at, 64
    while left > low:
        begin = max(left - step, low)
        differ = values[begin:left] != values[begin + period : left + period]
        if differ.any():
            left -= int(differ[::-1].argmax())
            break
        left, step = begin, 2 * step
    return left, right + period


def _proposals(hashes: np.ndarray, contexts: np.ndarray, owner: np.ndarray, end: np.ndarray, dull: np.ndarray, scale: int) -> np.ndarray:
    """Rows (period, place) that equal contexts of the synchronising set at ``scale`` propose, in order and once each."""
    ids = np.where(dull, _LAST, hashes)
    least = _least_ahead(ids, scale + 1)
    place = np.arange(len(hashes))
    chosen = (place + 2 * scale <= end) & (least != _LAST) & ((least == ids) | (least == _later(ids, scale, _LAST)))
    at = np.flatnonzero(chosen)
    kind = mix(contexts[at] + mix(owner[at].astype(np.uint64)))
    order = np.argsort(kind, kind="stable")
    at, kind = at[order], kind[order]
    found = []
    for k in range(1, 10):
        same = kind[k:] == kind[:-k]
        apart = at[k:] - at[:-k]
        near = same & (apart < 3 * scale)
        if not near.any():
            break
        hit = near & (2 * apart >= 3 * scale)
        found.append(np.stack([apart[hit], at[:-k][hit]]))
    rows = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return rows[:, np.lexsort((rows[1], rows[0]))]


def find_runs(values: np.ndarray, first: np.ndarray, least: int = 24, power: int = 3) -> tuple[np.ndarray, ...]:
    """Runs of the texts ``values[first[i]:first[i + 1]]``: text, start within it, length and period, in order of text, start and period.

    ``power`` must be 3 or more: the sets promise no less.
    """
    if power < 3:
        raise ValueError("runs of fewer than three periods are out of reach")
    counts, small = np.diff(first), max(1, least // power)
    owner = np.repeat(np.arange(len(counts)), counts)
    last = first[1:][owner] if len(counts) else np.empty(0, np.int64)
    regions = [np.empty((3, 0), np.int64)]  # start, end, period
    for q in range(1, min(max(small, 5), len(values) - 1) + 1):  # up to five, the scales below need them
        begin, upto = _stretches((values[:-q] == values[q:]) & (owner[:-q] == owner[q:]))
        long = upto - begin >= 2 * q
        regions.append(np.stack([begin[long], upto[long] + q, np.full(int(long.sum()), q)]))
    place, scale = np.arange(len(values)), 1
    h = mix(values + np.uint64(1))
    while len(place):
        if scale >= 4:
            known = np.concatenate(regions, axis=1)
            known = known[:, (3 * known[2] <= scale) & (known[1] - known[0] >= scale)]
            known = known[:, np.isin(owner[known[0]], owner[place])] if known.shape[1] else known
            mark = np.zeros(len(place) + 1, np.int64)
            np.add.at(mark, np.searchsorted(place, known[0]), 1)
            np.add.at(mark, np.searchsorted(place, known[1] - scale) + 1, -1)
            own, dull = owner[place], np.cumsum(mark[:-1]) > 0
            start = np.searchsorted(place, first[:-1])
            end = (start + counts)[own]
            double = mix(h * np.uint64(0x9DDFEA08EB382D69) + _later(h, scale))
            got, seen = [], (-1, -1, -1)  # text, period and end of the region before
            local = values[place]
            for q, at in _proposals(h, double, own, end, dull, scale).T.tolist():
                if q <= small or (own[at] == seen[0] and q == seen[1] and at + q < seen[2]):
                    continue
                a, b = _reach(local, at, q, int(start[own[at]]), int(end[at]))
                seen = (own[at], q, b)
                if b - a >= 3 * q:
                    got.append((place[a], place[b - 1] + 1, q))
            if got:
                regions.append(np.array(got, np.int64).T)
        else:
            double = mix(h * np.uint64(0x9DDFEA08EB382D69) + _later(h, scale))
        scale *= 2
        keep = 2 * counts[owner[place]] >= 9 * scale  # room for three periods of 1.5 scales
        place, h = place[keep], double[keep]
    start, end, period = np.concatenate(regions, axis=1)
    enough = (end - start >= least) & (end - start >= power * period)
    start, end, period = start[enough], end[enough], period[enough]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    return owner[start], start - first[:-1][owner[start]], end - start, period


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, power: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the words that
    no run holds after its first period, joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            w = Words(batch.column("text"))
            text, start, length, period = find_runs(w.hashes(), w.first, least, power)
            cover = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(cover, w.first[text] + start + period, 1)
            np.add.at(cover, w.first[text] + start + length, -1)
            kept = np.cumsum(cover[:-1]) == 0
            per = np.bincount(text, minlength=batch.num_rows)
            offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], fields=list(_RUN)))
            collapsed = []
            for n, a, b, value in zip(per.tolist(), w.first[:-1].tolist(), w.first[1:].tolist(), batch.column("text"), strict=True):
                words = (value.as_py() or "").encode().split()
                collapsed.append(b" ".join(compress(words, kept[a:b].tolist()) if n else words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.counts.astype(np.int64)), runs, pa.array(collapsed, pa.string())], schema=schema)

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """Of an array of runs in order, the first with the greatest exact number of periods; null for none."""
    more = lambda best, r: F.when(r.length * best.period > best.length * r.period, r).otherwise(best)
    return F.when(F.size(runs) > 0, F.reduce(runs, F.get(runs, F.lit(0)), more))


def run_report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, start, length, period and exponent_milli of the strongest run, and sha-256 of all runs and of the collapsed text."""
    found = periodic_runs(docs, **options).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words of about a tenth of the documents, chosen by the checksum h of the id, made periodic from word a = g % n on, g = h div 10.

    The period is 1 + (n - a) div (3 + g % 8).  Null ids and texts without words stay as they are."""
    words = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.expr("h DIV 10"), F.size("words")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    placed = chosen.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    piece = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(piece, F.ceil((n - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), n - F.col("a"))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


#: Places whose next sixteen words are equal lie in one run or in none; stretches of them give the runs of each period.
ORACLE_SQL = r"""WITH crcs AS (
  SELECT doc_id, coalesce(text, '') AS text, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], list_transform(range(8), lambda k: 0::BIGINT)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS c
  FROM documents),
words AS (SELECT doc_id, xor(c, 4294967295) AS h, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM crcs),
places AS (SELECT doc_id, h, w, len(w) AS n, CASE WHEN len(w) > 0 AND h % 10 = 0 THEN (h // 10) % len(w) END AS a FROM words),
damaged AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) END AS w FROM places),
grams AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 16], ' ') AS gram FROM (SELECT doc_id, n, w, unnest(range(n - 15)) AS i FROM damaged WHERE n >= 24)),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + 15 + q AS length FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= 24 AND length >= 3 * q GROUP BY doc_id, start, length),
best AS (SELECT doc_id, start, length, period FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM runs) WHERE place = 1),
lists AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS text FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM damaged) p ANTI JOIN dropped USING (doc_id, i) GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
  sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM damaged d LEFT JOIN best b USING (doc_id) LEFT JOIN lists l USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
