"""Line dedup by a deletion-neighbourhood join (operator 2).

A line is its sequence of words.  It goes if an earlier line (by doc_id, then line number) is equal, or differs by one
inserted, deleted or replaced word while the longer of the two has ``least`` words or more (at five, similarity is 0.8 at
least).  Lines are judged on the input, not on what is left; lines without words stay.

1. Equal lines meet by hash; the earliest stands for all.
2. Two lines one edit apart share their first or their last eight words unless they are short.  Lines of more than
   sixteen words that share neither with any other are left out; nothing is lost.
3. The rest emit their deletion neighbourhood: a hash of the line without word i, for each i, and of the whole line.
   A whole line meets those that lose a word to become it; lines that agree without word i meet as replacements.  Each
   key hands every member its earliest partner instead of all pairs.
4. Partners are verified by edit distance on their words.

Null and empty texts have one line without words.  Rows with a null id are kept whole and remove nothing.  Of rows
that repeat an id and a line number, equal lines count as one occurrence and stay or go together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import factors, mix, own_columns, run_hashes, signed, small_batches, spare_names, stored, texts_of, Words

EDGE = 8


class Lines:
    """Lines with words of a batch: ``text`` and line ``number``, first word and word count of each."""

    def __init__(self, texts: pa.Array):
        w = self.words = Words(texts)
        breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
        text = np.repeat(np.arange(len(w.counts)), w.counts)
        number = breaks[w.starts] - breaks[w.bounds[:-1]][text]
        self.total = np.diff(breaks[w.bounds]) + 1
        head = np.ones(len(text), bool)
        head[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1])
        self.first = np.flatnonzero(head)
        self.count = np.diff(np.append(self.first, len(text)))
        self.text, self.number = text[self.first], number[self.first]
        self.hashes, self.others = w.several((1, 2))

    def hash(self, seed: int = 0) -> np.ndarray:
        """Hashes of the lines; with a seed, of other hashes of the words and independent of those without."""
        return run_hashes(self.others if seed else self.hashes, self.first, self.count, seed)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        x = Lines(batch.column("text"))
        edge = np.minimum(EDGE, x.count)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(x.text)), *map(pa.array, (x.number.astype(np.int64), x.count.astype(np.int64), signed(x.hash()), signed(x.hash(1)), signed(run_hashes(x.hashes, x.first, edge)), signed(mix(run_hashes(x.hashes, x.first + x.count - edge, edge)))))],
            names=["doc_id", "line", "n", "h1", "h2", "head", "tail"],
        )


def without_each(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines ``first:first + count`` of the words: hash of a line without word i, for each line and each i, equal to that of the shorter line itself; the lines' numbers; i."""
    line = np.repeat(np.arange(len(count)), count)
    start = np.cumsum(count) - count
    place = np.arange(len(line)) - start[line]
    h, by = hashes[first[line] + place], factors(int(count.max(initial=1)))
    left, right = (np.zeros(len(line) + 1, np.uint64) for _ in range(2))  # sums over all lines: only differences inside a line are used
    np.cumsum(h * by[place], out=left[1:])
    np.cumsum(np.where(place > 0, h * by[place - 1], np.uint64(0)), out=right[1:])
    end = np.repeat(right[start + count], count)
    return mix((left[:-1] - left[start][line]) + (end - right[1:]) + (count.astype(np.uint64) - np.uint64(1))[line]), line, place


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether two sequences are at most one insertion, deletion or replacement apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidate lines of documents, as text."""
    for batch in small_batches(batches, "text"):
        docs, numbers, texts, h1s = [], [], [], []
        x = Lines(batch.column("text"))
        own = dict(zip(zip(x.text.tolist(), x.number.tolist(), strict=True), zip(signed(x.hash()).tolist(), signed(x.hash(1)).tolist(), strict=True), strict=True))
        for k, (doc, text, wanted) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True)):
            lines = text.split("\n")
            for want in wanted:
                if own.get((k, want["line"])) == (want["h1"], want["h2"]):  # else another row with this id has it
                    docs.append(doc)
                    numbers.append(want["line"])
                    texts.append(lines[want["line"]])
                    h1s.append(want["h1"])
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "line", "text"])


_KEYS = pa.schema([("key", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int64()), ("doc_near", pa.int64()), ("line_near", pa.int64())])


def _neighbourhoods(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            batch = batch.take(pa.array(np.lexsort((batch.column("line").to_numpy(), batch.column("doc_id").to_numpy()))))
            w = Words(batch.column("text"))
            h = w.hashes()
            some = np.flatnonzero(w.counts >= least)
            cut, of, place = without_each(h, w.first[some], w.counts[some])
            key = np.concatenate([run_hashes(h, w.first[:-1], w.counts), cut])
            place = np.concatenate([np.full(len(w.counts), -1), place])  # -1: the whole line
            row = np.concatenate([np.arange(len(w.counts)), some[of]])
            doc, line = (batch.column(c).to_numpy()[row] for c in ("doc_id", "line"))
            # of replacements that meet here already, the earliest goes on and the others have found a partner
            order = np.lexsort((place, key))  # rows of one key and place stay by document and line
            fresh = np.ones(len(order), bool)
            fresh[1:] = (key[order][1:] != key[order][:-1]) | (place[order][1:] != place[order][:-1])
            least_at = order[fresh][np.cumsum(fresh) - 1]
            near_doc, near_line = doc[least_at], line[least_at]
            key, place, doc, line = key[order], place[order], doc[order], line[order]
            met = ~fresh & (place >= 0) & ((near_doc != doc) | (near_line != line))
            keep = fresh | met | (place < 0)
            key = np.where(met, mix(key + mix(doc.astype(np.uint64) * np.uint64(31) + line.astype(np.uint64))), key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(key)[keep]), pa.array(np.where(met, -2, place)[keep]), pa.array(doc[keep]), pa.array(line[keep]), pa.array(near_doc[keep], mask=~met[keep]), pa.array(near_line[keep], mask=~met[keep])],
                schema=_KEYS,
            )

    return run, "key long, place long, doc_id long, line long, doc_near long, line_near long"


def _verified(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("text").to_pylist(), batch.column("other").to_pylist(), strict=True):
                x, y = a.encode().split(), b.encode().split()
                keep.append(max(len(x), len(y)) >= least and within_one(x, y))
            yield batch.select(["doc_id", "line"]).filter(pa.array(keep, pa.bool_()))

    return run, "doc_id long, line long"


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, removed (numbers of the lines that go, from 0)."""
    source = texts_of(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    known = source.filter("doc_id IS NOT NULL")
    rows = stored(known.mapInArrow(_occurrences, "doc_id long, line long, n long, h1 long, h2 long, head long, tail long"), "lines")
    at = F.struct("doc_id", "line")
    unique = stored(rows.groupBy("n", "h1", "h2").agg(F.min(at).alias("at"), F.any_value("head").alias("head"), F.any_value("tail").alias("tail")), "unique")
    ends = unique.filter(f"n >= {2 * EDGE}").select("at", "n", "h1", "h2", F.explode(F.array("head", "tail")).alias("end"))
    shared = ends.groupBy("end").agg(F.count("*").alias("many")).filter("many > 1").select("end")
    long = ends.filter(f"n > {2 * EDGE}").join(shared, "end", "left_semi").select("at", "h1", "h2").distinct()
    short = unique.filter(f"n BETWEEN {least - 1} AND {2 * EDGE}").select("at", "h1", "h2")
    wanted = long.union(short).select(F.col("at.doc_id").alias("doc_id"), F.struct(F.col("at.line").alias("line"), "h1", "h2").alias("line")).groupBy("doc_id").agg(F.collect_list("line").alias("lines"))
    lines = stored(known.join(wanted, "doc_id").mapInArrow(_lines, "doc_id long, line long, text string").dropDuplicates(["doc_id", "line", "text"]), "candidates")
    run, schema = _neighbourhoods(least)
    keys = lines.mapInArrow(run, schema)
    here = F.struct("doc_id", "line")
    group, place = Window.partitionBy("key"), Window.partitionBy("key", "place")
    met = keys.withColumn("many", F.count("*").over(group)).filter("many > 1 OR place = -2")
    met = met.withColumn("whole", F.min(F.when(F.col("place") == -1, here)).over(group)).withColumn("lost", F.min(F.when(F.col("place") >= 0, here)).over(group)).withColumn("swap", F.min(here).over(place))
    near = F.when(F.col("place") == -2, F.struct(F.col("doc_near").alias("doc_id"), F.col("line_near").alias("line"))).when(F.col("place") == -1, F.col("lost")).otherwise(F.least("whole", "swap"))
    pairs = met.withColumn("near", near).filter(F.col("near") < here).select("doc_id", "line", F.col("near.doc_id").alias("doc_near"), F.col("near.line").alias("line_near")).distinct()
    other = lines.select(F.col("doc_id").alias("doc_near"), F.col("line").alias("line_near"), F.col("text").alias("other"))
    run, schema = _verified(least)
    edited = pairs.join(lines, ["doc_id", "line"]).join(other, ["doc_near", "line_near"]).select("doc_id", "line", "text", "other").mapInArrow(run, schema).distinct()
    equal = rows.join(unique.select("n", "h1", "h2", "at"), ["n", "h1", "h2"]).filter(F.col("at") < at).select("doc_id", "line")
    gone = equal.union(edited).distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    counted = source.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long").alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<bigint>"))
    return counted.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def drop_lines(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any others) without the lines that ``line_dedup`` removes; other columns stay as they are."""
    doc, lines = spare_names(docs, "of_doc", "removed_lines")
    gone = decisions.filter("n_removed > 0").select(F.col("doc_id").alias(doc), F.col("removed").alias(lines))
    kept = F.filter(F.split("text", "\n", -1), lambda line, k: ~F.array_contains(lines, k.cast("long")))
    joined = docs.join(gone, F.col("doc_id") == F.col(doc), "left")
    return joined.withColumn("text", F.when(F.col(lines).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*own_columns(docs))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line
  FROM documents),
words AS (SELECT doc_id, line, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM lines),
firsts AS (SELECT w, len(w) AS n, min({'d': doc_id, 'l': line}) AS pos FROM words WHERE len(w) > 0 GROUP BY w),
cuts AS (SELECT w, n, pos, unnest(range(n)) AS i FROM firsts WHERE n >= 5),
keys AS (SELECT array_to_string(w[1:i], ' ') || ' ' || array_to_string(w[i + 2:], ' ') AS k, i, n, pos FROM cuts),
swapped AS (SELECT pos, min(pos) OVER (PARTITION BY k, i, n) AS near FROM keys),
losses AS (
  SELECT f.pos AS whole, k.pos AS longer
  FROM (SELECT DISTINCT trim(k) AS k, pos, n FROM keys) k JOIN firsts f ON f.n = k.n - 1 AND array_to_string(f.w, ' ') = k.k),
gone AS (
  SELECT DISTINCT pos FROM swapped WHERE near < pos
  UNION SELECT longer FROM losses WHERE whole < longer
  UNION SELECT whole FROM losses WHERE longer < whole),
removed AS (
  SELECT doc_id, list(line::BIGINT ORDER BY line) AS removed FROM (
    SELECT s.doc_id, s.line FROM words s JOIN firsts f ON s.w = f.w
    WHERE f.pos < {'d': s.doc_id, 'l': s.line} OR f.pos IN (SELECT pos FROM gone))
  GROUP BY doc_id)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n_lines, coalesce(len(r.removed), 0)::BIGINT AS n_removed, coalesce(r.removed, []) AS removed
FROM documents d LEFT JOIN removed r USING (doc_id)
"""
