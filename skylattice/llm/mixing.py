"""Mixing sources to target weights (operator 8), with DataFrame functions only.

Every row gets a hash-random key.  Rows are range-sorted by (source, key), so a source with a third of
all rows spreads over as many ranges as it needs; running sums of sizes come from sums within ranges plus
the totals of the ranges before.  Each source is then cut at its exact budget of words, whole epochs first.

A null text has size 0, a null source is a source of its own and comes last.  A source without words gets
target 0.  Rows that tie in key and size are interchangeable.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textops import own_columns, spare_names, stored, WORD

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def running_sums(df: DataFrame, group: str, order: list[Column], value: str) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of the same ``group`` (a null is a group) that precede in ``order``.

    Rows are dealt by range of (group, order), so no group has to fit into a task.  They are written
    between dealing and summing, so that both uses see the same ranges.
    """
    ranges = stored(df.repartitionByRange(F.col(group).asc_nulls_last(), *order).withColumn("range", F.spark_partition_id()), "ranges")
    totals = ranges.groupBy("range", group).agg(F.sum(value).alias("total"))  # one row for a range and group
    earlier = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("offset", F.coalesce(F.sum("total").over(earlier), F.lit(0))).select(F.col("range").alias("r"), F.col(group).alias("g"), "offset")
    within = Window.partitionBy("range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranges.withColumn("inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(totals, (F.col("range") == F.col("r")) & F.col(group).eqNullSafe(F.col("g"))).withColumn("before", F.col("inside") + F.col("offset")).drop("r", "g", "range", "inside", "offset")


def targets(sources: DataFrame, share: float, most: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``target`` to (source, source_size): ``share`` of all sizes by weight, none above ``most`` times its size.

    The excess of sources at their limit is dealt anew by weight until none is above; a round is one aggregate.
    """
    ranked = running_sums(sources.withColumn("one", F.lit(1)).withColumn("all", F.lit(0)), "all", [F.col("source").asc_nulls_last()], "one")
    table = F.array(*map(F.lit, weights))
    ranked = stored(ranked.select("source", "source_size", table[(F.col("before") % len(weights)).cast("int")].cast("double").alias("weight"), (most * F.col("source_size")).cast("double").alias("limit")), "sources")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("limit") <= level * F.col("weight")
        fixed, open_weight = ranked.agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        raised = (total - (fixed or 0.0)) / open_weight
        if raised <= level:
            break
        level = raised
    return ranked.select("source", "source_size", F.least("limit", level * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, and fingerprint (of the text)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("fingerprint"))
    rows = rows.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    placed = running_sums(rows, "source", [F.col("key"), F.col("size")], "size")
    sums = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sums, share, most).withColumnRenamed("source", "of")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("before")))
    return placed.join(goal, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "fingerprint")


def mix_documents(docs: DataFrame, share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """The mix itself, with the columns of ``docs`` (doc_id, text, source and any others; n_chars follows the text).

    A document appears once for each whole time it is taken; where the budget ends inside it, once more with its
    first words.  Rows equal in id, source and text count as one document whose copies add up.
    """
    plan = mix_plan(docs, share=share, most=most, seed=seed).groupBy("doc_id", "source", "fingerprint").agg(F.sum("taken").alias("taken"), F.max("size").alias("size")).filter("taken > 0")
    doc, source, print_, taken, size, key, n = spare_names(docs, "of_doc", "of_source", "of_print", "n_taken", "n_size", "text_key", "n_words")
    plan = plan.select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("fingerprint").alias(print_), F.col("taken").alias(taken), F.col("size").alias(size))
    own = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    own = own.dropDuplicates(["doc_id", "source", key])
    joined = own.join(plan, F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(key) == F.col(print_)))
    part = F.col(taken) % F.col(size)
    words = F.concat(F.array_repeat(F.col(size), F.expr(f"CAST({taken} div {size} AS INT)")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    # where the cut falls inside a document, the text runs to the end of its last word taken
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col(n) == F.col(size), F.col("text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col(n).cast("int")), ""))
    out = joined.withColumn(n, F.explode(words)).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*own_columns(docs))


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, (2 * source_size)::DOUBLE AS cap,
         [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS w
  FROM sums),
total AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS t FROM ranked),
-- the sources that reach their limit are those of least limit a weight; limiting more or fewer only lowers the level
levels AS (
  SELECT (any_value(t) - coalesce(sum(b.cap) FILTER (b.cap / b.w < a.cap / a.w), 0)) / sum(b.w) FILTER (b.cap / b.w >= a.cap / a.w) AS level
  FROM ranked a, ranked b, total GROUP BY a.source, a.cap, a.w),
goal AS (SELECT max(level) AS level FROM levels),
placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized),
cut AS (
  SELECT p.doc_id, p.size, p.before, r.source_size, least(r.cap, coalesce(g.level, 0) * r.w) AS target
  FROM placed p JOIN ranked r ON p.source IS NOT DISTINCT FROM r.source CROSS JOIN goal g)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (floor(target)::BIGINT // source_size) * size
          + greatest(0, least(size, floor(target)::BIGINT % source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM cut
"""
