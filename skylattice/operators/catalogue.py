"""A catalogue of saved mapping profiles: which of them fit the header of a log.

Equal headers are one.  A profile that lacks at most ``lacks`` of its columns in a header has one of any ``lacks`` + 1 of its columns there; so each profile stands in the
index under the ``lacks`` + 1 columns that the fewest headers have, and only what meets there is compared.  Profiles are compared with and ranked
for headers; logs take part only at the end, when each is dealt the ranking of its header: as many rows as there are answers, made from lists of logs
and lists of ranks that are spread over all tasks, so neither a popular header nor a long ranking is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Joins the trimmed names of a header before they are hashed, as ``mapping.header_hash`` does.
UNIT = "\x1f"
#: Logs, and ranks, of one list: a pair of lists makes at most a quarter of a million rows and travels as one.
LIST = 1 << 9


def headers_of(columns: DataFrame) -> DataFrame:
    """One row a log of (log_id, position, column): log_id, header_hash and its columns in order."""
    named = F.transform(F.array_sort(F.collect_list(F.struct("position", F.trim("column").alias("column")))), lambda c: c["column"])
    return columns.groupBy("log_id").agg(named.alias("columns")).select("log_id", F.substring(F.sha2(F.array_join("columns", UNIT), 256), 1, 16).alias("header_hash"), "columns")


def matches(columns: DataFrame, profiles: DataFrame, lacks: int = 0) -> DataFrame:
    """Rows (log_id, rank, profile, exact, n_columns, missing) of the profiles that fit each log.

    ``columns``: (log_id, position, column); ``profiles``: (profile, header_hash, columns), the header that a profile was saved for (or null) and the columns it reads.
    A profile fits a header of its hash exactly, and any header that has all but ``lacks`` of its columns, and one of them at least.  Exact ones come first, then
    those that lack less, read more, and are first by name.  Logs that nothing fits have no row.
    """
    logs = headers_of(columns)
    return dealt(logs, rankings(logs, profiles, lacks))


def rankings(logs: DataFrame, profiles: DataFrame, lacks: int = 0) -> DataFrame:
    """Rows (header_hash, rank, profile, exact, n_columns, missing): the answers of ``matches`` for each header of ``logs`` (as from ``headers_of``)."""
    headers = logs.groupBy("header_hash").agg(F.first("columns").alias("held"))
    own = profiles.select("profile", F.struct(F.col("header_hash").alias("saved_for"), F.array_distinct("columns").alias("wanted")).alias("kind"))
    kinds = own.select("kind").distinct()  # profiles that ask and were saved for the same are compared once
    postings = headers.select("header_hash", F.explode(F.array_distinct("held")).alias("column"))
    often = postings.groupBy("column").agg(F.count("*").alias("often"))
    asked = kinds.select("kind", F.explode("kind.wanted").alias("column")).join(often, "column", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    rare = asked.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("often", "column"))).filter(F.col("place") <= lacks + 1).select("kind", "column")
    met = rare.join(postings, "column").select("kind", "header_hash").distinct()
    same = kinds.join(headers, F.col("kind.saved_for") == F.col("header_hash")).select("kind", "header_hash")
    missing, exact = F.array_sort(F.array_except("kind.wanted", "held")), F.coalesce(F.col("kind.saved_for") == F.col("header_hash"), F.lit(False))
    found = met.union(same).distinct().join(headers, "header_hash").select("header_hash", "kind", missing.alias("missing"), exact.alias("exact"), F.size("kind.wanted").cast("long").alias("n_columns"))
    fit = found.filter((F.size("missing") <= F.least(F.lit(lacks), F.col("n_columns") - 1)) | F.col("exact")).join(own, "kind")
    order = Window.partitionBy("header_hash").orderBy(F.desc("exact"), F.size("missing"), F.desc("n_columns"), "profile")
    return fit.withColumn("rank", F.row_number().over(order).cast("long")).select("header_hash", "rank", "profile", "exact", "n_columns", "missing")


def dealt(logs: DataFrame, ranking: DataFrame) -> DataFrame:
    """Every log (log_id, header_hash) with every row of the ranking (header_hash, rank and others) of its header.

    A pair of lists becomes rows in two steps, ranks first, that Spark may not compile into one: compiled code hands on its rows only when an input row
    is used up, so in one step a task would hold all rows of a pair at once.
    """
    own = [c for c in ranking.columns if c != "header_hash"]
    fits = ranking.groupBy("header_hash", F.floor((F.col("rank") - 1) / LIST).alias("block")).agg(F.collect_list(F.struct(*own)).alias("fits"))
    sizes = logs.groupBy("header_hash").agg(F.ceil(F.count("*") / LIST).alias("parts"))
    part = F.pmod(F.xxhash64("log_id"), F.col("parts"))
    alike = logs.select("log_id", "header_hash").join(sizes, "header_hash").groupBy("header_hash", part.alias("part")).agg(F.collect_list(F.struct("log_id")).alias("logs"))
    tasks = int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = alike.join(fits, "header_hash").repartition(tasks, "header_hash", "part", "block")  # by number: a few bytes here are many rows later
    ranks = pairs.select("logs", F.inline("fits")).coalesce(tasks)  # moves nothing: ends the compiled step
    return ranks.select(F.inline("logs"), *own)
