"""Secret scan through a trigram inverted index (operator 7), with DataFrame functions only.

Each rule's regular expression yields a Boolean query over trigrams that any match must contain.  Postings
(trigram, text key) are built for the trigrams the rules ask for; a rule's query is answered from the postings
of a text, and only candidates are verified with the expression itself.  Rules without mandatory trigrams
scan every text.  Equal texts share one key and so one set of postings.

Spans are kind:start:end in code points, end exclusive, by start and then in the order of the rules.
Null and empty texts have no spans; repeated rows are answered one by one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

parse = re._parser.parse  # Python's own parse tree of an expression


@dataclass(frozen=True)
class Rule:
    """``least``: characters that the given group of a match needs, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of 24 and more are the runs that pass
)
EXTRA = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
)

#: A query is True (no trigram is mandatory), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


def _both(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if True in parts or not parts:
        return True
    need = [_leaves(p) if isinstance(p, str) or p[0] == "and" and all(isinstance(q, str) for q in p[1:]) else None for p in parts]
    parts = [p for p, n in zip(parts, need, strict=True) if n is None or not any(m is not None and m < n for m in need)]  # a weaker alternative implies it
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _grams(strings: frozenset[str]) -> Query:
    return _any([_both([s[k : k + 3] for k in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(op, arg) -> frozenset[str] | None:
    """All lower-cased strings that an item matches, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return frozenset([chr(arg).lower()])
    if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
        return frozenset(chr(a).lower() for _, a in arg)
    if name == "SUBPATTERN":
        return _sequence(arg[-1])
    if name == "BRANCH":
        found = [_sequence(x) for x in arg[1]]
        return frozenset().union(*found) if None not in found else None
    if name == "MAX_REPEAT" and (arg[0], arg[1]) == (0, 1) and (one := _sequence(arg[2])) is not None:
        return one | {""}
    if name == "MAX_REPEAT" and arg[0] == arg[1] and (one := _sequence(arg[2])) is not None and len(one) == 1:
        return frozenset([next(iter(one)) * arg[0]])
    return None


def _sequence(items) -> frozenset[str] | None:
    found = frozenset([""])
    for op, arg in items:
        if (some := _strings(op, arg)) is None or len(found) * len(some) > 64:
            return None
        found = frozenset(a + b for a, b in product(found, some))
    return found


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-cased trigrams that every text with a match satisfies."""

    def walk(items) -> Query:
        parts, run = [], frozenset([""])
        for op, arg in items:
            some = _strings(op, arg)
            if some is not None and len(run) * len(some) <= 64:
                run = frozenset(a + b for a, b in product(run, some))
                continue
            parts.append(_grams(run))
            run = some if some is not None else frozenset([""])
            if some is None and str(op) == "SUBPATTERN":
                parts.append(walk(arg[-1]))
            elif some is None and str(op) == "BRANCH":
                parts.append(_any([walk(x) for x in arg[1]]))
            elif some is None and str(op) == "MAX_REPEAT" and arg[0] > 0:
                parts.append(walk(arg[2]))
        return _both([*parts, _grams(run)])

    return walk(parse(pattern))


def _leaves(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_leaves, query[1:]))


def _holds(query: Query, grams: Column) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(grams, query)
    parts = [_holds(q, grams) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if query[0] == "and" else (out | p)
    return out


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index (gram, key) of the distinct texts in column ``text``, for these trigrams."""
    low = texts.select(F.xxhash64("text").alias("key"), F.lower("text").alias("low"))
    present = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    return low.select("key", F.explode(present).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (key, rules): for each text, the rules whose query its postings satisfy."""
    kinds = F.filter(F.array(*[F.when(_holds(q, F.col("grams")), F.lit(r.kind)) for r in rules if (q := trigram_query(r.pattern)) is not True]), lambda k: k.isNotNull())
    met = index.groupBy("key").agg(F.collect_set("gram").alias("grams"))  # a set of at most all trigrams of the rules
    return met.select("key", kinds.alias("rules")).filter(F.size("rules") > 0)


def _spans(text: Column, order: int, rule: Rule) -> Column:
    """Spans of one rule in one text: the pieces between matches and the matches give the positions."""
    pattern = F.lit(rule.pattern)
    pieces, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    kind = "struct<start:int,order:int,kind:string,end:int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("found"))

    def step(so_far: Column, x: Column) -> Column:
        begin = so_far["at"] + F.length(x["pieces"])
        end = begin + F.length(x["hits"])
        new = F.array(F.struct(begin.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end")).cast(kind))
        return F.struct(end.alias("at"), F.when(F.length(x["tested"]) >= rule.least, F.concat(so_far["found"], new)).otherwise(so_far["found"]).alias("found"))

    rows = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)).alias("pieces"), hits.alias("hits"), tested.alias("tested"))
    return F.aggregate(rows, start, step, lambda a: a["found"])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, an array of (start, order, kind, end) by start and rule."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted(set().union(*map(_leaves, queries.values())))
    found = candidates(postings(rows, grams), rules).withColumnRenamed("key", "_key")
    joined = rows.withColumn("key", F.xxhash64("text")).join(found, F.col("key") == F.col("_key"), "left")
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    parts = []
    for k, rule in enumerate(rules):
        test = F.col("text").rlike(rule.pattern) if queries[rule.kind] is True else F.coalesce(F.array_contains("rules", rule.kind), F.lit(False))
        parts.append(F.when(test, _spans(F.col("text"), k, rule)).otherwise(none))
    return joined.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 over the base spans, and all spans as text."""
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return secret_scan(docs).select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def _oracle() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    lists = ",\n".join(f"string_split_regex(t, {quoted(r.pattern)}) AS p{k}, regexp_extract_all(t, {quoted(r.pattern)}) AS m{k}, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g{k}" for k, r in enumerate(BASE + EXTRA))
    one = lambda k, r: f"list_filter(list_transform(range(len(m{k})), lambda i: {{'s': list_sum(list_transform(p{k}[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m{k}[1:i], lambda x: length(x))), 0), 'o': {k}, 'k': '{r.kind}', 'n': length(m{k}[i + 1]), 'ok': length(g{k}[i + 1]) >= {r.least}}}), lambda x: x.ok)"
    every = "list_sort(" + " || ".join(one(k, r) for k, r in enumerate(BASE + EXTRA)) + ")"
    shown = "array_to_string(list_transform({}, lambda x: x.k || ':' || x.s || ':' || (x.s + x.n)), ',')"
    counts = ", ".join(f"len(list_filter(spans, lambda x: x.o = {k}))::BIGINT AS n_{r.kind}" for k, r in enumerate(BASE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, {lists} FROM d),
spans AS (SELECT doc_id, {every} AS spans FROM found)
SELECT doc_id, {counts}, sha256(coalesce({shown.format(f"list_filter(spans, lambda x: x.o < {len(BASE)})")}, '')) AS base_sha256,
       coalesce({shown.format("spans")}, '') AS spans
FROM spans
"""


ORACLE_SQL = _oracle()
