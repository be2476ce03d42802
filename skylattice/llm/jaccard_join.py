"""N-gram Jaccard self-join of documents, by set-relation skipping (operator 9).

A document's set holds its distinct word shingles.  Two documents link when
``100 * intersection >= percent * union``.

1. *Classes.*  Documents with equal sets form one class; only its smallest id goes on.  Thousands of
   copies therefore cost one row each and no pair.
2. *Index lists.*  Either way linked sets share l entries or more.  Each set may then leave out its l - 1 most popular entries: the least
   popular of the shared ones is among what both sets keep, so no link is lost, while a passage that many documents share leaves the index.

   - *By part*, from 85 percent on.  Hashes are cut into d + l ranges, where d is what linked sets of that size may differ in at most: l ranges
     hold the same shingles in both.  An entry is all shingles of a range, six to nine at 90 percent, so common phrases that recur by chance
     chain nothing.  The number of ranges follows the larger set: sizes have levels, and a set that may link with one of the next level
     enters the index for that level too.
   - *By position*, below.  Shingles stand in the order of their hashes.  Linked sets of about n shingles share the first
     l of their common shingles within their first n - ceil(t n) + l positions, so only these enter the index.
3. *Candidate clusters.*  Lists are chained through their smallest member instead of being expanded
   into pairs; the components of these chains are clusters no link can leave.
4. *Answers in blocks.*  A cluster is cut into blocks by size band and hash, each of bounded size; block
   pairs whose sizes cannot match are never formed.  Inside a pair of blocks, index lists are kept in
   order of set size so that all positions outside the admissible sizes are skipped, and a set's
   overlap counts are derived from those of the set before it by visiting only the lists of shingles
   in which the two differ.  Each task returns at most one link per set, which keeps its components.
5. Components over those links give the result.

Equal sets are told by their size and two independent sums of 64 bits; shingles in a block by one hash of 64 bits.

Nulls and empty texts have empty sets: 0 shingles, linked with nothing.  Rows with a null id are
returned with a null component and link with nothing.  Rows that repeat an id are answered one by one, each by its own
text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .textops import list_array, mix, own_columns, run_hashes, signed, small_batches, spare_names, stored, texts_of, WORD, Words

#: Shingles in one block of a cluster.  A task compares two blocks and works on some twenty arrays of eight bytes a shingle: about 80 MB.
BLOCK_SHINGLES = 1 << 18


def shingle_sets(texts: pa.Array, words: int, twice: bool = False) -> tuple[np.ndarray, ...]:
    """Per text, its distinct shingle hashes in ascending order: (hashes, number of them per text), and ``twice`` a second,
    independent hash of each of them."""
    w = Words(texts, lower=True)
    start, owner = w.owners(words)
    short = np.flatnonzero((w.counts > 0) & (w.counts < words))

    words_hashed = w.several((1, 2) if twice else (1,))

    def all_hashes(seed: int) -> np.ndarray:
        h = words_hashed[seed]
        return np.concatenate([run_hashes(h, start, words, seed), run_hashes(h, w.first[short], w.counts[short], seed)])

    got, owner = all_hashes(0), np.concatenate([owner, short])
    order = np.lexsort((got, owner))
    got, owner = got[order], owner[order]
    fresh = np.ones(len(got), bool)
    fresh[1:] = (got[1:] != got[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[fresh], minlength=len(w.counts)).astype(np.int64)
    return (got[fresh], counts, all_hashes(1)[order][fresh]) if twice else (got[fresh], counts)


def band_edges(percent: int, upto: int = 1 << 31) -> np.ndarray:
    """Smallest size of each band; linked sets lie in the same band or in neighbouring ones."""
    edges = [1]
    while edges[-1] <= upto:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
    return np.array(edges, np.int64)


def slack(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many shared shingles beyond one the index prefix holds: a share of the set, half of what linked sets may lack."""
    return sizes * (100 - percent) // 200


def prefix_lengths(sizes: np.ndarray, percent: int) -> np.ndarray:
    least = -(-sizes * percent // 100)
    return np.where(sizes > 0, sizes - least + 1 + slack(sizes, percent), 0)


def droppable(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Popular entries that a set may leave out: no more than the smallest set it may link with holds beyond one."""
    return slack(-(-sizes * percent // 100), percent)


#: From this percentage on the index holds parts of sets; below it parts would be too small to tell sets apart.
BY_PART = 85


def levels(percent: int, upto: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each level of sizes: the smallest size, the number of parts that a set is cut into, and how many of them it may leave out.

    Linked sets of a and b shingles differ in (a + b) (100 - percent) / (100 + percent) at most.  Levels whose sets link with equal ones only have no parts.
    """
    edges = [1]
    while edges[-1] <= upto:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
    edges = np.array(edges, np.int64)
    differ = 2 * (edges[1:] - 1) * (100 - percent) // (100 + percent)
    spare = differ // 16
    return edges[:-1], np.where(differ > 0, differ + spare + 1, 0), spare


def levels_of(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, level) for every level of a set that it may link with, and its own, in order of both."""
    edges = levels(percent)[0]
    low = np.searchsorted(edges, sizes, "right") - 1
    n = np.where(sizes > 0, np.searchsorted(edges, sizes * 100 // percent, "right") - low, 0)
    return np.repeat(np.arange(len(sizes)), n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def index_keys(hashes: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the index for sets as from ``shingle_sets``: (keys, number of them per set)."""
    if percent < BY_PART:
        n = prefix_lengths(counts, percent)
        at = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
        return hashes[at < np.repeat(n, counts)], n
    owner, level = levels_of(counts, percent)
    parts = levels(percent)[1][level]
    n = np.bincount(owner, weights=parts, minlength=len(counts)).astype(np.int64)
    owner, level, parts = owner[parts > 0], level[parts > 0], parts[parts > 0]
    bounds, first = np.concatenate([[0], np.cumsum(counts)]), np.cumsum(parts) - parts
    h = _gather(bounds, hashes, owner)
    per = counts[owner]
    range_of = ((h >> np.uint64(32)) * np.repeat(parts, per).astype(np.uint64) >> np.uint64(32)).astype(np.int64)  # ascending, as the hashes are
    ends = np.cumsum(np.bincount(np.repeat(first, per) + range_of, minlength=int(parts.sum())))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h))])[np.concatenate([[0], ends])]
    place = np.repeat(level << 32, parts) + np.arange(len(ends)) - np.repeat(first, parts)
    return mix(np.diff(total) + mix(place.astype(np.uint64) + np.uint64(1))), n


def may_drop(counts: np.ndarray, percent: int) -> np.ndarray:
    """For each entry of ``index_keys``, how many of its set (by parts: of its set and level) may stay out."""
    if percent < BY_PART:
        return np.repeat(droppable(counts, percent), prefix_lengths(counts, percent))
    _, parts, spare = levels(percent)
    level = levels_of(counts, percent)[1]
    return np.repeat(spare[level], parts[level])


def digests(counts: np.ndarray, *hashes: np.ndarray) -> list[np.ndarray]:
    """Sums of 64 bits, one for each kind of hash, that with its size stand for each set."""
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return [signed(np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h))])[bounds])) for h in hashes]


def _summaries(words: int, percent: int):
    edges = band_edges(percent)
    fields = [("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("band", pa.int32()), ("keys", pa.list_(pa.int64()))]
    schema = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            hashes, counts, others = shingle_sets(batch.column("text"), words, twice=True)
            keys, n = index_keys(hashes, counts, percent)
            band = pa.array(np.searchsorted(edges, counts, "right") - 1, pa.int32())
            d1, d2 = digests(counts, hashes, others)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "t1", "t2")), pa.array(counts), pa.array(d1), pa.array(d2), band, list_array(signed(keys), n, pa.int64())], schema=schema)

    return run, "doc_id long, t1 long, t2 long, n_shingles long, d1 long, d2 long, band int, keys array<long>"


class Block:
    """Sets of one task in order of size, as tokens numbered from the rarest here, with index lists by token.

    ``starts``/``holders`` list the sets that hold each token, ``prefix_starts``/``prefix_holders`` those that hold it among
    the rarest tokens of which linked sets must share one.  Shingles that one set alone holds are not tokens.
    """

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], percent: int):
        order = np.lexsort((ids, [len(s) for s in sets]))
        self.ids = ids[order]
        self.sizes = np.array([len(s) for s in sets], np.int64)[order]
        flat = np.concatenate([sets[k] for k in order])
        owner = np.repeat(np.arange(len(order)), self.sizes)
        _, inverse, held = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(held), np.int64)
        by_count = np.argsort(held, kind="stable")
        alone = int((held == 1).sum())
        rank[by_count] = np.arange(len(held)) - alone
        token = rank[inverse]
        owner, token = owner[token >= 0], token[token >= 0]
        by = np.lexsort((token, owner))
        self.owner, self.token = owner[by], token[by]
        self.n = np.bincount(owner, minlength=len(order))
        self.cut = np.concatenate([[0], np.cumsum(self.n)])
        tokens = len(held) - alone
        spare = self.sizes - self.n  # shingles of its own come first in every order by rarity
        self.prefix = np.clip(self.sizes - -(-self.sizes * percent // 100) + 1 - spare, 0, self.n)
        lists = lambda t, o: (np.searchsorted(t[k := np.lexsort((o, t))], np.arange(tokens + 1)), o[k])
        self.starts, self.holders = lists(self.token, self.owner)
        leading = np.arange(len(self.token)) - self.cut[self.owner] < self.prefix[self.owner]
        self.prefix_starts, self.prefix_holders = lists(self.token[leading], self.owner[leading])

    def tokens(self, x: int) -> np.ndarray:
        return self.token[self.cut[x] : self.cut[x + 1]]


def _gather(starts: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The entries of several lists, one after the other."""
    n = starts[rows + 1] - starts[rows]
    return values[np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def linked_blocks(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links (id, id) that keep the components of all links among these sets.

    Sets run in order of size, and every set looks back at the positions of admissible sizes only.  Its overlaps come the
    cheapest of three ways: from the lists of its rarest tokens, counting only the sets found there; from
    the overlaps of the set before it, visiting only the lists of tokens in which the two differ; or from all its lists.
    """
    b = Block(ids, sets, percent)
    m = len(b.sizes)
    length, leading = np.diff(b.starts), np.diff(b.prefix_starts)
    parent = np.arange(m)
    mark = np.zeros(len(length), bool)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def visit(tokens: np.ndarray) -> np.ndarray:
        return np.bincount(_gather(b.starts, b.holders, tokens), minlength=m)

    counts, before = None, None  # overlaps of an earlier set with all sets, and its tokens
    for x in range(m):
        own, n = b.tokens(x), b.sizes[x]
        first = int(np.searchsorted(b.sizes, -(-n * percent // 100)))
        if first >= x or not b.prefix[x]:
            continue
        rare = own[: b.prefix[x]]
        ways = [int(leading[rare].sum() * n), int(length[own].sum()), 1 << 62]
        if counts is not None:
            more, less = np.setdiff1d(own, before, assume_unique=True), np.setdiff1d(before, own, assume_unique=True)
            ways[2] = int(length[more].sum() + length[less].sum())
        if min(ways) == ways[0]:
            near = np.unique(_gather(b.prefix_starts, b.prefix_holders, rare))
            near = near[(near >= first) & (near < x)]
            mark[own] = True
            inter = np.bincount(np.repeat(np.arange(len(near)), b.n[near]), weights=mark[_gather(b.cut, b.token, near)], minlength=len(near)).astype(np.int64)
            mark[own] = False
        else:
            counts = visit(own) if min(ways) == ways[1] else counts + visit(more) - visit(less)
            before = own
            near, inter = np.arange(first, x), counts[first:x]
        for y in near[100 * inter >= percent * (b.sizes[near] + n - inter)].tolist():
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                yield int(b.ids[x]), int(b.ids[y])


def _links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        column = table.column("shingles").combine_chunks()
        values, bounds = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
        pairs = list(linked_blocks(table.column("node").to_numpy(), [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], percent))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _sets(words: int):
    """The sets of candidate classes, once for each pair of blocks that compares them."""
    schema = pa.schema([("cluster", pa.int64()), ("pair", pa.string()), ("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            hashes, counts = shingle_sets(batch.column("text"), words)
            lists = list_array(signed(hashes), counts, pa.int64())
            pairs = batch.column("pairs")
            rows, names = pa.array(np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy(zero_copy_only=False))), pairs.flatten()
            for at in range(0, len(rows), 256):
                some = rows.slice(at, 256)
                yield pa.RecordBatch.from_arrays([batch.column("cluster").take(some), names.slice(at, 256), batch.column("node").take(some), lists.take(some)], schema=schema)

    return run, "cluster long, pair string, node long, shingles array<long>"


_ENTRIES = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("drop", pa.int64()), ("more", pa.list_(pa.struct([("node", pa.int64()), ("drop", pa.int64())])))])


def _entries(percent: int):
    """Index entries of a batch of classes: one row a key, so that a popular one is as many rows as there are batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per = batch.column("keys").value_lengths().to_numpy(zero_copy_only=False)
            key = batch.column("keys").flatten().to_numpy()
            order = np.argsort(key, kind="stable")
            node = np.repeat(batch.column("node").to_numpy(), per)[order]
            drop = may_drop(batch.column("n_shingles").to_numpy(), percent)[order]
            key = key[order]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(head)
            rest = pa.StructArray.from_arrays([pa.array(node[~head]), pa.array(drop[~head])], names=["node", "drop"])
            extra = np.diff(np.append(first, len(key))) - 1
            more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(extra)]).astype(np.int32)), rest)
            yield pa.RecordBatch.from_arrays([pa.array(key[head]), pa.array(node[head]), pa.array(drop[head]), more], schema=_ENTRIES)

    return run, "key long, node long, drop long, more array<struct<node:long,drop:long>>"


def clusters(classes: DataFrame, percent: int) -> DataFrame:
    """Rows (node, component) of candidate clusters: chains through the smallest member of each index list."""
    run, schema = _entries(percent)
    lists = classes.select("node", "n_shingles", "keys").mapInArrow(run, schema)
    lists = lists.withColumn("n", F.sum(F.size("more") + 1).over(Window.partitionBy("key"))).filter("n > 1")
    one = F.array(F.struct("node", "drop"))
    entries = lists.select("key", "n", F.explode(F.concat(one, "more")).alias("e")).select("key", "n", "e.node", "e.drop")
    # at most the entries of one set; its levels, where as many may stay out in two of them, count as one: fewer stay out
    popular = F.row_number().over(Window.partitionBy("node", "drop").orderBy(F.desc("n"), "key"))
    kept = stored(entries.withColumn("rank", popular).filter("rank > drop").select("key", "node"), "entries")
    heads = kept.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1").select("key", "head")
    chains = kept.join(heads, "key").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    return components(chains)


def _placed(members: DataFrame) -> DataFrame:
    """Each candidate class with the pairs of blocks of its cluster that it takes part in."""
    whole = members.groupBy("cluster").agg(F.sum("n_shingles").alias("all"))
    sized = members.groupBy("cluster", "band").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    blocks = sized.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))  # at most one entry a band
    band = F.col("band")
    within = lambda k: F.coalesce(F.col("blocks")[k], F.lit(0))
    slot = F.pmod(F.xxhash64("node"), within(band)).cast("int")
    each = lambda k, named: F.when(within(k) > 0, F.transform(F.sequence(F.lit(0), within(k) - 1), named)).otherwise(F.array().cast("array<string>"))
    split = F.concat(
        each(band, lambda j: F.concat_ws("-", band, F.least(j, slot), band, F.greatest(j, slot))),
        each(band + 1, lambda j: F.concat_ws("-", band, slot, band + 1, j)),
        each(band - 1, lambda j: F.concat_ws("-", band - 1, j, band, slot)),
    )
    return members.join(whole, "cluster").join(blocks, "cluster").select(*_ROW, "node", "cluster", F.when(F.col("all") <= BLOCK_SHINGLES, F.array(F.lit("all"))).otherwise(split).alias("pairs"))


#: A row of the input by its id and two independent hashes of its text, so that rows that repeat an id stay apart.
_ROW = ("doc_id", "t1", "t2")


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2"), "text")


def _answers(source: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows (doc_id, t1, t2, n_shingles, class, component): the first rows, as structs of id and text hashes, with an equal set and within reach.
    Both are null for empty sets and null ids."""
    source = _marked(source)
    run, schema = _summaries(words, percent)
    rows = stored(source.mapInArrow(run, schema), "sets")
    grouped = rows.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("n_shingles", "d1", "d2")
    first = F.min(F.struct(*_ROW)).alias("class")
    node = F.xxhash64("d1", "d2", "n_shingles").alias("node")
    classes = stored(grouped.agg(first, F.any_value("band").alias("band")).select("n_shingles", "d1", "d2", "class", "class.*", "band", node), "classes")
    cluster = clusters(grouped.agg(F.any_value("keys").alias("keys")).select(node, "n_shingles", "keys"), percent).withColumnRenamed("component", "cluster")
    members = stored(classes.join(cluster, "node"), "members")
    run, schema = _sets(words)
    sets = source.join(_placed(members), list(_ROW)).mapInArrow(run, schema)
    reach = components(sets.groupBy("cluster", "pair").applyInArrow(_links(percent), "a long, b long"))
    linked = members.join(reach, "node")
    heads = linked.groupBy("component").agg(F.min("class").alias("head"))
    linked = linked.join(heads, "component").select("n_shingles", "d1", "d2", "head")
    answer = classes.select("n_shingles", "d1", "d2", "class").join(linked, ["n_shingles", "d1", "d2"], "left")
    answer = answer.select("n_shingles", "d1", "d2", "class", F.coalesce("head", "class").alias("component"))
    known = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    return rows.drop("keys").join(answer, ["n_shingles", "d1", "d2"], "left").select(*_ROW, "n_shingles", known("class"), known("component"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links), class_id
    (smallest id with an equal set).  See the module for nulls, empty texts and repeated ids."""
    out = _answers(texts_of(docs, id_col, text_col), words, percent)
    return out.select("doc_id", "n_shingles", F.coalesce("component.doc_id", "doc_id").alias("component_id"), F.coalesce("class.doc_id", "doc_id").alias("class_id"))


def drop_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that stand for their component: one row each, that of the smallest id.

    Of rows that repeat that id within one component, the one whose text comes first by its hashes stays; rows that repeat an
    id but belong to other components are decided there.  Of rows equal in id and text, the first by all its columns as JSON stays.
    Rows without words or id link with nothing and stay.
    """
    t1, t2, a, b, doc = spare_names(docs, "t1", "t2", "head_t1", "head_t2", "of_doc")
    heads = _answers(texts_of(docs, "doc_id", "text"), words, percent).filter(F.col("class").isNotNull() & (F.col("component") == F.struct(*_ROW)))
    heads = heads.select(F.col("doc_id").alias(doc), F.col("t1").alias(a), F.col("t2").alias(b)).distinct()
    text = F.col("text").cast("string")
    blank = ~F.coalesce(text, F.lit("")).rlike(WORD)
    loose = docs.filter(blank | F.col("doc_id").isNull())
    own = docs.filter(~blank & F.col("doc_id").isNotNull()).withColumns({t1: F.xxhash64(F.lit(1), text), t2: F.xxhash64(F.lit(2), text)})
    own = own.join(heads, (F.col("doc_id").cast("long") == F.col(doc)) & (F.col(t1) == F.col(a)) & (F.col(t2) == F.col(b)), "left_semi")
    columns = own_columns(docs)
    row = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(columns)])  # of any types: as JSON they have an order
    first = own.groupBy("doc_id", t1, t2).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return first.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)]).union(loose)
