"""Toxicity from the nearest labelled examples (operator 4): exact TF-IDF cosine over a block-max index of all their terms.

Terms are lower-cased words and, of longer ones, their first five bytes.  The examples are a bounded sample of labelled
rows (``most``, a parameter); all terms of all of them make the space.  Inverse document frequencies are counted over all
documents.  Terms whose presence speaks for the label in the sample (chi-square and share) weigh ``stress`` times as much, so the cosine is
exact in a space that the labels have weighted (plain TF-IDF at ``stress`` 1); no other term is left out.

Examples are ordered so that each block holds alike ones: by cluster, then by length.  A term that is common in a block, and common
enough among all examples that many queries have it, is a row of the block's matrix and has a maximum there; all other postings stand
in inverted lists.  A query is first scored by the
lists.  A block's bound is its best score so far plus the query against the block's maxima: blocks are visited from the largest
bound on, and those whose bound stays below the k-th best score are skipped.  The nearest are scored once more in double
precision, so the neighbours are exact.

A score is the distance-weighted share of toxic neighbours, drawn towards the base rate, and then calibrated on the
examples themselves, each scored without itself.  Evidence names the neighbours.  Texts without any term of the
space (null and empty texts too) get the share of toxic examples among examples like them.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property
from hashlib import sha1

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labels import held_out, training_sample
from .textops import Words, list_array, mix, signed, small_batches, texts_of

PREFIXES = (5,)
COMMON = 0.1  #: terms in more than this share of the examples tell which of them are alike
DENSE, LEAST = 0.0025, 0.07  #: a term is a row of a block's matrix if its shares of the block and of all examples multiply to more than this, and that of the block is more than that; the result is the same for any values
BLOCK = 512  #: examples of a block at most
CLUSTERS = 32
QUERIES = 640  #: queries of a group at most
FEW = 32
LANE = 8  #: postings of a list that are copied at once
REMEMBERED = 4096  #: texts whose answers a task keeps for copies that follow
_LOG = 1 + np.log(np.maximum(np.arange(1 << 16), 1))


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Terms of all texts with repeats: (hashes, text numbers)."""
    w = Words(texts, lower=True)
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    whole, *cut = w.prefixes((None, *PREFIXES))
    hashes, owners = [whole], [text]
    length = w.ends - w.starts
    for k, hashed in zip(PREFIXES, cut, strict=True):
        longer = length > k
        hashes.append(mix(hashed[longer] + np.uint64(k)))
        owners.append(text[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def positions(vocabulary: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash stands in the sorted vocabulary, and whether it does: a look at the place that its leading bits name, then a few to the right."""
    bits = max(1, int(len(vocabulary)).bit_length())
    first = _first_of(vocabulary, bits)
    lead = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    at, end = first[lead], first[lead + 1]
    hit = vocabulary[np.minimum(at, len(vocabulary) - 1)] == hashes  # where no hash has these bits, another one stands there
    ask = np.flatnonzero(~hit & (at + 1 < end))
    while len(ask):
        at[ask] += 1
        found = vocabulary[at[ask]] == hashes[ask]
        hit[ask[found]] = True
        ask = ask[~found]
        ask = ask[at[ask] + 1 < end[ask]]
    return at, hit


_FIRST: list = [None, None]


def _first_of(vocabulary: np.ndarray, bits: int) -> np.ndarray:
    """The first place of each value of the leading bits; the last table is kept."""
    if _FIRST[0] is not vocabulary:
        _FIRST[:] = vocabulary, np.searchsorted(vocabulary >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
    return _FIRST[1]


def term_counts(texts: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of the terms of a sorted vocabulary: (text number, term number, count), by text and term; 65,535 stands for more."""
    hashes, owners = term_hashes(texts)
    if not len(vocabulary) or not len(hashes):
        return (np.empty(0, np.int64),) * 3
    at, hit = positions(vocabulary, hashes)
    pair, count = np.unique(owners[hit] * len(vocabulary) + at[hit], return_counts=True)
    return pair // len(vocabulary), pair % len(vocabulary), np.minimum(count, len(_LOG) - 1)


class Lists:
    """Postings by term.  Those of a list of ``LANE`` or more fill lanes, the last one with zeros, so that a lane is copied and weighed at once; those of shorter lists follow one by one."""

    def __init__(self, size: np.ndarray):
        lanes, few = np.where(size < LANE, 0, -(-size // LANE)), np.where(size < LANE, size, 0)
        whole, n = LANE * int(lanes.sum()), int(few.sum())
        # each term's first posting, its lanes and its single postings: side by side, as terms are looked up at random
        self.places = np.stack([np.where(size < LANE, whole + np.cumsum(few) - few, LANE * (np.cumsum(lanes) - lanes)), lanes, few], axis=1)
        self.owner, self.weight = np.zeros(whole + n, np.int32), np.zeros(whole + n, np.float32)
        self.owners, self.weights = self.owner[:whole].reshape(-1, LANE), self.weight[:whole].reshape(-1, LANE)
        self.filled = np.zeros(len(size), np.int32)

    def add(self, term: np.ndarray, owner: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(term, kind="stable")
        term = term[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        own, n = term[first], np.diff(first, append=len(term))
        x, _ = spans(self.places[own, 0] + self.filled[own], n)
        self.owner[x], self.weight[x] = owner[order], weight[order]
        self.filled[own] += n.astype(np.int32)

    def sums(self, term: np.ndarray, query: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        """Scores of all examples (columns of ``out``) by the lists, for each of the queries ``at[i]:at[i + 1]``."""
        first, n, few = (np.ascontiguousarray(x) for x in self.places.take(term, axis=0).T)
        lane, times = first // LANE, np.repeat(query.astype(np.float32), LANE).reshape(-1, LANE)
        for i, (lo, hi) in enumerate(itertools.pairwise(at.tolist())):
            x, _ = spans(lane[lo:hi], n[lo:hi])
            weight = self.weights.take(x, axis=0)
            weight *= np.repeat(times[lo:hi], n[lo:hi], axis=0)
            out[i] = np.bincount(self.owners.take(x, axis=0).ravel(), weights=weight.ravel(), minlength=out.shape[1])
        x, _ = spans(first, few)
        who = np.repeat(np.repeat(np.arange(len(out)) * out.shape[1], np.diff(at)), few)
        np.add.at(out.reshape(-1), who + self.owner[x], self.weight[x] * np.repeat(times[:, 0], few))


@dataclass
class Index:
    """Examples as TF-IDF vectors of unit length, example by example; the lists by term are made where they are used."""

    vocabulary: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    begin: np.ndarray  # of each example's terms
    term: np.ndarray
    count: np.ndarray
    edges: np.ndarray  # first example of each block
    spare: np.ndarray  # examples that follow ``neighbours`` + 1 equal ones: never among the nearest, as ties go by id
    prior: float
    without: float  # score of texts without any term
    neighbours: int = 15
    visited: int = 0  # pairs of a query and a block: scored in full, and all
    asked: int = 0

    def __getstate__(self) -> dict:
        """Packed for the way to the executors: steps between terms, byte by byte, are mostly small."""
        steps = np.diff(self.term, prepend=np.int32(0)).view(np.uint8).reshape(-1, 4)
        packed = {"term": [zlib.compress(steps[:, k].tobytes(), 1) for k in range(4)], "count": (self.count.dtype.str, zlib.compress(self.count.tobytes(), 1)), "idf": zlib.compress(self.idf.astype(float).tobytes(), 1)}
        return {f.name: getattr(self, f.name) for f in fields(self)} | packed

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        steps = np.stack([np.frombuffer(zlib.decompress(x), np.uint8) for x in state["term"]], axis=1)
        self.term = np.cumsum(steps.view(np.int32).ravel(), dtype=np.int32)
        kind, packed = state["count"]
        self.count, self.idf = np.frombuffer(zlib.decompress(packed), kind), np.frombuffer(zlib.decompress(state["idf"]))

    def vectors(self, text: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = _LOG[counts] * self.idf[terms]
        return v / np.sqrt(np.bincount(text, weights=v * v))[text] if len(v) else v

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vectors(np.zeros(len(terms), np.int64), terms, counts)

    def slices(self) -> Iterator[tuple[slice, np.ndarray]]:
        """The postings of 500 examples at a time, and their examples."""
        for k in range(0, len(self.ids), 500):
            edge = self.begin[k : k + 501]
            yield slice(edge[0], edge[-1]), np.repeat(np.arange(k, k + len(edge) - 1, dtype=np.int32), np.diff(edge))

    @cached_property
    def norm(self) -> np.ndarray:
        """Length of each example's vector before it is scaled."""
        out = np.empty(len(self.ids))
        for part, owner in self.slices():
            v = _LOG[self.count[part]] * self.idf[self.term[part]]
            out[owner.min(initial=len(self.ids)) : owner.max(initial=-1) + 1] = np.sqrt(np.bincount(owner - owner.min(initial=len(self.ids)), weights=v * v))
        return out

    def weights(self, examples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The postings of some examples: terms, weights, and how many each has."""
        x, n = spans(self.begin[examples], np.diff(self.begin)[examples])
        return self.term[x], _LOG[self.count[x]] * self.idf[self.term[x]] / np.repeat(self.norm[examples], n), n

    @cached_property
    def blocks(self) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], Lists]:
        """Number of each term that is common somewhere (-1: nowhere), each block's maxima by these, each block's numbers and matrix,
        and the lists of all other postings."""
        edge = np.append(self.edges, len(self.ids))
        common, held = [], np.zeros(len(self.idf), np.int64)
        # a list costs each query that has the term its postings, a row costs every query of the block its examples: by the share of queries that have it
        asked = np.bincount(self.term, minlength=len(self.idf)) / max(len(self.ids), 1)
        for k in range(len(self.edges)):
            n = np.bincount(self.term[self.begin[edge[k]] : self.begin[edge[k + 1]]], minlength=len(self.idf))
            share = n / (edge[k + 1] - edge[k])
            common.append(np.flatnonzero((share > LEAST) & (share * asked > DENSE)))
            n[common[-1]] = 0
            held += n
        every = np.unique(np.concatenate([np.empty(0, np.int64), *common]))
        row = np.full(len(self.idf), -1, np.int32)
        row[every] = np.arange(len(every))
        most = np.zeros((len(self.edges), len(every)), np.float32)
        lists, parts, place = Lists(held), [], np.full(len(self.idf), -1, np.int32)
        for k in range(len(self.edges)):
            term, weight, n = self.weights(np.arange(edge[k], edge[k + 1]))
            owner = np.repeat(np.arange(edge[k], edge[k + 1], dtype=np.int32), n)
            place[common[k]] = np.arange(len(common[k]))
            at = place[term]
            place[common[k]] = -1
            near = at >= 0
            dense = np.zeros((edge[k + 1] - edge[k], len(common[k])), np.float32)
            dense[owner[near] - edge[k], at[near]] = weight[near]
            parts.append((row[common[k]].astype(np.int64), dense))
            most[k, row[common[k]]] = dense.max(0, initial=0)
            lists.add(term[~near], owner[~near], weight[~near])
        return row, most, parts, lists

    def nearest(self, terms: np.ndarray, query: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine, by (cosine, id): exact."""
        return next(self.all_nearest(terms, query, np.array([0, len(terms)]), k, np.array([skip])))

    def all_nearest(self, terms: np.ndarray, query: np.ndarray, cut: np.ndarray, k: int, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` for each of the queries ``cut[i]:cut[i + 1]``.

        Scores are single precision and never too large by more than the rounding error; all examples within twice that of
        the k-th are scored again in double precision.
        """
        row, most, parts, lists = self.blocks
        m = len(self.ids)
        full, asked = np.zeros(len(self.idf)), np.zeros(len(self.idf), bool)
        width = -(-m // FEW) * FEW
        edge = np.append(self.edges, m)
        groups = -(-(len(cut) - 1) // QUERIES)
        for g, upto in itertools.pairwise(np.linspace(0, len(cut) - 1, groups + 1).astype(np.int64).tolist()):
            at = cut[g : upto + 1]
            some, slack = len(at) - 1, 1.2e-7 * (np.diff(at) + 16)  # products are positive, sums at most 1
            t, q = terms[at[0] : at[-1]], query[at[0] : at[-1]]
            number = row[t]
            side = np.zeros((most.shape[1], some), np.float32)
            side[number[number >= 0], np.repeat(np.arange(some), np.diff(at))[number >= 0]] = q[number >= 0]
            scores = np.empty((some, width), np.float32)
            lists.sums(t, q, at - at[0], scores)
            scores[:, self.spare] = scores[:, m:] = -np.inf
            if skip is not None:
                scores[np.arange(some), skip[g : g + some]] = -np.inf
            top = np.maximum.reduceat(scores, self.edges, axis=1)
            bound = np.maximum(top, 0) + (most @ side).T
            todo, least = bound > 0, np.zeros(some)
            for fewest in (3, len(parts)):  # the blocks of largest bound first: they raise the k-th best score
                ahead = todo & (bound >= (least - 2 * slack)[:, None])
                if fewest < len(parts):
                    ahead &= bound >= -np.partition(-np.where(ahead, bound, 0), fewest - 1, axis=1)[:, fewest - 1 : fewest]
                todo &= ~ahead
                for b in np.flatnonzero(ahead.any(0)).tolist():
                    who, (rows, dense) = np.flatnonzero(ahead[:, b]), parts[b]
                    scores[who, edge[b] : edge[b + 1]] += side[rows[:, None], who].T @ dense.T
                self.visited += int(ahead.sum())
                if k < width // FEW:  # the k-th best of the bests of few examples is no more than the k-th best of all; alike ones stand in different groups
                    few = scores.reshape(some, FEW, -1).max(1)
                    least = np.maximum(np.partition(few, few.shape[1] - k, axis=1)[:, few.shape[1] - k], 0)
            self.asked += some * len(parts)
            floor = np.maximum(np.nextafter((least - 2 * slack).astype(np.float32), np.float32(-1)), np.nextafter(np.float32(0), np.float32(1)))
            for i in range(some):
                lo, hi = at[i] - at[0], at[i + 1] - at[0]
                near = np.flatnonzero(scores[i] >= floor[i])
                if len(near) > k:
                    score = scores[i, near]
                    near = near[score >= np.partition(score, len(near) - k)[len(near) - k] - 2 * slack[i]]
                full[t[lo:hi]], asked[t[lo:hi]] = q[lo:hi], True
                first, end = self.begin[near], self.begin[near + 1]
                term = np.concatenate([self.term[:0], *(self.term[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True))])
                hit, upto = np.flatnonzero(asked[term]), np.cumsum(end - first)
                owner_of = np.repeat(np.arange(len(near)), np.diff(np.searchsorted(hit, np.append(0, upto))))
                term, count = term[hit], self.count[hit + (end - upto)[owner_of]]
                by = np.bincount(owner_of, weights=full[term] * (_LOG[count] * self.idf[term]), minlength=len(near))
                by = np.round(by / self.norm[near], 12)
                asked[t[lo:hi]] = False
                best = np.lexsort((self.ids[near], -by))[:k]
                best = best[by[best] > 0]
                yield near[best], by[best]

    def vote(self, near: np.ndarray, by: np.ndarray) -> float:
        return float(((by * self.labels[near]).sum() + self.prior) / (by.sum() + 1))


def spans(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all slices ``first:first + n``, one after the other, and their lengths."""
    upto = np.cumsum(n)
    return np.repeat(first - upto + n, n) + np.arange(upto[-1] if len(n) else 0), n


def _calibration(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of labels on raw scores: pooled neighbours, softened towards the middle."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum of scores, sum of labels, rows
    for x, t in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        pools.append([x, t, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def chi_square(with_1: np.ndarray, with_any: np.ndarray, n1: int, n: int) -> np.ndarray:
    """Dependence of presence and label, from counts of rows."""
    a, b = with_1, with_any - with_1
    c, d = n1 - a, (n - n1) - b
    return n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1)


def build(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 20000, terms: int = 2048, least: float = 20.0, rows: int = 4, lift: float = 3.0, stress: float = 10.0) -> Index:
    """The index over at most ``most`` examples and every term that one of them has.

    At most ``terms`` terms weigh ``stress`` times as much: chi-square ``least`` or more, in ``rows`` examples or more, and with a share
    of label 1 of ``lift`` times the base rate or more.  The driver holds the terms of all examples: bounded by ``most`` texts.
    Labels of one kind make no space: every neighbour says the same.
    """
    context = docs.sparkSession.sparkContext
    sample = training_sample(docs, labels, label, most).persist()
    n, n1 = (int(x or 0) for x in sample.agg(F.count("*"), F.sum("label")).first())
    prior = (n1 + 0.5) / (n + 1)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            hashes, owners = term_hashes(batch.column("text"))
            order = np.lexsort((owners, hashes))
            h, o = hashes[order], owners[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            h, y = h[fresh], batch.column("label").to_numpy()[o[fresh]]
            term, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_pydict({"term": signed(term), "n": count.astype(np.int64), "n1": np.bincount(inverse, weights=y, minlength=len(term)).astype(np.int64)})

    counted = sample.mapInArrow(presence, "term long, n long, n1 long").groupBy("term").agg(F.sum("n").cast("int").alias("n"), F.sum("n1").cast("int").alias("n1"))
    found = (counted if 0 < n1 < n else counted.limit(0)).toArrow()
    hashed = found.column("term").to_numpy().view(np.uint64)
    order = np.argsort(hashed)
    vocabulary, held, held1 = hashed[order], found.column("n").to_numpy()[order].astype(float), found.column("n1").to_numpy()[order].astype(float)
    chi = chi_square(held1, held, n1, n)
    leaning = np.flatnonzero((held >= rows) & (held < n) & (chi >= least) & (held1 * n >= lift * n1 * held))
    leaning = leaning[np.lexsort((signed(vocabulary[leaning]), -chi[leaning]))[:terms]]
    del found, hashed, order, held, held1, chi
    pa.default_memory_pool().release_unused()
    shared = context.broadcast(vocabulary)  # the terms of the examples

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total, seen = np.zeros(len(known) + 1, np.int32), 0
        for batch in small_batches(batches, "text"):
            total[:-1] += np.bincount(term_counts(batch.column("text"), known)[1], minlength=len(known)).astype(np.int32)
            seen += batch.num_rows
        total[-1] = seen
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": some.astype(np.int32), "n": total[some]})

    table = texts_of(docs, "doc_id", "text").mapInArrow(frequency, "term int, n int").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[table.column("term").to_numpy()] = table.column("n").to_numpy()
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1
    idf[leaning] *= stress
    del table, df
    pa.default_memory_pool().release_unused()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            text, term, count = term_counts(batch.column("text"), shared.value)
            per = np.bincount(text, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), list_array(term, per, pa.int32()), list_array(count, per, pa.int32())], names=["doc_id", "label", "terms", "counts"])

    def collected() -> pa.Table:  # named nowhere else, so that it goes while the index is made
        table = sample.mapInArrow(vectors, "doc_id long, label int, terms array<int>, counts array<int>").toArrow()
        sample.unpersist()
        shared.destroy()
        return table

    return _index(vocabulary, idf, collected(), prior)


def alike(dense: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which neighbours are alike, and where each block begins: a few rounds of k-means on directions, then by length.  ``dense`` is used up."""
    m = len(dense)
    if not m:
        return (np.empty(0, np.int64),) * 2
    unit = dense  # scaled where it stands: the driver has no room for two
    unit /= np.maximum(np.sqrt(np.einsum("ij,ij->i", unit, unit)), 1e-9)[:, None]
    middle = unit[np.linspace(0, m - 1, min(CLUSTERS, m)).astype(np.int64)]
    group = np.zeros(m, np.int64)
    for _ in range(6):
        group = np.argmax(unit @ middle.T, axis=1)
        for c in np.unique(group).tolist():
            total = unit[group == c].sum(0)
            middle[c] = total / max(float(np.linalg.norm(total)), 1e-9)
    order = np.lexsort((np.arange(m), length, group))
    new = np.flatnonzero(np.diff(group[order], prepend=-1))
    return order, np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(new, np.append(new[1:], m), strict=True)])


def _index(vocabulary: np.ndarray, idf: np.ndarray, table: pa.Table, prior: float) -> Index:
    table = table.sort_by("doc_id")
    y, ids = table.column("label").to_numpy().astype(np.int64), table.column("doc_id").to_numpy()
    flat = lambda name, kind: np.concatenate([np.empty(0, kind), *(c.flatten().to_numpy().astype(kind) for c in table.column(name).chunks)])
    per = np.concatenate([np.empty(0, np.int64), *(c.value_lengths().to_numpy(zero_copy_only=False) for c in table.column("terms").chunks)]).astype(np.int64)
    term, count, filled = flat("terms", np.int32), flat("counts", np.uint16), per > 0
    del table
    pa.default_memory_pool().release_unused()
    without = (y[~filled].sum() + prior) / ((~filled).sum() + 1)
    y, ids, per = y[filled], ids[filled], per[filled]
    begin, m = np.concatenate([[0], np.cumsum(per)]), len(per)
    common = np.flatnonzero(np.bincount(term, minlength=len(idf)) > COMMON * m)
    place = np.full(len(idf), -1, np.int32)
    place[common] = np.arange(len(common))
    dense = np.zeros((m, len(common)), np.float32)
    for k in range(0, m, 500):  # some at a time: sums and places of all postings are several times as large as these
        part = slice(begin[k], begin[min(k + 500, m)])
        owner, at = np.repeat(np.arange(k, min(k + 500, m)), per[k : k + 500]), place[term[part]]
        near = np.flatnonzero(at >= 0)
        dense[owner[near], at[near]] = (_LOG[count[part]] * idf[term[part]])[near]
    order, edges = alike(dense, per)
    del dense
    first, per = begin[:-1][order], per[order]
    own_term, own_count, upto = np.empty_like(term), np.empty_like(count), np.concatenate([[0], np.cumsum(per)])
    for k in range(0, m, 500):
        x, _ = spans(first[k : k + 500], per[k : k + 500])
        part = slice(upto[k], upto[min(k + 500, m)])
        own_term[part], own_count[part] = term[x], count[x]
    del term, count
    index = Index(vocabulary, idf, ids[order], y[order], upto, own_term, own_count, edges, np.empty(0, np.int64), prior, float(without))
    equal: Counter[bytes] = Counter()
    spare = []
    for k in np.argsort(index.ids).tolist():
        part = slice(index.begin[k], index.begin[k + 1])
        key = sha1(index.term[part].tobytes() + index.count[part].tobytes()).digest()
        equal[key] += 1
        if equal[key] > index.neighbours + 1:
            spare.append(k)
    index.spare = np.array(sorted(spare), np.int64)
    return index


def calibration(spark: SparkSession, shared: Broadcast, ids: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a vote means, from the examples, each voted on by the others."""
    m = len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            some = batch.column("id").to_numpy()
            term, weight, n = index.weights(some)
            found = index.all_nearest(term, weight, np.concatenate([[0], np.cumsum(n)]), index.neighbours, some)
            yield pa.RecordBatch.from_pydict({"id": some, "raw": pa.array([index.vote(*f) for f in found], pa.float64())})

    if not m:
        return np.empty(0), np.empty(0)
    votes = spark.range(0, m, 1, m // 512 + 1).mapInArrow(run, "id long, raw double").toArrow().sort_by("id")
    order = np.argsort(ids)
    return _calibration(votes.column("raw").to_numpy()[order], labels[order])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, and evidence (neighbours: doc_id, similarity, label)."""
    index = build(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the examples
    ids, y = index.ids, index.labels
    del index
    levels, meaning = calibration(docs.sparkSession, shared, ids, y)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", evidence)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value, {}
        for batch in small_batches(batches, "text"):
            coded = batch.column("text").fill_null("").dictionary_encode()
            keys = [sha1(x.as_buffer()).digest() for x in coded.dictionary]
            answers = [known.pop(key, None) for key in keys]
            fresh = [i for i, answer in enumerate(answers) if answer is None]
            text, term, count = term_counts(coded.dictionary.take(pa.array(fresh, pa.int64())), index.vocabulary)
            some, first = np.unique(text, return_index=True)
            found = index.all_nearest(term, index.vectors(text, term, count), np.append(first, len(text)), index.neighbours)
            for i, (near, by) in zip(some.tolist(), found, strict=True):
                shown = [{"doc_id": int(index.ids[x]), "similarity": float(s), "label": int(index.labels[x])} for x, s in zip(near[:3], by[:3], strict=True)]
                answers[fresh[i]] = float(np.interp(index.vote(near, by), levels, meaning)), shown
            answers = [answer or (index.without, []) for answer in answers]
            known.update(zip(keys, answers, strict=True))
            for key in list(known)[: max(0, len(known) - REMEMBERED)]:
                del known[key]
            score, shown = zip(*(answers[i] for i in coded.indices.to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(shown, evidence)], schema=schema)

    scored = texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,label:int>>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
