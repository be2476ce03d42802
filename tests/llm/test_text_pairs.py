"""Operators that compare texts, against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from skylattice.llm import decontaminate, graph, jaccard_join, line_dedup, pair_sql, substring_dedup
from skylattice.llm.textops import rolling_hashes, run_hashes, Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return text.translate({k: k + 32 for k in range(65, 91)})


def shingles(text, n):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def reach(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_words_match_the_pattern():
    texts = ["", None, " a  b\tc\x0b\n", "é\xa0ж x", "end ", "日本 語"]
    w = Words(pa.array(texts))
    got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    assert len(set(w.hashes().tolist())) == len({x for g in got for x in g})


def test_components(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(100, 3), (3, 3), (7, 7), (100, 50), (100, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == reach({x for e in edges for x in e}, edges)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_join(docs, rows, words, percent):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs, words=words, percent=percent).collect())
    items = [(r[0], shingles(r[1], words)) for r in rows]
    # rows are nodes of their own; a component's id is its smallest document
    links = [(a, b) for a in range(len(items)) for b in range(a) if items[a][1] and 100 * len(items[a][1] & items[b][1]) >= percent * len(items[a][1] | items[b][1])]
    group = reach(range(len(items)), links)
    least = {}
    for k, g in group.items():
        least[g] = min(least.get(g, 1 << 60), items[k][0])
    assert got == Counter((i, len(s), least[group[k]]) for k, (i, s) in enumerate(items))


def test_jaccard_blocks_split(docs, rows, monkeypatch):
    whole = sorted(map(tuple, jaccard_join.jaccard_join(docs, percent=60).collect()))
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 60)
    assert sorted(map(tuple, jaccard_join.jaccard_join(docs, percent=60).collect())) == whole


def test_common_phrases_chain_no_clusters(spark, monkeypatch):
    """Texts that share phrases by chance are not compared, near copies among them are found."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.5, rng.integers(20, 150)) % 1000) for _ in range(400)]
    for k in range(0, 400, 5):
        words = texts[k].split(" ")
        words[rng.integers(len(words))] = "x"
        texts.append(" ".join([*words, "y"][: len(words) + k % 2]))
    placed, sizes = jaccard_join._placed, []
    monkeypatch.setattr(jaccard_join, "_placed", lambda members: (sizes.extend(r["count"] for r in members.groupBy("cluster").count().collect()), placed(members))[1])
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingles(t, 3) for t in texts]
    assert got == reach(range(len(sets)), [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])])
    assert len(set(got.values())) < 470 and max(sizes) < 20


@pytest.mark.parametrize("percent", [85, 90, 97, 100])
def test_linked_sets_keep_a_part_in_common(percent):
    """Whatever may stay out of the index: sets at the limit, of sizes on both sides of a level."""
    rng, links = np.random.default_rng(percent), 0
    for _ in range(1500):
        a = np.unique(rng.integers(0, 1 << 64, rng.integers(1, rng.choice([30, 300, 2000])), np.uint64))
        gone, more = rng.integers(0, len(a) * (100 - percent) // 100 + 2, 2)
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 64, more, np.uint64)]))
        both, n = len(np.intersect1d(a, b)), np.array([len(a), len(b)])
        if 100 * both < percent * (len(a) + len(b) - both) or both == max(n) or not both:
            continue
        links += 1
        keys, per = jaccard_join.index_keys(np.concatenate([a, b]), n, percent)
        drop = jaccard_join.may_drop(n, percent)
        x, y = [set(zip(k.tolist(), d.tolist())) for k, d in zip(np.split(keys, per[:1]), np.split(drop, per[:1]))]
        assert max(sum(d == most for _, d in x & y) - most for most in set(drop.tolist())) > 0  # shared ones are the most popular
    assert links > 100 or percent == 100


def test_jaccard_edge_cases(with_null_id, nothing):
    got = [r for r in jaccard_join.jaccard_join(with_null_id).collect() if r.doc_id is None]
    assert len(got) == 2 and all(r.component_id is None for r in got)
    assert jaccard_join.jaccard_join(nothing).count() == 0


def representatives(items, words, percent):
    """(doc_id, text) pairs that stay: blanks, and of each component one row of the smallest id."""
    rows = sorted({(i, t) for i, t in items if i is not None and WORD.search(t or "")})
    sets = [shingles(t, words) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    groups = {}
    for k, g in reach(range(len(rows)), links).items():
        groups.setdefault(g, []).append(rows[k])
    return [{r for r in g if r[0] == min(g)[0]} for g in groups.values()]


def test_drop_duplicates(with_null_id):
    kept = jaccard_join.drop_duplicates(with_null_id, words=5, percent=80).collect()
    assert set(kept[0].asDict()) == set(with_null_id.columns)
    items = [(r.doc_id, r.text) for r in with_null_id.collect()]
    loose = Counter(x for x in items if x[0] is None or not WORD.search(x[1] or ""))
    got = Counter((r.doc_id, r.text) for r in kept)
    assert all(got.pop(x) == n for x, n in loose.items())
    groups = representatives(items, 5, 80)
    assert sum(got.values()) == len(groups) and all(sum(got[x] for x in g) == 1 for g in groups)


def test_texts_whose_ids_repeat_are_not_lost(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(12)) for x in "abc")
    table = spark.createDataFrame([(1, a, 7), (1, b, 7), (2, b, 7), (3, c, 7), (3, c, 7)], "doc_id long, text string, `a.b` int")
    kept = jaccard_join.drop_duplicates(table)
    assert kept.columns == table.columns and sorted(map(tuple, kept.collect())) == [(1, a, 7), (1, b, 7), (3, c, 7)]


def thue_morse(n, a="a", b="b"):
    return [(a, b)[k.bit_count() & 1] for k in range(n)]


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_and_lines_after_thue_and_morse(spark, n):
    """Pairs on which every sum of powers modulo 2**64 agrees: long words of two letters, and lines of two words."""
    one, two = ("".join(thue_morse(n, *x)) for x in ("ab", "ba"))
    tail = " ".join(f"w{k}" for k in range(12))
    table = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, one), (4, two), (5, " ".join(thue_morse(n, "x", "yy"))), (6, " ".join(thue_morse(n, "yy", "x")))], "doc_id long, text string")
    items = [(r.doc_id, r.text) for r in table.collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(table).collect()}
    assert got == {i: tuple(rest) for i, *rest in remaining(items)}
    joined = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(table).collect()}
    assert joined == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}  # the last two have the same few shingles
    assert {r.doc_id: r.n_removed for r in line_dedup.line_dedup(table).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0}  # one word replaced in 13
    leaks = decontaminate.leaks(table, table.filter("doc_id IN (1, 5)").select(F.col("doc_id").alias("item_id"), "text"), least=5, coverage=0.95).collect()
    assert {(r.doc_id, r.item_id) for r in leaks} == {(1, 1), (5, 5)} | ({(6, 5)} if sum(t[2] for t in decontaminate.tiles(*(Words(pa.array([x])).hashes() for x in (items[4][1], items[5][1])), 5)) >= 0.95 * n else set())


def test_hashes_of_runs_agree_wherever_they_stand():
    rng = np.random.default_rng(3)
    h = np.tile(rng.integers(1, 1 << 63, 700, dtype=np.uint64), 2)
    for n in (1, 3, 32, 33, 500):
        for hashes in (run_hashes(h, np.arange(700), n), rolling_hashes(h, np.arange(700), n), run_hashes(h, np.arange(700), n, 1)):
            assert len(set(hashes.tolist())) == 700
        assert np.array_equal(run_hashes(h, np.arange(100), n), run_hashes(h, np.arange(700, 800), n)) and np.array_equal(rolling_hashes(h, np.arange(100), n), rolling_hashes(h[690:], np.arange(10, 110), n))
        assert np.array_equal(run_hashes(h, np.array([5, 9, 20]), np.array([n, 1, 40])), np.concatenate([run_hashes(h, np.array([a]), b) for a, b in ((5, n), (9, 1), (20, 40))]))


def remaining(items, window=13):
    first = {}
    for i, t in items:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in items:
        w = WORD.findall(t or "")
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if i is not None and first.get(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = True
        out.append((i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_substring_dedup(with_null_id, nothing):
    got = substring_dedup.substring_dedup(with_null_id).collect()
    want = remaining([(r.doc_id, r.text) for r in with_null_id.collect()])
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == Counter(want)
    assert sum(w[2] for w in want) > 500
    for r in got:
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_factors_are_a_parse_against_the_reference(spark, rows):
    rng = np.random.default_rng(6)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 400, n)]
    passage = word(150)
    texts = [(1, passage + word(20)), (2, word(30)), (7, word(40) + passage[10:140] + word(9)), (9, passage[5:60] + word(3) + passage[80:]), (12, word(15) + passage[:13]), (13, passage[20:32])]
    texts += [(20 + k, ["x", "the", "same", "five", "word", "seed"] * 1 + word(20)) for k in range(40)]  # one anchor in ever new surroundings
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in texts] + [r[:2] for r in rows if r[0] > 100], "doc_id long, text string")
    words = {}
    for r in table.collect():
        words.setdefault(r.doc_id, []).append(WORD.findall(r.text))
    longest = Counter()
    for r in substring_dedup.substring_dedup(table.repartition(3)).collect():
        covered = set()
        for f in r.factors:
            assert f.ref_doc < r.doc_id and f.words >= 13
            own = [w[f.start : f.start + f.words] for w in words[r.doc_id]]
            assert any(w[f.ref_start : f.ref_start + f.words] in own for w in words[f.ref_doc])
            covered |= set(range(f.start, f.start + f.words))
            longest[r.doc_id] = max(longest[r.doc_id], f.words)
        assert len(covered) == r.n_removed
    assert longest[7] == 130 and longest[9] == 70 and longest[12] == 13 and longest[13] == 0  # far longer than a block of one anchor


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_lines_lose_a_word_at_once():
    """Lines of a batch lose each of their words in one pass, with the hashes of the shorter lines."""
    w = Words(pa.array(["a b c d e", "", "x", "e d c b a " * 40, "a a b b a a"]))
    h = w.hashes()
    some = np.flatnonzero(w.counts)
    got, line, place = line_dedup.without_each(h, w.first[some], w.counts[some])
    want = [(k, i, run_hashes(np.delete(h[w.first[t] : w.first[t + 1]], i), np.zeros(1, np.int64), w.counts[t] - 1)[0]) for k, t in enumerate(some) for i in range(w.counts[t])]
    assert list(zip(line.tolist(), place.tolist(), got.tolist())) == [(k, i, int(x)) for k, i, x in want]
    assert [len(x) for x in line_dedup.without_each(h, w.first[:0], w.counts[:0])] == [0, 0, 0]


def test_within_one_is_edit_distance():
    rng = np.random.default_rng(0)
    for _ in range(500):
        a, b = (rng.choice(list("ab"), rng.integers(0, 6)).tolist() for _ in "xy")
        assert line_dedup.within_one(a, b) == one_edit(a, b)


def test_line_dedup(spark, docs, rows, nothing):
    long = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20"
    more = [(1000, f"{long}\na b c d e\nshort one"), (1001, f"{long.replace('w2 ', 'q ')}\na b x d e\nshort two"), (1002, f"{long.replace('w19', 'q')}\n{long} more\nb c d e\n\na b c d"), (1003, "short one\na b c d e\nz " + long)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    items = [(r.doc_id, r.text) for r in table.collect()]
    lines = [(i, k, tuple(WORD.findall(x))) for i, t in items for k, x in enumerate((t or "").split("\n"))]
    known = sorted(x for x in lines if x[2])
    gone = {(i, k, w) for i, k, w in known for j, m, v in known if (j, m) < (i, k) and (v == w or max(len(v), len(w)) >= 5 and one_edit(v, w))}
    got = {}
    for r in line_dedup.line_dedup(table).collect():
        got.setdefault(r.doc_id, []).append((r.n_lines, tuple(r.removed)))
    single = {i for i, n in Counter(i for i, _ in items).items() if n == 1}
    for i, t in items:
        if i in single:
            want = tuple(k for j, k, w in lines if j == i and (j, k, w) in gone)
            assert got[i] == [((t or "").count("\n") + 1, want)], i
    assert gone and line_dedup.line_dedup(nothing).count() == 0
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(table, line_dedup.line_dedup(table)).collect()}
    assert kept[1003] == "" and kept[1001].endswith("short two")
    assert line_dedup.drop_lines(docs, line_dedup.line_dedup(docs)).columns == docs.columns and decontaminate.clean_documents(docs, docs.select(F.col("doc_id").alias("item_id"), "text").limit(3)).columns == docs.columns


def test_tiles_cover_reordered_passages():
    rng = np.random.default_rng(1)
    item = rng.integers(1, 1 << 60, 30, dtype=np.uint64)
    noise = rng.integers(1, 1 << 60, 200, dtype=np.uint64)
    text = np.concatenate([noise[:50], item[15:], noise[50:60], item[:15], noise[60:]])
    found = decontaminate.tiles(item, text, 5)
    assert sum(n for *_, n in found) == 30 and len(found) == 2
    assert decontaminate.tiles(item, noise, 5) == []
    assert sum(n for *_, n in decontaminate.tiles(item, np.concatenate([item[:7], noise, item[9:13]]), 5)) == 7


def plain_tiles(p, t, least):
    """Greedy string tiling as defined: the longest match of free words, the first of equals, until none is long enough."""
    free_p, free_t, found, least = [True] * len(p), [True] * len(t), [], max(1, min(least, len(p)))
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and free_p[i + n] and free_t[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return found
        found.append((i, j, n))
        for k in range(n):
            free_p[i + k] = free_t[j + k] = False


def test_tiles_equal_plain_greedy_tiling():
    rng = np.random.default_rng(3)
    for k in range(150):
        p, t = (rng.integers(1, 3 + k % 4, rng.integers(1, n)).astype(np.uint64) for n in (16, 40))
        assert sorted(decontaminate.tiles(p, t, 3)) == sorted(plain_tiles(p.tolist(), t.tolist(), 3)), (p, t)


def test_leaks_equal_tiling_of_all_pairs(spark):
    """Neither the seed filter, nor the seeds left out, nor the pruning of pairs loses a leak."""
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(25)]
    some = lambda n: [words[x] for x in rng.integers(0, 25, n)]
    common = some(6)
    items = [(k, common + some(int(n))) for k, n in enumerate(rng.integers(0, 18, 25))] + [(30, some(3)), (31, common)]
    docs = []
    for k in range(80):
        text = some(12)
        for _ in range(rng.integers(0, 3)):
            item = items[rng.integers(0, len(items))][1]
            cut = int(rng.integers(0, len(item) + 1))
            text += item[cut:] + some(int(rng.integers(0, 4))) + item[:cut]
        docs.append((k, text))
    table = lambda rows, key: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{key} long, text string")
    number = {w: k + 1 for k, w in enumerate(words)}
    code = lambda w: [number[x] for x in w]
    want = {(d, i) for d, text in docs for i, item in items if sum(n for *_, n in plain_tiles(code(item), code(text), 5)) >= 0.8 * len(item)}
    got = [(r.doc_id, r.item_id) for r in decontaminate.leaks(table(docs, "doc_id").repartition(3), table(items, "item_id")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_very_long_texts():
    """Texts of several megabytes, of one word, of one line, or of ever the same words."""
    from skylattice.llm import quality

    texts = pa.array(["x" * 3_000_000, "same words again " * 200_000, " ".join(map(str, range(300_000))), "", None])
    for text in texts:
        batch = pa.array([text.as_py()], pa.string())
        assert len(substring_dedup.Blocks(batch, 13, 5).start) == max(0, len(WORD.findall(text.as_py() or "")) - 12)
        assert jaccard_join.shingle_sets(batch, 5)[1][0] <= 300_000 and quality.indicators(batch, 18)[1][0] < 1 << 18
    assert decontaminate.tiles(np.full(40, 7, np.uint64), np.full(20_000, 7, np.uint64), 5) == [(0, 0, 40)]


def test_leaks(spark, docs, nothing):
    bench = [(1, "The quick, brown fox jumps over the lazy dog near the old river bank"), (2, "Completely different words that nobody else would ever write down here"), (3, "Tiny item"), (4, None), (5, "")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    planted = [(900, "xx yy the QUICK brown fox jumps over; the lazy dog near the old river bank zz"), (901, "over the lazy dog near the old river bank and then the quick brown fox jumps"), (902, "the quick brown fox jumps away"), (903, "a tiny item here"), (904, None)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(planted + planted[:1], "doc_id long, text string"))
    got = {(r.doc_id, tuple(r.item_ids)) for r in decontaminate.contaminated(table, items).collect()}
    assert got == {(900, (1,)), (901, (1,)), (903, (3,))}
    clean = decontaminate.clean_documents(table, items)
    assert clean.count() == table.count() - 4 and clean.columns == table.columns
    assert decontaminate.contaminated(nothing, items).count() == 0
    assert decontaminate.contaminated(table, items.limit(0)).count() == 0


def test_hash_of_kept_words(docs):
    from pyspark.sql import functions as F

    row = substring_dedup.substring_dedup(docs).select("kept", F.sha2("kept", 256).alias("h")).first()
    assert row.h == hashlib.sha256(row.kept.encode()).hexdigest()


def test_sql_gives_the_same_rows(spark, rows):
    import duckdb
    import pandas as pd

    unique = {r[0]: r[1] for r in rows}
    documents = pd.DataFrame({"doc_id": list(unique), "text": list(unique.values())})  # noqa: F841 - read by the SQL
    table = spark.createDataFrame(list(unique.items()), "doc_id long, text string").repartition(3)
    pairs = jaccard_join.jaccard_join(table).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, pairs.collect())) == sorted(duckdb.sql(pair_sql.JACCARD).fetchall())
    kept = substring_dedup.substring_dedup(table).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert sorted(map(tuple, kept.collect())) == sorted(duckdb.sql(pair_sql.SUBSTRINGS).fetchall())
