"""Periodic runs against a search over all periods; byte-pair encoding against the tokenizers library."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from skylattice.llm import bpe, periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words, least=24, power=3):
    found, n = {}, len(words)
    for q in range(1, n // power + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            start = at
            while at + q < n and words[at] == words[at + q]:
                at += 1
            length = at - start + q
            if length >= max(least, power * q):
                found.setdefault((start, length), q)  # the smallest period comes first
    return sorted(((start, length, q) for (start, length), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_words(rng, most=5):
    alphabet, words = rng.choice([1, 2, 3, 8, 50]), []
    for _ in range(rng.randint(0, most)):
        base = [f"w{rng.randint(1, alphabet)}" for _ in range(rng.randint(1, rng.choice([3, 12, 40, 90])))]
        if rng.random() < 0.4:
            base = base[:1] * rng.randint(1, 60) + base  # a highly periodic stretch inside a period
        if rng.random() < 0.3:
            base = base * rng.randint(1, 4) + ["x"]
        words += base if rng.random() < 0.3 else (base * 7)[: int(len(base) * rng.uniform(1, 6))]
    return words


@pytest.mark.parametrize("least,power", [(24, 3), (6, 3), (1, 3), (40, 4)])
def test_runs_equal_a_search_over_all_periods(least, power):
    rng = random.Random(least)
    for _ in range(150):
        texts = [periodic_words(rng) for _ in range(rng.randint(0, 4))]
        ids = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        text, *columns = periodic.find_runs(np.array([ids[w] for t in texts for w in t], np.uint64), first, least, power)
        for k, words in enumerate(texts):
            assert [tuple(int(c[j]) for c in columns) for j in np.flatnonzero(text == k)] == all_runs(words, least, power)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def report(doc_id, text):
    words = planted(doc_id, text)
    runs = all_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_report(spark, with_null_id, nothing):
    rng = random.Random(1)
    more = [(1000 + k, rng.choice([" ", "\n", "  \t"]).join(periodic_words(rng))) for k in range(80)] + [(5000, "a b " * 20000), (5001, " ".join(f"u{k % 7001}" for k in range(25000)))]
    table = with_null_id.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).repartition(3)
    items = [(r.doc_id, r.text) for r in table.collect()]
    got = sorted(map(tuple, periodic.run_report(periodic.with_planted_runs(table)).collect()), key=str)
    assert [g for g in got if g[0] not in (5000, 5001)] == sorted((report(*r) for r in items if r[0] not in (5000, 5001)), key=str)
    long = {r.doc_id: r for r in periodic.periodic_runs(table.filter("doc_id >= 5000")).collect()}
    assert [tuple(x) for x in long[5000].runs] == [(0, 40000, 2)] and long[5000].collapsed == "a b"
    assert [tuple(x) for x in long[5001].runs] == [(0, 25000, 7001)] and long[5001].n_words == 25000
    assert periodic.run_report(periodic.with_planted_runs(nothing)).count() == 0


def test_sql_finds_the_same_runs(spark, rows):
    rng = random.Random(7)
    items = [r[:2] for r in rows] + [(1000 + k, " ".join(periodic_words(rng))) for k in range(60)]
    items = list({i: (i, t) for i, t in items}.values())  # the SQL takes ids as keys
    base = duckdb.connect()
    base.register("documents", pa.table({"doc_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}))
    want = sorted(base.sql(queries.ORACLE_SQL["op12_periodic_runs"]).fetchall())
    assert want == sorted(report(*r) for r in items)


# --- byte-pair encoding

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


ODD = [*"aaabbbnnthre  \n\t'.,!?0123456789éÉßΣσςİıǅŒœ日本語한글🙂❤️́̈‍\xa0 　<|>", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "ﬁ", "𝐀", "Ɤ", "\x00", "\x1c", "\x85", "Ａ", "Ⅷ", "²", "Ᲊ", "aaaa", "haha", "ing"]


def test_ids_equal_the_library(encoder, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [None, "", "a" * 5000, "ha" * 3000, "é" * 3000, "!" * 5000, "aab" * 999 + " " + "lol" * 999]
    ids, counts = encoder.encode(texts)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got == want
    decoded = bpe.Decoder(encoder.vocabulary.strings).decode(ids.astype(np.int64), counts).to_pylist()
    assert decoded == [library.decode(x, skip_special_tokens=False) for x in want]


def test_plain_characters_follow_the_files_rules(encoder, library):
    """The characters that go through ``regex``: every one beside a letter, a digit and a blank."""
    plain = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x3100), *range(0x4E00, 0x5000), *range(0xAC00, 0xAD00), *range(0x1F300, 0x1F650)] if bpe._PLAIN.fullmatch(chr(c))]
    for at in range(0, len(plain), 400):
        text = "".join(f"x{c}1{c} {c}Y{c}{c}" for c in plain[at : at + 400])
        normal = library.normalizer.normalize_str(text)
        assert [w for part in encoder.words(text) for w in part] == [normal[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(normal)]


def test_long_texts_are_cut_at_blanks_only(encoder, library):
    text = ("word" * 30 + " é\n") * 12000  # above the size of a slice
    assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(len(p) for p in encoder.words("y" * 1_200_000 + " z")) == 2


def test_every_token_is_what_the_merges_give(encoder):
    v = encoder.vocabulary
    assert all(v.size[i] for i in v.strings if i not in v.literals.values())


def test_compatibility_against_merging(encoder, library):
    rng, v = random.Random(9), encoder.vocabulary
    inner = [i for i, t in v.strings.items() if not t.endswith(v.suffix) and i not in v.literals.values() and t.isascii() and t.isalpha() and t.islower()]
    last = [i for i, t in v.strings.items() if t.endswith(v.suffix) and t[: -len(v.suffix)].isascii() and t[: -len(v.suffix)].isalpha() and t.islower()]
    for _ in range(4000):
        a, b = rng.choice(inner), rng.choice(last)
        word = v.strings[a] + v.strings[b][: -len(v.suffix)]
        assert v.compatible(a, b) == (library.encode(word, add_special_tokens=False).ids == [a, b])


def test_round_trip(spark, with_null_id, nothing, library):
    got = sorted(map(tuple, bpe.round_trip(with_null_id, PATH).collect()), key=str)
    want = []
    for r in with_null_id.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(nothing, PATH).count() == 0
    odd = spark.createDataFrame([(1, [5, -1, 99999, 7]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, PATH).collect()} == {1: library.decode([5, 7], skip_special_tokens=False), 2: "", 3: ""}
