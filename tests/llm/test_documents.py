"""Operators on single documents: exact round trips, brute force and held-out accuracy."""

import hashlib
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylattice.llm import media, mixing, quality, secrets, token_output, toxicity
from skylattice.llm.labels import held_out
from skylattice.llm.textops import Words, list_array

VOCABULARY = "byte_bpe_50k.json"


@pytest.mark.parametrize("bits", [1, 5, 8, 15, 16, 17, 31])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    packed = token_output.pack(ids, bits)
    assert len(packed) == -(-1000 * bits // 8)
    assert (token_output.unpack(packed, bits, 0, 1000) == ids).all() and (token_output.unpack(packed, bits, 333, 777) == ids[333:777]).all()
    assert token_output.bits_for(50257) == 16 and token_output.bits_for(2) == 1 and token_output.bits_for(1) == 1


def test_encoder_equals_whole_text():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path(VOCABULARY)
    plain, own = tokenizers.Tokenizer.from_file(path), token_output.Encoder(path)
    rng = random.Random(3)
    bits = ["a", "bc", "É", "  ", "\n", "\t", " ", " ", "'s", "don't", "1", "23", ",", "!!", "\u3000", "\xa0", "日本", "\x1f", " x", "\r\n", "🙂", "<|endoftext|>", "\u2003", "\u200b", "”", "\x85", " abcdefghijklmnop", " abcdefghijklmno", " abcdefgh", "\0"]
    for _ in range(60):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(40)]
        assert [ids.tolist() for ids in encoded(own, texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def encoded(encoder, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    return np.split(ids, np.cumsum(counts)[:-1])


def test_encoder_with_a_crowded_table(monkeypatch):
    """Pieces that lose their slot, and a memory that is emptied, change nothing."""
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path(VOCABULARY)
    monkeypatch.setattr(token_output, "SLOTS", 8)
    monkeypatch.setattr(token_output, "MEMORY", 60)
    plain, own = tokenizers.Tokenizer.from_file(path), token_output.Encoder(path)
    rng = random.Random(1)
    for _ in range(30):
        texts = [" ".join(str(rng.randint(0, 60)) for _ in range(rng.randint(0, 30))) for _ in range(9)] + [None]
        assert [ids.tolist() for ids in encoded(own, texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_takes_special_literals_as_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path(VOCABULARY)
    plain, own = tokenizers.Tokenizer.from_file(path), token_output.Encoder(path, 2)
    texts = ["<|endoftext|>", "one <|endoftext|> two", "a<|endoftext|>", "no literal here", "x <|endoftext|>", ""]
    got = [ids.tolist() for ids in encoded(own, texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts] and 50256 in got[0]


def test_ids_beyond_the_vocabulary_are_refused(docs):
    path = pytest.importorskip("public_tokenizers").path(VOCABULARY)
    with pytest.raises(ValueError):
        token_output.pack(np.array([1, 16], np.uint32), 4)
    with pytest.raises(ValueError):
        token_output.write_tokens(docs, path, 50257)


def test_token_output(with_null_id, nothing):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path(VOCABULARY)
    plain = tokenizers.Tokenizer.from_file(path)
    shards = token_output.write_tokens(with_null_id, path, 2, block_ids=500)
    got = token_output.token_index(shards).collect()
    ids = [(r.doc_id, plain.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in with_null_id.collect()]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_output.token_index(token_output.write_tokens(nothing, path, 2)).count() == 0


def png(color: int) -> bytes:
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes([0, color]))) + chunk(b"IEND", b"")


def test_sniffing():
    import gzip
    import io
    import zipfile

    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a", "b")
    files = {"image/png": png(7), "audio/wav": media.wave(b"ab" * 40), "application/gzip": gzip.compress(b"x" * 99), "application/zip": box.getvalue(), "application/pdf": b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"}
    for kind, data in files.items():
        assert media.sniff(data)[0] == kind
        assert media.sniff(b"noise" * 9 + data + b"tail")[1][:1] == [(kind, 45, 45 + len(data))]
        assert media.sniff(data[: len(data) // 2])[0] is None  # cut short: the structure does not hold
    broken = bytearray(png(7))
    broken[-20] ^= 1
    assert media.sniff(bytes(broken)) == (None, [])
    assert media.sniff(b"") == (None, []) and media.sniff(b"RIFF PNG GIF89a BM") == (None, [])


def crc(table, data, bits):
    c = 0
    for x in data:
        c = (c << 8 & (1 << bits) - 1) ^ table[c >> (bits - 8) ^ x]
    return c.to_bytes(bits // 8, "big")


def flac(frames=3):
    """A file of constant frames of 192 samples: metadata, then each frame with its two checksums."""
    info = struct.pack(">HH", 192, 192) + bytes(6) + ((44100 << 44) | (15 << 36) | 192 * frames).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info
    for k in range(frames):
        head = b"\xff\xf8\x19\x08" + bytes([k])
        frame = head + crc(media._CRC8, head, 8) + b"\x00\x12\x34"
        out += frame + crc(media._CRC16, frame, 16)
    return out


def test_validators_find_the_end():
    whole = flac()
    assert media.sniff(whole + b"q" * 200)[0] == "audio/flac" and media.sniff(b"xx" + whole + b"q" * 200)[1] == [("audio/flac", 2, 2 + len(whole))]
    assert media.sniff(whole[:42] + b"q" * 200) == (None, []) and media.sniff(whole[:-3])[0] is None
    pdf = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"
    assert media.sniff(b"x" + pdf + b"\n2 0 obj\nstartxref\n30\n%%EOF" + b" more %%EOF")[1] == [("application/pdf", 1, 1 + len(pdf) + 27)]
    bmp = lambda width, bits: b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + 8, 0, 0, 54, 40, width, 2, 1, bits, 0, 8, 0, 0, 0, 0) + bytes(8)
    assert media.sniff(bmp(1, 24))[0] == "image/bmp" and media.sniff(bmp(9, 24))[0] is None and media.sniff(bmp(1, 5))[0] is None
    import gzip

    packed = gzip.compress(bytes(5_000_000))
    assert media.sniff(b"zz" + packed + b"tail" * 9)[1] == [("application/gzip", 2, 2 + len(packed))]


def test_sniff_media_replaces_its_columns(spark):
    rows = [(png(3), "image/gif", "x", {"a": 1}, 1, "y"), (b"\xff\xfe" * 9, None, None, None, 2, "z")]
    got = media.sniff_media(spark.createDataFrame(rows, "media binary, declared string, found string, carved map<string,int>, `a.b` int, `c``d` string"))
    assert got.columns == ["media", "declared", "a.b", "c`d", "found", "corrected", "carved"] and [r.found for r in got.collect()] == ["image/png", None]


def test_sniff_media(spark):
    rows = [(1, png(3), "image/gif"), (2, png(3), "image/png"), (3, None, "image/png"), (4, b"x" * 9 + png(4), None), (1, b"", "a")]
    got = {(r.id, r.found, r.corrected, len(r.carved)) for r in media.sniff_media(spark.createDataFrame(rows, "id long, media binary, declared string")).collect()}
    assert got == {(1, "image/png", True, 0), (2, "image/png", False, 0), (3, None, False, 0), (4, None, False, 1), (1, None, False, 0)}


def test_text_media(with_null_id, nothing):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.text_media(with_null_id).collect())
    want = Counter()
    for r in with_null_id.collect():
        raw = (r.text or "").encode()
        data = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        want[(r.doc_id, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))] += 1
    assert got == want and media.text_media(nothing).count() == 0


def spans(text, rules):
    found = []
    for k, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), k, rule.kind, m.end()))
    return sorted(found)


def test_secret_scan(spark, with_null_id, nothing):
    planted = ['🙂 Password: "hunter22" end', "token=token: abcdefghij", "API_KEY='a1b2c3d4e5' apikey : zzzzzzzz", "AKIA" + "Z" * 16 + " xAKIAAKIA" + "Q" * 20, "é " + "deadbeef" * 4 + "!", "secret=abc", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "AIza" + "b" * 35, "secret = = abcdefgh", None]
    table = with_null_id.select("doc_id", "text").union(spark.createDataFrame([(5000 + k, t) for k, t in enumerate(planted + planted[:2])], "doc_id long, text string"))
    rules = secrets.BASE + secrets.EXTRA
    got = Counter((r.doc_id, tuple(map(tuple, r.spans))) for r in secrets.secret_scan(table).collect())
    assert got == Counter((r.doc_id, tuple(spans(r.text or "", rules))) for r in table.collect())
    assert secrets.secret_report(nothing).count() == 0
    assert secrets.secret_report(table).filter("doc_id = 5000").first().spans.startswith("assign:2:")


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("abcd+") == "abc" or secrets._leaves(secrets.trigram_query("abcd+")) >= {"abc"}
    assert secrets.trigram_query("(?:abc|xyz)[0-9]") == ("or", "abc", "xyz")
    assert secrets.trigram_query("(?:abc|[a-z]+)") is True


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, list(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] >= 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mix_plan(with_null_id, nothing):
    got = mixing.mix_plan(with_null_id).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in with_null_id.collect():
        sizes[r.source] += size(r.text)
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert taken == {s: int(want[s]) for s in sizes}
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_plan(with_null_id.repartition(5)).collect()))
    assert mixing.mix_plan(nothing).count() == 0


def test_mix_documents(docs, nothing):
    plan = mixing.mix_plan(docs)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got, want = Counter(), Counter()
    for r in out.collect():
        got[(r.doc_id, r.source)] += words(r.text)
    for r in plan.collect():
        want[(r.doc_id, r.source)] += r.taken
    assert got == +want and mixing.mix_documents(nothing).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 60))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilest", "vileness", "rotter"])
        if not good:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(good), int(toxic)))
    rows += [(700, None), (701, ""), rows[0], (None, "abc")]
    labels += [(900, 1, 0), (0, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("column", ["quality", "toxic"])
def test_held_out_accuracy(labelled, column):
    docs, labels = labelled
    got = quality.quality_scores(docs, labels) if column == "quality" else toxicity.toxicity(docs, labels)
    assert got.count() == docs.count() and got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    rows = got.join(labels.filter(f"{column} IS NOT NULL"), "doc_id").filter("held_out").collect()
    assert len(rows) > 80 and sum(r.predicted == r[column] for r in rows) / len(rows) > 0.95
    again = {(r.doc_id, r.score) for r in (quality.quality_scores(docs, labels) if column == "quality" else toxicity.toxicity(docs, labels)).collect()}
    assert again == {(r.doc_id, r.score) for r in got.collect()}


def test_classifiers_without_labels(labelled, nothing):
    docs, labels = labelled
    for scored in (quality.quality_scores(docs, labels.limit(0)), toxicity.toxicity(docs, labels.limit(0)), toxicity.toxicity(docs, labels.filter("toxic = 0"))):
        assert {round(r.score, 6) for r in scored.collect()}.__len__() == 1
    assert quality.quality_scores(nothing, labels).count() == 0 and toxicity.toxicity(nothing, labels).count() == 0


def test_held_out_rule(spark):
    ids = list(range(50))
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_nearest_examples_are_exact():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    vocabulary, m = np.arange(40, dtype=np.uint64), 300
    terms = [np.sort(rng.choice(40, rng.integers(1, 8), replace=False)) for _ in range(m)]
    counts = [rng.integers(1, 5, len(t)) for t in terms]
    table = pa.table({"doc_id": pa.array(range(m), pa.int64()), "label": pa.array(rng.integers(0, 2, m), pa.int32()), "terms": pa.array([t.tolist() for t in terms], pa.list_(pa.int64())), "counts": pa.array([c.tolist() for c in counts], pa.list_(pa.int64()))})
    idf = rng.random(40) + 1
    index = toxicity._index(vocabulary, idf, table, 0.5)
    dense = np.zeros((m, 40))
    for k, (t, c) in enumerate(zip(terms, counts)):
        dense[k, t] = index.vector(t, c)
    for k in range(0, m, 7):
        cosine = np.round(dense @ dense[k], 12)
        want = np.lexsort((np.arange(m), -cosine))[:15]
        want = want[cosine[want] > 0]
        near, by = index.nearest(terms[k], dense[k][terms[k]], 15)
        assert np.allclose(by, cosine[want], atol=1e-9)


@pytest.mark.parametrize("block", [3, 16, 512])
def test_blocks_are_skipped_without_loss(monkeypatch, block):
    """Examples of four vocabularies: most blocks stay unvisited, and every query still meets its nearest."""
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "CLUSTERS", 8)
    rng = np.random.default_rng(4)
    m, rows = 400, []
    for k in range(m):
        terms = np.unique(np.append(rng.integers(0, 50, rng.integers(3, 20)) + 50 * (k % 4), rng.integers(0, 200)))
        rows.append((terms, rng.integers(1, 4, len(terms))))
    table = pa.table({"doc_id": pa.array(range(m), pa.int64()), "label": pa.array(rng.integers(0, 2, m), pa.int32()), "terms": pa.array([t.tolist() for t, _ in rows], pa.list_(pa.int64())), "counts": pa.array([c.tolist() for _, c in rows], pa.list_(pa.int64()))})
    index = toxicity._index(np.arange(200, dtype=np.uint64), rng.random(200) + 1, table, 0.5)
    dense = np.zeros((m, 200))
    for k, (t, c) in enumerate(rows):
        dense[k, t] = index.vector(t, c)
    cut = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])])
    found = index.all_nearest(np.concatenate([t for t, _ in rows]), np.concatenate([dense[k, t] for k, (t, _) in enumerate(rows)]), cut, 5)
    for k, (near, by) in enumerate(found):
        cosine = np.round(dense @ dense[k], 12)
        want = np.lexsort((np.arange(m), -cosine))[:5]
        assert np.allclose(by, cosine[want], atol=1e-9) and np.allclose(cosine[index.ids[near]], by, atol=1e-9)
    assert index.visited < index.asked * (0.8 if block < 512 else 1.01)


def test_the_index_is_made_in_little_more_than_its_postings():
    """The driver makes it: no second copy of the matrix of common terms, and no sums over all postings at once."""
    rng = np.random.default_rng(6)
    m, n = 3000, 300
    terms = np.sort(np.argsort(rng.random((m, 2 * n)), axis=1)[:, :n], axis=1)
    table = pa.table({"doc_id": pa.array(range(m), pa.int64()), "label": pa.array(rng.integers(0, 2, m), pa.int32()), **{c: list_array(x.ravel(), np.full(m, n), pa.int32()) for c, x in (("terms", terms), ("counts", terms % 3 + 1))}})
    idf = rng.random(2 * n) + 1
    tracemalloc.start()
    index = toxicity._index(np.arange(2 * n, dtype=np.uint64), idf, table, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(index.term[a:b], terms[i]) for i, a, b in zip(index.ids, index.begin, index.begin[1:]))
    assert peak < 1.6 * 4 * m * 2 * n + 24 * m * n


def test_rows_of_blocks_are_terms_that_queries_have():
    """Terms that only a block's few long texts share stay in lists, middling terms of all texts are rows, and lists of every length give exact scores."""
    rng = np.random.default_rng(9)
    m, rows = 600, []
    for k in range(m):
        own = np.flatnonzero(rng.random(120) < 0.08) if k % 60 else np.append(np.flatnonzero(rng.random(120) < 0.3), 120 + np.flatnonzero(rng.random(4000) < 0.25))
        terms = np.unique(np.append(own, rng.integers(0, 120)))
        rows.append((terms, rng.integers(1, 4, len(terms))))
    table = pa.table({"doc_id": pa.array(range(m), pa.int64()), "label": pa.array(rng.integers(0, 2, m), pa.int32()), "terms": pa.array([t.tolist() for t, _ in rows], pa.list_(pa.int64())), "counts": pa.array([c.tolist() for _, c in rows], pa.list_(pa.int64()))})
    index = toxicity._index(np.arange(4120, dtype=np.uint64), rng.random(4120) + 1, table, 0.5)
    row, _, parts = index.blocks[:3]
    assert (row[:120] >= 0).all() and (row[120:] < 0).mean() > 0.97
    assert sum(dense.size for _, dense in parts) <= 130 * m
    dense = np.zeros((m, 4120))
    for k, (t, c) in enumerate(rows):
        dense[k, t] = index.vector(t, c)
    cut = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])])
    found = index.all_nearest(np.concatenate([t for t, _ in rows]), np.concatenate([dense[k, t] for k, (t, _) in enumerate(rows)]), cut, 15)
    for k, (near, by) in enumerate(found):
        cosine = np.round(dense @ dense[k], 12)
        want = np.lexsort((np.arange(m), -cosine))[:15]
        assert np.allclose(by, cosine[want], atol=1e-9) and np.allclose(cosine[index.ids[near]], by, atol=1e-9)


def test_lists_of_every_length_are_summed():
    rng = np.random.default_rng(10)
    size = np.append(np.arange(2 * toxicity.LANE + 3), rng.integers(0, 60, 30))
    m, w = 64, np.zeros((len(size), 64), np.float32)
    for t, n in enumerate(size):
        w[t, rng.choice(m, n, replace=False)] = rng.random(n) + 0.1
    lists = toxicity.Lists(size)
    for some in np.split(np.arange(m), [0, 5, 40]):  # examples come in several parts
        example, term = np.nonzero(w[:, some].T)
        lists.add(term, some[example].astype(np.int32), w[term, some[example]])
    terms, query, at = np.concatenate([np.arange(len(size)), [3, 17, 40], [1]]), rng.random(len(size) + 4), np.array([0, len(size), len(size), len(size) + 3, len(size) + 4])
    out = np.full((4, m), np.nan, np.float32)
    lists.sums(terms, query, at, out)
    for i in range(4):
        assert np.allclose(out[i], query[at[i] : at[i + 1]] @ w[terms[at[i] : at[i + 1]]], atol=1e-4)


def test_words_are_lower_cased_cut_and_found_byte_by_byte():
    every = "".join(map(chr, range(1, 128)))
    texts = [every, None, "", "ÀÉ Zz@[`{ AZ", "longer words and WORDS\x0bof\x0cmany\rkinds " * 9, every.upper()]
    w = Words(pa.array(texts, pa.string()), lower=True)
    want = [x.lower() for t in texts for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    assert [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends)] == want
    whole, five = w.prefixes((None, 5))
    assert np.array_equal(whole, w.hashes()) and np.array_equal(five, w.hashes(most=5))
    vocabulary = np.unique(np.concatenate([whole[::2], np.array([0, 1, 2, 3, 1 << 63, (1 << 64) - 1], np.uint64)]))
    for known in (vocabulary, vocabulary[:1], vocabulary[-1:]):
        asked = np.concatenate([whole, five, vocabulary, vocabulary + np.uint64(1)])
        at, hit = toxicity.positions(known, asked)
        assert np.array_equal(hit, np.isin(asked, known)) and np.array_equal(known[at[hit]], asked[hit])


@pytest.mark.parametrize("stress", [1.0, 10.0])
def test_scores_by_brute_force(spark, stress):
    """From texts to scores in plain Python: terms, weights (the query's own stress too), votes, and an isotonic fit by its max-min formula."""
    import math

    rng = random.Random(21)
    texts = [" ".join(rng.choice(["river", "rivers", "out", "and", "seaside", "seas", "the", "Vilest", "vileness"][: 9 if k % 4 == 0 else 7]) for _ in range(rng.randint(2, 12))) for k in range(120)]
    toxic = [int("vile" in t.lower()) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, stress=stress).collect()}
    bags = [Counter(x for w in t.lower().split() for x in ([w, w[:5] + "*"] if len(w) > 5 else [w])) for t in texts]
    df = Counter(w for b in bags for w in b)
    examples = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 5]
    space = {w for k in examples for w in bags[k]}
    n, n1 = len(examples), sum(toxic[k] for k in examples)

    def leans(w):
        a, held = sum(toxic[k] for k in examples if w in bags[k]), sum(w in bags[k] for k in examples)
        b, c, d = held - a, n1 - a, (n - n1) - (held - a)
        chi = n * (a * d - b * c) ** 2 / max((a + b) * (c + d) * (a + c) * (b + d), 1)
        return held >= 4 and chi >= 20 and a / held >= 3 * n1 / n

    times = {w: stress if leans(w) else 1.0 for w in space}
    assert stress == 1 or max(times.values()) == stress
    vectors = [{w: times[w] * (1 + math.log(c)) * (math.log((len(texts) + 1) / (df[w] + 1)) + 1) for w, c in b.items() if w in space} for b in bags]
    size = [math.sqrt(sum(v * v for v in x.values())) for x in vectors]
    prior = (n1 + 0.5) / (len(examples) + 1)

    def vote(k, others):
        cosine = [(-round(sum(v * vectors[e].get(w, 0) for w, v in vectors[k].items()) / size[k] / size[e], 9), e) for e in others]
        near = [(-c, e) for c, e in sorted(cosine)[:15] if c < 0]
        return (sum(c * toxic[e] for c, e in near) + prior) / (sum(c for c, _ in near) + 1)

    raw = sorted((vote(k, [e for e in examples if e != k]), k) for k in examples)
    y = [toxic[k] for _, k in raw]
    mean = lambda a, b: sum(y[a : b + 1]) / (b + 1 - a)
    fitted = [max(min(mean(a, b) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
    pools = defaultdict(list)
    for f, (x, _), t in zip(fitted, raw, y):
        pools[round(f, 12)].append((x, t))
    levels = [sum(x for x, _ in p) / len(p) for _, p in sorted(pools.items())]
    meaning = [(sum(t for _, t in p) + 0.5) / (len(p) + 1) for _, p in sorted(pools.items())]
    for k in range(len(texts)):
        assert got[k] == pytest.approx(float(np.interp(vote(k, examples), levels, meaning)), abs=1e-4), k


def test_every_text_is_compared_with_every_example(spark):
    import math

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["we", "go", "out", "and", "see", "the", "sea", "now"]) for _ in range(rng.randint(2, 9))) + (" vile" if k % 9 == 4 else "") for k in range(90)]
    texts += ["we go out"] * 40  # more equal examples than neighbours
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int("vile" in t)) for k, t in enumerate(texts)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, stress=1.0).collect()}
    bags = [Counter(t.split()) for t in texts]
    df = Counter(w for b in bags for w in b)
    vectors = [{w: (1 + math.log(c)) * (math.log((len(texts) + 1) / (df[w] + 1)) + 1) for w, c in b.items()} for b in bags]
    size = [math.sqrt(sum(v * v for v in x.values())) for x in vectors]
    examples = [k for k in got if not got[k].held_out]
    for k, x in enumerate(vectors):
        cosine = {e: round(sum(v * vectors[e].get(w, 0) for w, v in x.items()) / size[k] / size[e], 5) for e in examples}
        want = sorted(cosine.values(), reverse=True)[:3]
        assert [round(e.similarity, 5) for e in got[k].evidence] == pytest.approx(want, abs=2e-5)
        assert all(cosine[e.doc_id] == pytest.approx(e.similarity, abs=2e-5) for e in got[k].evidence)


def few_rows(seed=0, n=200):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    rows = [np.unique(np.append(rng.integers(10, 60, 5), label if rng.random() < 0.9 else 1 - label)) for label in y]
    return np.concatenate(rows).astype(np.int32), np.array([len(r) for r in rows]), y


def test_log_count_ratios_by_hand():
    columns, counts, y = few_rows()
    got, owner = quality.log_count_ratios(columns, counts, y, 64), np.repeat(np.arange(len(y)), counts)
    p, q = ([1 + sum(1 for c, o in zip(columns, owner) if c == j and y[o] == k) for j in range(64)] for k in (1, 0))
    assert np.allclose(got, [np.log((a / sum(p)) / (b / sum(q))) for a, b in zip(p, q)])


def test_dual_coordinate_descent_reaches_the_optimum():
    """The primal objective at the weights meets the dual objective, which bounds it from below."""
    columns, counts, y = few_rows()
    ratio = quality.log_count_ratios(columns, counts, y, 64)
    w, bias, alpha, limit = quality.dual_coordinate_descent(columns, counts, y, ratio, 1.0, 3000)
    dense, cut = np.zeros((len(y), 64)), np.concatenate([[0], np.cumsum(counts)])
    for k in range(len(y)):
        x = ratio[columns[cut[k] : cut[k + 1]]]
        dense[k, columns[cut[k] : cut[k + 1]]] = x / np.sqrt((x * x).sum())
    sign = np.where(y == 1, 1, -1)
    assert (alpha >= 0).all() and (alpha <= limit + 1e-12).all() and np.allclose(w, (alpha * sign) @ dense) and bias == pytest.approx((alpha * sign).sum())
    norm = (w @ w + bias * bias) / 2
    primal, dual = norm + (limit * np.maximum(0, 1 - sign * (dense @ w + bias))).sum(), alpha.sum() - norm
    assert primal - dual < 0.02 * primal
    model = quality.fit(columns, counts, y, bits=6)
    assert np.allclose(model.margins(columns, counts), dense @ model_weights(columns, counts, y) + model.bias, atol=1e-5)


def model_weights(columns, counts, y):
    ratio = quality.log_count_ratios(columns, counts, y, 64)
    return quality.dual_coordinate_descent(columns, counts, y, ratio, 1.0, 15)[0]


def test_indicators_of_a_text_do_not_depend_on_its_neighbours(rows):
    texts = [r[1] for r in rows]
    columns, counts = quality.indicators(pa.array(texts, pa.string()), 18)
    cut = np.concatenate([[0], np.cumsum(counts)])
    for k, t in enumerate(texts):
        alone, _ = quality.indicators(pa.array([t], pa.string()), 18)
        assert np.array_equal(alone, columns[cut[k] : cut[k + 1]])


def test_equal_texts_have_equal_scores_under_any_partitioning(labelled):
    docs, labels = labelled
    docs = docs.union(docs.selectExpr("doc_id + 10000", "text"))
    model = quality.train(docs, labels)
    scores = defaultdict(set)
    for parts in (1, 3, 11):
        for r in quality.score(docs.repartition(parts), model, 0.3).join(docs.distinct(), "doc_id").collect():
            scores[r.text].add(r.score)
    assert len(scores) > 500 and all(len(x) == 1 for x in scores.values())
    assert quality.train(docs.repartition(9), labels.repartition(5)).shift == pytest.approx(model.shift, abs=1e-9)


def test_folds_hold_both_classes():
    y = np.array([1] * 20 + [0] * 3)
    fold = quality.folds(y)
    assert fold.max() == 2 and all({0, 1} == set(y[fold == k]) for k in range(3)) and quality.folds(np.ones(4)).max() == 0
