"""The pipeline, stage by stage, on a small corpus."""

import re
from collections import Counter
from pathlib import Path

import pytest

from skylattice.llm import quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the small tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_output"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER).persist()
        if name != "token_output":
            assert out.columns == names
        if name == "quality":
            kept = {r.doc_id for r in out.collect()}
            known = [i for i in labels if labels[i] is not None]
            assert sum((i in kept) == bool(labels[i]) for i in known) / len(known) > 0.95
        if name in ("quality", "near_duplicates", "decontamination"):
            assert 0 < out.count() < before
            before = out.count()
        if name == "token_output":
            assert out.count() == docs.count() and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        docs = out


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the small tables")
def test_few_labels_still_tell_both_classes(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels.filter("quality IS NOT NULL"), "doc_id").collect()
    assert {r.predicted for r in got} == {0, 1} and sum(r.predicted == r.quality for r in got if r.held_out) >= 0.9 * sum(r.held_out for r in got)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with null and blank texts, null, repeated and far ids, equal rows, a leak, near copies and columns of awkward names."""
    good = [r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").join(spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1"), "doc_id", "left_semi").collect() if len(words(r.text)) > 60][:12]
    item = max(spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect(), key=lambda r: len(words(r.text)))
    texts = [r.text for r in good]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[1]), (1, texts[1]), (0, texts[0]), (100, texts[2] + " more"), (101, None), (102, " \n"), (None, texts[3]), (None, None), (103, texts[4] + "\n" + item.text), (1 << 40, texts[5])]
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}" if k % 5 else None, len(t or ""), "x", {"a": 1}, 7) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `it``em` map<string,int>, of_doc int")


def jaccard(a, b, n=5):
    one, two = ({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set() for w in (words(a.lower()), words(b.lower())))
    return len(one & two) / len(one | two) if one | two else 0.0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the small tables")
def test_stages_on_odd_rows(spark, odd):
    rows = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "near_duplicates", "decontamination", "mixing"):
        assert stages[name](spark, odd, FOLDER).columns == odd.columns and stages[name](spark, odd.limit(0), FOLDER).count() == 0, name
    model = quality.train(odd, spark.read.parquet(f"{FOLDER}/labels.parquet"), "quality", most=8000)
    kept = rows(quality.kept(odd, model, threshold=0.3))
    assert all(words(t) for _, t in kept) and kept <= rows(odd)
    # one row of each component, whatever ids repeat; rows without words or id stay
    near = rows(stages["near_duplicates"](spark, odd, FOLDER))
    known = sorted({(i, t) for i, t in rows(odd) if i is not None and words(t)})
    group = {x: {y for y in known if jaccard(x[1], y[1]) >= 0.8} for x in known}
    for x in known:
        reach, new = {x}, {x}
        while new:
            new = {z for y in new for z in group[y]} - reach
            reach |= new
        assert sum(near[y] for y in reach) == 1 and any(near[y] and y[0] == min(reach)[0] for y in reach)
    assert all(near[i, t] == n for (i, t), n in rows(odd).items() if i is None or not words(t))
    clean = rows(stages["decontamination"](spark, odd, FOLDER))
    assert rows(odd) - clean == Counter({x: n for x, n in rows(odd).items() if x[0] == 103})
    mixed = stages["mixing"](spark, odd, FOLDER)
    taken, held = Counter(), Counter()
    for (i, t), n in rows(mixed).items():
        taken[i] += n * len(words(t))
        assert any(j == i and (u or "").startswith(t) for j, u in rows(odd))  # whole, or cut where the budget ends
    for (i, t), n in rows(odd).items():
        held[i] += n * len(words(t))
    assert all(n <= 2 * held[i] for i, n in taken.items()) and rows(mixed) == rows(stages["mixing"](spark, odd, FOLDER))
    ids = stages["token_output"](spark, odd, FOLDER).collect()
    assert len(ids) == odd.count() and sorted(r.start for r in ids)[0] == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the small tables")
def test_registered():
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert "pipeline" in queries and all(any(q.startswith(f"op{n}_") for q in queries) for n in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(queries)
