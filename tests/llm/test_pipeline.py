"""The pipeline stage by stage, against brute-force versions of what each stage keeps."""

import os
import re

import corpus_pipeline
import pytest

from tests.llm.test_operators import brute_components, brute_hits


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialise(stage(spark, out[-1], sf_dir), "test"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_all_but_the_last_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert stages[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_toxic_texts_go(spark, sf_dir, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = texts(stages[1])
    wrong = sum((i in kept) == bool(y) for i, y in labels.items())
    assert wrong <= 0.1 * len(labels)


def test_one_of_each_group_stays(stages):
    want = {i for i, (_, c) in brute_components(texts(stages[1]), **corpus_pipeline.NEAR).items() if i == c}
    assert set(texts(stages[2])) == want


def test_contaminated_texts_go(spark, sf_dir, stages):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {i for i, h in brute_hits(texts(stages[2]), items).items() if not h[4]}
    assert set(texts(stages[3])) == want


def test_mixture_takes_its_part(stages):
    n = lambda df: sum(len((t or "").split()) for t in texts(df).values())
    assert 0.89 <= n(stages[4]) / n(stages[3]) <= 1
    assert set(texts(stages[4])) < set(texts(stages[3]))


def test_records_hold_all(stages):
    rows = stages[5].orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == sorted(texts(stages[4]))
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {tuple(r) for r in stages[-1].collect()}
    assert os.path.exists(corpus_pipeline.__file__)


def test_near_copies_go_from_four_fifths_of_five_word_shingles(spark):
    """Brute force by hand: 196 of 236 shingles, 9 of 9 + 2 * 5 of a short text (too few), 45 of 55 by one changed word."""
    long, short, medium = ([f"{k}{i}" for i in range(n)] for k, n in (("a", 200), ("b", 18), ("c", 54)))
    changed = lambda w, at: [*w[:at], "new", *w[at + 1 :]]
    rows = [long, [*long, *(f"d{i}" for i in range(40))], short, changed(short, 9), medium, changed(medium, 27)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    kept = corpus_pipeline.jaccard_join(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4]


def test_kept_texts_are_apart_by_brute_force(stages):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, t in texts(stages[2]).items() if (w := [x for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))])}
    ids = sorted(sets)
    assert not [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
