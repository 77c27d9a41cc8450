"""The pipeline stage by stage against brute force, on ordinary, odd and empty tables."""

import random
from collections import Counter

import pytest
from oddities import TEXTS, odd
from test_classifiers import SMALL, sentences
from test_dedup import near_classes

import corpus_pipeline
from gridfold.llm import langid, mixing


def tables(spark, tmp_path, n):
    rng = random.Random(8)
    items = [(i, sentences(rng, "en", 25).capitalize() + ".") for i in range(4)]
    rows = []
    for i in range(n):
        lang = rng.choice(list(SMALL))
        text = sentences(rng, lang, rng.randrange(30, 90))
        if i % 10 == 0:
            text += " " + items[i % 4][1] + " " + sentences(rng, lang, 12)
        rows.append((1000 + i, text, lang, "hot" if i % 3 else f"s{i % 5}"))
        if i % 7 == 0:
            rows.append((3000 + i, text.upper() if i % 2 else text, lang, "hot"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").unionByName(odd(spark).select("doc_id", "text", "lang", "source")).selectExpr("*", "cast(length(text) as long) as n_chars", "1 as _gridfold", "2 as shard") if n else odd(spark).limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return items


def test_stages(spark, tmp_path):
    items = tables(spark, tmp_path, 120)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [r.asDict() for r in docs.collect()]
        out[name] = (before, after)
        if name != "sharding":
            assert docs.columns == columns
    before, after = out["language_filter"]
    gone = Counter(r["doc_id"] for r in before) - Counter(r["doc_id"] for r in after)
    assert {3, 4, 5, 7} <= set(gone) and sum(gone.values()) <= 6
    before, after = out["near_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None]
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(set(near_classes(rows).values()))
    before, after = out["decontamination"]
    held = {r["doc_id"] for r in before if any(item.lower() in r["text"].lower() for _, item in items)}
    assert held and {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == held
    before, after = out["mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.read.parquet(str(tmp_path / "decontamination"))).collect()}
    assert Counter(r["doc_id"] for r in after) == Counter({k: v for k, v in copies.items() if v})
    before, after = out["sharding"]
    assert Counter(r["doc_id"] for r in before) == Counter(r["doc_id"] for r in after)
    for shard in {r["shard"] for r in after}:
        own = sorted(r["slot"] for r in after if r["shard"] == shard)
        assert own == list(range(len(own)))


def test_run_is_the_stages_in_turn(spark, tmp_path, monkeypatch):
    tables(spark, tmp_path, 0)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    calls = []
    stages = [(n, lambda s, d, f, n=n: calls.append(n) or d) for n, _ in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0 and calls == [n for n, _ in stages]


def test_stage_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["language_filter", "near_dedup", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None and set(corpus_pipeline.queries()) == {"pipeline"} and len(TEXTS) == 11
    assert langid.LEAST_SCORE == pytest.approx(0.4)
