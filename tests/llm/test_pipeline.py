"""run() against brute force: every stage on all that the one before kept."""

import hashlib

import numpy as np

import corpus_pipeline
from budgetsieve.llm import common, decontamination, line_dedup, quality
from test_operators import brute_contamination, brute_links


def test_run(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    kept = [(i, t) for i, t in rows if model.tails(np.array([float(model.weights[quality.features(t)].sum(dtype=np.float64))]))[0, -1] >= 0.5]
    holders = {}
    for i, t in kept:
        for x in t.split("\n"):
            if k := line_dedup.key_of(x):
                holders.setdefault(k, set()).add(i)
    kept = [(i, "\n".join(x for x in t.split("\n") if (k := line_dedup.key_of(x)) is None or i == min(holders[k]))) for i, t in kept]
    links = brute_links(kept, 5, 80)
    kept = [(i, t) for i, t in kept if links[i][1] == i]
    items = [tuple(r) for r in common.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    bad = {r[0] for r in brute_contamination(kept, items) if r[5]}
    kept = {i: t for i, t in kept if i not in bad}

    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()}
    assert 0 < len(got) < len(rows)


def test_stages_keep_columns(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.where("n_chars <> char_length(text)").count() == 0


def test_empty_documents(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        common.table(spark, sf_dir, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
