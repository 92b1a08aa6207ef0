"""The pipeline against its stages' plain versions."""

import numpy as np
import pytest
from test_text import brute_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, data, docs, vocab):
    from murmura.llm import kn_quality, language_id

    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stays = {r["doc_id"] for r in kn_quality.judge(docs, spark.read.parquet(f"{data}/labels.parquet")).where("accepted").collect()}
    kept = corpus_pipeline.quality(spark, docs, data)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == stays
    kept = corpus_pipeline.language(spark, kept, data)
    left = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    assert set(left) <= stays and len(left) > 0.9 * len(stays)
    comp, _ = brute_components(left, [rows[i] for i in left])
    kept = corpus_pipeline.near_duplicates(spark, kept, data)
    final = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns and final == {i for i in left if comp[i] == i}
    got = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in got} == final
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "near-duplicates", "best-fit packing"]


def test_pipeline_edges(spark, data, edge_docs, no_docs, tmp_path):
    spark.createDataFrame([(4, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (edge_docs, no_docs):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, str(tmp_path))
            assert after.columns == docs.columns
            docs = after
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()


def test_languages_not_learnt_and_gibberish_go(spark, data, docs):
    rng = np.random.default_rng(1)
    letters, marks = list("abcdefghijklmnopqrstuvwxyz"), list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    texts = [
        "La mattina il mercato si riempie di gente che compra frutta e verdura, mentre i bambini giocano vicino alla fontana della piazza e gli anziani parlano del tempo.",
        "Rano rynek wypełnia się ludźmi, którzy kupują owoce i warzywa, a dzieci bawią się przy fontannie na placu, podczas gdy starsi rozmawiają o pogodzie.",
        "Aamulla tori täyttyy ihmisistä, jotka ostavat hedelmiä ja vihanneksia, ja lapset leikkivät aukion suihkulähteen luona vanhusten puhuessa säästä.",
        "Sabah pazar meyve ve sebze alan insanlarla dolar, çocuklar meydandaki çeşmenin yanında oynarken yaşlılar havadan konuşur.",
        " ".join("".join(rng.choice(letters, rng.integers(2, 10))) for _ in range(60)),
        "".join(rng.choice(marks, 500)),
    ]
    odd = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.language(spark, docs.unionByName(odd, allowMissingColumns=True), data)
    left = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert not [i for i in left if i >= 10**9] and len(left) >= 0.97 * docs.count()
