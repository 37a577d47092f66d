"""The pipeline's stages on a small table with a case for each, and the whole against brute force."""

import hashlib
from collections import Counter

import pytest
from conftest import prose
from test_documents import brute_kept, brute_literal_leaks, linked_pairs, plain_tokens, poisson, roots

from driftmesh.llm import mixing, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    token = "c80fd45a66f8564ae70609f7b2a26100c80fd45a"
    item = " ".join(f"item{k}" for k in range(30))
    rows = [(i, prose(i, 80), "en", f"src{i % 4}", 1) for i in range(40)]
    rows += [(100, prose(0, 80), "en", "src0", 1), (101, prose(1, 80).replace("w1x40", "other"), "en", "src1", 1)]
    rows += [(102, prose(200, 60) + " " + item, "en", "src2", 1), (103, "short", "en", "src3", 1), (104, None, None, None, None)]
    rows += [(105, prose(201, 60) + f' mail x.1@mail3.example.com token = "{token}" end', "en", "src0", 1)]
    rows += [(106, prose(202, 60) + " # #" * 200, "en", "src1", 1), (40, prose(203, 70), None, None, None), (107, prose(204, 30_000), "en", "src2", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def brute_run(rows, items):
    """(doc_id, copy, text) of all rows, stage by stage."""
    kept = [r for r, ok in zip(rows, brute_kept([(r.text, r.source) for r in rows]), strict=True) if ok]
    words = {r.doc_id: r.text.lower().split() for r in kept}
    label = roots(words, linked_pairs(words))
    kept = [r for r in kept if label[r.doc_id] == r.doc_id]
    bad = brute_literal_leaks({r.doc_id: plain_tokens(r.text) for r in kept}, items)
    kept = [r for r in kept if r.doc_id not in bad]
    texts = {r.doc_id: pii.mask(r.text, pii.find([r.text], pii.trained())[0][1]) for r in kept}
    group = {r.doc_id: r.source if r.source in mixing.TARGETS and r.source else "" for r in kept}
    sizes = Counter(group.values())
    whole = sum(mixing.TARGETS[g] for g in sizes)
    out = []
    for r in kept:
        g = group[r.doc_id]
        u = int(hashlib.md5(f"{r.doc_id}:17".encode()).hexdigest()[:12], 16) / 2.0**48
        out += [(r.doc_id, c, texts[r.doc_id]) for c in range(poisson(u, mixing.TARGETS[g] / whole * len(kept) / sizes[g]))]
    return sorted(out)


def test_stages(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute_run(docs.collect(), {r.item_id: plain_tokens(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()})
    start = docs.columns
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        ids.append({r.doc_id for r in docs.select("doc_id").distinct().collect()})
        if k < 4:
            assert docs.columns == start
            texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(range(41)) <= ids[0] and not {103, 104, 106} & ids[0]
    assert ids[1] == ids[0] - {100, 101}
    assert ids[2] == ids[1] - {102} and ids[3] == ids[2] >= ids[4]
    assert "<email>" in texts[105] and "<secret>" in texts[105]
    got = sorted((r.doc_id, r.copy, r.text) for r in corpus_pipeline.run(spark, folder).select("doc_id", "copy", "text").collect())
    assert got == want == sorted((r.doc_id, r.copy, r.text) for r in docs.select("doc_id", "copy", "text").collect())


def test_an_empty_table_stays_empty(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_nulls_in_every_column_and_extra_columns(spark, frame, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "nothing of this kind stands anywhere else at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame((1, prose(1)), (1, prose(1)), (None, prose(2)), (None, None), (3, prose(3), None), (4, ""), (5, "mail a.b@c.org " + prose(5)))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {1, 3, 5} <= {r.doc_id for r in out.collect()}, name
    assert mixing.stage(spark, docs, "").columns[: len(docs.columns)] == docs.columns
