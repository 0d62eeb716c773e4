"""The pipeline against its stages' brute-force versions, on a small fixture."""

import hashlib
import os

import brute
import fixtures
import pytest

import corpus_pipeline
from attriva.llm import pii, toxicity


@pytest.fixture
def sf_dir(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = fixtures.rows() + [(100 + i, " ".join(fixtures.words(rng, 40, 3000) + (["idiot"] if i % 3 == 0 else [])), "en", "s", 0, 0, "", "") for i in range(240)]
    item = fixtures.words(rng, 30, 9000)
    rows += [(900, " ".join(item), "en", "s", 0, 0, "", ""), (901, "write to a@b.co or +49 30 1234567 now", "en", "s", 0, 0, "", "")]
    fixtures.frame(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}", rows, " ".join(item)


def test_against_brute_force(spark, sf_dir):
    import base64

    import public_tokenizers
    import tiktoken

    d, rows, item = sf_dir
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity_scores(docs, toxicity.train(docs, labels)).collect() if r.predicted}
    assert len(toxic & set(range(100, 340))) > 60
    kept = [(r[0], r[1]) for r in rows if r[0] not in toxic]
    groups = brute.jaccard_components(kept)
    kept = [r for r in kept if groups[r[0]][1] == r[0]]
    bad = brute.contamination(kept, [(1, item), (2, None)])
    kept = [(i, pii.redacted(t)) for i, t in kept if not bad[i][4]]
    assert 900 not in {i for i, _ in kept}
    table = {base64.b64decode(x): int(n) for x, n in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    known = tiktoken.Encoding("known", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    want = sorted((i, len(known.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in kept)
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got) == want
    assert next(r for r in got if r.doc_id == 901).decoded_sha256 == hashlib.sha256(b"write to [EMAIL] or [PHONE] now").hexdigest()


def test_stages_keep_the_columns(spark, sf_dir):
    d, _, _ = sf_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
        assert stage(spark, docs.limit(0), d).collect() == []


def test_later_stages_begin_with_a_full_collection(spark, sf_dir):
    d, _, _ = sf_dir
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = next(b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        before = full.getCollectionCount()
        stage(spark, docs, d)
        assert full.getCollectionCount() > before


def test_entry_registers_everything():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {k.split("_")[0] + "_" for k in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert os.path.exists(corpus_pipeline.__file__)
