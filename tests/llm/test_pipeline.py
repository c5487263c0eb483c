"""The pipeline on a table whose rows have known fates, stage by stage."""

import pyarrow as pa
import pyarrow.parquet as pq
from compare import DATA

import corpus_pipeline

ITEM = "the quick brown fox jumps over one lazy dog while eleven small birds sing near an old stone bridge at dawn and then fly far away"


def test_stages_of_the_real_table(spark):
    """Each stage over what the one before kept; all but the last keep the columns."""
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.toPandas(), docs.schema)
            assert 0.7 * before < docs.count() <= before, name
            before = docs.count()
        else:
            assert set(docs.columns) | {"copy", "shuffle_key"} == set(out.columns)
    assert 0.8 * before < out.count() < 1.2 * before


def test_planted_rows(spark, tmp_path):
    base = [r for r in pq.read_table(f"{DATA}/sf0.001/documents.parquet").to_pylist() if len(r["text"]) > 400][:80]
    rows = [dict(r, doc_id=k, text=r["text"]) for k, r in enumerate(base)]
    long = base[0]["text"]
    rows += [dict(rows[0], doc_id=1000), dict(rows[0], doc_id=1001, text=long + " x")]
    rows += [dict(rows[1], doc_id=1002, text=f"{rows[1]['text'][:200]} {ITEM} end"), dict(rows[2], doc_id=1003, text="12345 !!"), dict(rows[2], doc_id=1004, text=None, n_chars=None)]
    rows += [dict(rows[3 + k], doc_id=2000 + k, text=f"{rows[3 + k]['text'][:150]} q{k}\nA line that stands everywhere") for k in range(12)]
    pq.write_table(pa.Table.from_pylist(rows, pq.read_schema(f"{DATA}/sf0.001/documents.parquet")), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [ITEM]}), tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path)).toPandas()
        kept[name] = {int(i): t for i, t in zip(out.doc_id, out.text, strict=True)}
        docs = spark.createDataFrame(out, docs.schema)
    assert 1003 not in kept["language_id"] and 1004 not in kept["language_id"] and 1000 in kept["language_id"]
    assert all("everywhere" not in kept["line_dedup"][2000 + k] for k in range(12))
    assert not {1000, 1001} & set(kept["simhash_near_dedup"]) and 0 in kept["simhash_near_dedup"]
    assert 1002 in kept["simhash_near_dedup"] and 1002 not in kept["benchmark_decontamination"]
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert set(final.toPandas().doc_id) <= set(kept["benchmark_decontamination"])
