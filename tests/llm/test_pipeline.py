import random

import corpus_pipeline
from filamenta.llm import packing
from filamenta.session import staged

WORDS = [f"word{i}" for i in range(400)]


def _tables(spark, folder):
    rng = random.Random(8)
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(60, 120)))
        if i % 8 == 0:
            text += " horridword vileword horridword"
        if i % 10 == 3:
            text += f" password=abcdef{i}"
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b"]), len(text)))
    rows += [(500 + k, rows[k][1], *rows[k][2:]) for k in range(1, 6)]
    rows += [(900, None, None, None, None), (901, "", "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 8 == 0)) for r in rows if r[0] < 160 and r[0] % 3], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_every_stage_takes_effect(spark, tmp_path):
    rows = _tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before.count()
    ids = lambda d: {r.doc_id for r in d.collect()}
    toxic = {r[0] for r in rows if r[0] < 160 and r[0] % 8 == 0}
    clean = {r[0] for r in rows} - toxic
    kept = ids(seen["toxicity"])
    assert len(kept & toxic) <= 2 and len(clean - kept) <= 4
    unique = ids(seen["near_duplicates"])
    assert all((k in unique) + (500 + k in unique) <= 1 for k in range(1, 6)) and len(unique & {900, 901}) <= 1
    assert ids(seen["secrets"]) == unique and not [r for r in seen["secrets"].collect() if r.text and "password=" in r.text]
    assert ids(seen["mixing"]) <= unique
    final = seen["packing"].collect()
    assert {r.doc_id for r in final} == ids(seen["mixing"])
    assert len({r.sequence_id for r in final}) == -(-sum(r.length for r in final) // packing.LENGTH)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r.doc_id for r in final}


def test_empty_table_and_clashing_columns(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, base string, loose string, row string, component_id long, spans string"
    empty = spark.createDataFrame([], kind)
    empty.write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    rows = [(i, f"some words {i} stand in this text token=abcdefgh{i} " + "long " * (20_000 if i == 3 else 1), "en", "a", 1, 0.5, "k", "b", "l", "r", i, "s") for i in range(30)]
    docs = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, f"{tmp_path}/empty"), name)
        assert docs.schema == empty.schema
        assert {r[5:10] + r[11:] for r in docs.collect()} == {(0.5, "k", "b", "l", "r", "s")}
        assert all(r.component_id == r.doc_id for r in docs.collect())
