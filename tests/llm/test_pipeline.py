import random

import corpus_pipeline
from pyspark.sql import functions as F

from edgelake.llm import queries as llm


def test_all_operators_are_registered():
    assert {int(name[2:].split("_")[0]) for name in llm.QUERIES} == set(range(1, 14))
    assert set(llm.ORACLES) <= set(llm.QUERIES)


def test_planted_cases(spark, sf, tmp_path):
    rng = random.Random(11)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").collect()
    words = sorted({w for d in docs for w in d.text.split() if w.isalpha()})
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    own = "\n".join(prose(40) for _ in range(4))
    near = own.split(" ")
    near[70] = "changed"
    passage = prose(70)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    clean = [(9000 + i, "\n".join(prose(30) for _ in range(5))) for i in range(20)]
    planted = [
        (9100, own), (9101, own), (9102, " ".join(near)), (9110, f"{prose(60)}\n{passage}\n{prose(60)}"),
        (9111, f"{prose(60)}\n{passage}\n{prose(60)}"), (9120, f"{prose(60)}\n{item}\n{prose(60)}"), (9130, "win ### | " * 80),
    ]
    more = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in clean + planted], "doc_id long, text string, lang string, source string, n_chars long")
    spark.read.parquet(f"{sf}/documents.parquet").unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = kept.columns, {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        if number < 4:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/stage{number}")
        kept = spark.read.parquet(f"{tmp_path}/stage{number}")
        seen[name] = {r.doc_id: r for r in kept.collect()}
    assert 9130 not in seen["quality_classifier"]
    for name in list(seen)[:4]:
        assert {i for i, _ in clean} <= set(seen[name]), name
    lines = seen["line_dedup"]
    assert 9101 not in lines and passage in lines[9110].text and passage not in lines[9111].text
    assert lines[9111].n_chars == len(lines[9111].text)
    assert 9120 not in seen["decontamination"] and 9100 in seen["decontamination"]
    mixed = seen["mixing"]
    assert set(mixed) <= set(seen["decontamination"]) and all(r.copies >= 1 and r.taken == r.size * r.copies for r in mixed.values())


def test_run_equals_its_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and len({(r.doc_id, r["copy"]) for r in rows}) == len(rows)
    assert all(r["copy"] < r.copies and r.shards[r["copy"]] == r.shard for r in rows)


def test_columns_of_clashing_names_keep_their_values(spark, sf):
    names = ["_key", "_salt", "_salts", "keep", "_keep", "_deleted", "_lines", "_text", "_row", "_id", "size", "copies", "kept", "component_id", "label", "score"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 80")
    marked = docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, marked, sf)
        rows = out.collect()
        assert rows and out.columns[: len(marked.columns)] == marked.columns, name
        assert all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in names), name
    assert {"mix_size", "mix_copies", "taken"} <= set(out.columns)


def test_no_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
        docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
