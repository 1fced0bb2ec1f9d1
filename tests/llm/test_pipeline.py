import pytest

from tests.llm import cases

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _folder(spark, tmp_path, rows):
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 1, int("idiot" in (r[1] or ""))) for r in rows], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, cases.words(20, 77))], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_each_stage_takes_effect(spark, tmp_path):
    rows = [cases.row(i, cases.words(40, 1000 + i)) for i in range(120)]
    rows += [cases.row(1000 + i, f"{cases.words(30, 2000 + i)} idiot {cases.words(30, 3000 + i)} scum idiot") for i in range(150)]
    rows += [cases.row(300 + i, rows[i][1]) for i in range(5)]
    rows += [cases.row(400, f"{cases.words(30, 4000)} {cases.words(20, 77)}"), cases.row(401, None), cases.row(402, "12 34"), cases.row(403, "")]
    folder = _folder(spark, tmp_path, rows)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == COLUMNS
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert seen["language"] == {r[0] for r in rows} - {401, 402, 403}
    assert seen["toxicity"] == seen["language"] - set(range(1000, 1150))
    assert seen["near_duplicates"] == seen["toxicity"] - set(range(300, 305))
    assert seen["decontamination"] == seen["near_duplicates"] - {400}
    assert seen["mixing"] == seen["decontamination"]


def test_empty_tables(spark, tmp_path):
    folder = _folder(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_take_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    """Every stage keeps all columns of any name, and of rows that nothing speaks against all but copies."""
    rows = [cases.row(i, cases.words(40, 1000 + i)) for i in range(100, 160)]
    folder = _folder(spark, tmp_path, rows)
    schema = cases.SCHEMA.replace("digest string", "c0 string").replace("node long", "_n long").replace("label int", "kept_id int").replace("raw double", "lang_pred string") + ", C1 int"
    extra = ("x", 7, 1, 2, "k", "fr", 3, 4, 5, 6, 8)
    odd = [r[:5] + (0.5, *extra) for r in rows + cases.ROWS]
    docs = spark.createDataFrame(odd, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        found = docs.collect()
        assert all(r.score == 0.5 and r.c0 == "x" and r.lang_pred == "fr" and r.C1 == 8 for r in found), name
        if name == "language":
            assert before - len(found) == sum(not any(map(str.isalpha, r[1] or "")) for r in cases.ROWS)
        elif name == "near_duplicates":
            assert sorted(r.doc_id for r in found if r.doc_id in (1, 11, 12)) == [1, 11]
        else:
            assert len(found) == before, name
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(mixed) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in mixed)


def test_stages_hand_rows_to_workers_in_small_batches(spark, tmp_path):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    folder = _folder(spark, tmp_path, [cases.row(i, cases.words(40, 1000 + i)) for i in range(3)])
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(setting)
        stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        texts = spark.range(0, 60, 1, 1).selectExpr("repeat(cast(id as string), 200000) as text")
        sizes = [r["n"] for r in texts.mapInArrow(_sizes, "n long").collect()]
        assert sum(sizes) > 15e6 and max(sizes) < 4e6
    spark.conf.unset(setting)


def _sizes(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})
