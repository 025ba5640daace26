"""The stages of the pipeline keep what they should, in order."""

import os

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    from threadloom.llm import ngram_join, packing, secrets, toxicity
    from threadloom.llm.common import written

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "secret_scan", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, DATA))
        assert after.schema.names == docs.schema.names, name
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert after.count() == sum(model.score(r["text"] or "") < toxicity.THRESHOLD for r in before.collect())
        if name == "line_dedup":
            assert after.count() == before.count()
        if name == "ngram_jaccard_join":
            joined = ngram_join.join(before).where("doc_id = component_id").count()
            assert after.count() == joined
        if name == "secret_scan":
            assert after.count() == before.count()
            assert not [r for r in after.collect() if secrets.base_spans((r["text"] or "").replace(secrets.MASK, ""))]
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, DATA).collect()
    encode = packing.encoder(packing.default_vocabulary())
    assert sum(r["length"] for r in packed) == sum(len(np.append(encode(r["text"] or ""), 0)) for r in before.collect())
    assert corpus_pipeline.run(spark, DATA).count() == len(packed)


def test_one_of_many_copies_keeps_its_text(spark):
    copy = "\n".join(f"line {i} of a text that fills its source with copies" for i in range(6))
    rows = [(i, copy, "s") for i in range(40)] + [(100 + i, f"menu\nown words {i} of page {i} go here {i * i}", "s") for i in range(60)] + [(200, "\n \n", "s")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars long")
    lines = corpus_pipeline.drop_lines(spark, docs, "")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()}
    assert got[0] == got[39] == (copy, len(copy)) and got[100][0] == "own words 0 of page 0 go here 0" and got[200][0] == "\n \n"
    left = [r["text"] for r in corpus_pipeline.drop_near_copies(spark, lines, "").collect()]
    assert left.count(copy) == 1 and len(left) == 62


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    nasty = ["you are a vile worthless idiot", "what a disgusting stupid moron", "shut up you pathetic idiot scum"]
    kind = ["the garden was lovely in spring", "they met at the old market", "we share a table by the sea"]
    own = lambda i: " ".join(f"w{(i * k) % 97}" for k in range(1, 12))
    rows = [(i, f"{(nasty if i % 2 else kind)[i % 3]} {own(i)}", "s", "n", 1) for i in range(240)]
    odd = [(500, None, "s", "n", 1), (501, "", None, "n", 1), (None, "no id " + own(3) + " and more", "s", "n", 1), (502, "long " + "word and other " * 60_000, "s", None, 1), (503, "same words here as there", "s", "n", 1), (503, "same words here as there", "s", "n", 1), (504, "token: abcdefgh1 is the key", "s", "n", 1), (505, "a" + "\n" * 1_200_000 + "b", "s", "n", 1), (506, " " * 1_200_000, "s", "n", 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, source string, Score string, gone int").repartition(3)
    spark.createDataFrame([(i, i % 2) for i in range(240)] + [(None, 1), (500, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    from threadloom.llm.common import written

    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, str(tmp_path)))
        assert after.columns == docs.columns, name
        before = after
    left = before.collect()
    ids = [r["doc_id"] for r in left]
    text = {r["doc_id"]: r["text"] for r in left}
    assert sum(i is not None and i < 240 and i % 2 for i in ids) == 0 and sum(i is not None and i < 240 for i in ids) >= 100
    assert ids.count(503) == 2 and text[500] is None and text[501] == "" and text[None].startswith("no id") and len(text[502]) > 800_000
    assert text[504] == "[SECRET] is the key"
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(ids)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_workers_get_small_batches_of_large_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    from threadloom.llm import ngram_join, packing, secrets, toxicity
    from threadloom.llm.common import BATCH, BATCH_BYTES, mapped

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    def docs(session):
        return session.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word ")), F.when(F.col("id") == 7, 900_000).otherwise(500)).alias("text"))

    # every stage that hands texts to Python sets the bound, where its session has none
    small = [(0, "some words"), (1, None)]
    for stage in (packing.pack, secrets.redact, secrets.spans, ngram_join.join, lambda d: toxicity.score(d, toxicity.Model({}, 0.0))):
        session = spark.newSession()
        assert stage(session.createDataFrame(small, "doc_id long, text string")).count() == 2
        assert int(session.conf.get(BATCH).rstrip("b")) == BATCH_BYTES
    session = spark.newSession()
    got = mapped(docs(session), sizes, "n long, size long").collect()
    longest = max(r["size"] for r in got)
    assert sum(r["n"] for r in got) == 4000 and longest > 5_000_000 and all(r["size"] < BATCH_BYTES + 100_000 for r in got if r["size"] != longest)
    # the session's own bound holds, and what is packed does not depend on it
    other = spark.newSession()
    other.conf.set(BATCH, "64m")
    rows = [sorted(packing.pack(docs(s).where("doc_id < 900")).collect()) for s in (session, other)]
    assert rows[0] == rows[1] and other.conf.get(BATCH) in ("64m", "67108864b")
