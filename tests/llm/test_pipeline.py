"""The pipeline's stages one by one, each against what it must do to its input."""

import public_tokenizers

import corpus_pipeline as P
from larder.llm import credentials
from tests.llm.cases import ROWS, no_documents, odd_documents
from tests.llm.test_operators import plain_groups

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    frames = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        frames[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    calm = {r["doc_id"] for r in frames["toxicity"].collect()}
    assert calm <= before.keys() and len(calm) > 0.8 * len(before)
    groups = plain_groups([(i, before[i]["text"]) for i in calm], P.SHINGLE, P.PERCENT)
    kept = {i for i, (_, _, k) in groups.items() if k}
    assert {r["doc_id"] for r in frames["near_duplicates"].collect()} == kept
    for r in frames["secrets"].collect():
        text = before[r["doc_id"]]["text"]
        assert r["text"] == credentials.redact(text, credentials.spans(text)[1]) and r["n_chars"] == len(r["text"])
    assert sorted(map(str, frames["mixing"].collect())) == sorted(map(str, frames["secrets"].collect()))
    last = {r["doc_id"]: r for r in frames["bpe"].collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in frames["mixing"].collect():
        assert last[r["doc_id"]]["n_tokens"] == len(t.encode(r["text"], add_special_tokens=False).ids)
    assert len(last) == len(kept)


def test_result_has_the_order_of_the_mix(spark, tmp_path):
    """Ordered by slot and place, the encoded rows follow the schedule, whether the mix is read from its files or not."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(5)
    mixed = P.mix_sources(spark, docs, FOLDER)
    want = [r["doc_id"] for r in P.mixing.schedule(docs, P.mixing.tempered(docs)).orderBy("slot", "place").collect()]
    mixed.write.parquet(str(tmp_path / "mixed"))
    for rows in (mixed, spark.read.parquet(str(tmp_path / "mixed"))):
        assert [r["doc_id"] for r in P.encode(spark, rows, FOLDER).orderBy("slot", "place").collect()] == want


def test_odd_and_empty_documents(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_documents(spark), no_documents(spark)):
        columns, n = docs.columns, docs.count()
        for name, stage in P.STAGES:
            docs = stage(spark, docs, str(tmp_path)).cache()
            if name != P.STAGES[-1][0]:
                assert docs.columns == columns
        # 2 is a copy of 1, its repeat goes with it, 8 is a near copy of 7
        assert docs.count() == (len(ROWS) - 3 if n else 0)


def test_result_depends_on_the_order_of_the_mix(spark, tmp_path):
    """Positions are those of the rows as the mixing stage wrote them; without that stage they are others."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(3, "doc_id")
    mixed, plain = P.mix_sources(spark, docs, FOLDER), docs.orderBy("doc_id")
    want = [[r["doc_id"] for r in frame.collect()] for frame in (mixed, plain)]
    assert want[0] != want[1]
    for frame, order in zip((mixed, plain), want):
        frame.write.mode("overwrite").parquet(str(tmp_path / "rows"))
        for rows in (frame, spark.read.parquet(str(tmp_path / "rows"))):
            got = P.encode(spark, rows, FOLDER).orderBy("position").collect()
            assert [r["doc_id"] for r in got] == order and [r["position"] for r in got] == list(range(len(order)))
