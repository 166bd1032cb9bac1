"""The pipeline's stages against plain Python on what their operators say, and on odd and empty tables."""

import collections
import math

import pytest
import sentencepiece
from nichegrid.llm import chaining, mixing, quality
from nichegrid.llm.queries import SENTENCEPIECE_MODEL
from pyspark.sql import functions as F

import corpus_pipeline

from .test_minhash import brute

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_quality_keeps_what_the_classifier_predicts(spark, table):
    scores = {r["doc_id"]: r["score"] for r in quality.classify(table, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    got = {r["doc_id"] for r in corpus_pipeline.good_quality(spark, table, SF).collect()}
    assert got == {i for i, s in scores.items() if s >= 0.3} and 0 < len(got) < len(scores)


def test_passages_leave_by_words(spark, table):
    spans = collections.defaultdict(list)
    for r in chaining.passages(table).collect():
        spans[r["doc_id"]].append((r["start"], r["end"]))
    want = {}
    for r in table.collect():
        gone = {i for a, z in spans[r["doc_id"]] for i in range(a, z)}
        out, word, inside = [], -1, False
        for c in r["text"] or "":
            if c not in SPACE:
                word += not inside
                inside = True
            else:
                inside = False
            if word not in gone:
                out.append(c)
        left = "".join(out)
        if not gone or left.strip(SPACE):
            want[r["doc_id"]] = left if r["text"] is not None else None
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_repeated_passages(spark, table, SF).collect()}
    assert got == want and any(spans.values())


def test_mix_takes_whole_documents(spark, table):
    want = {r["doc_id"]: math.ceil(r["taken"] / r["size"]) if r["size"] else 0 for r in mixing.mix(table).collect()}
    got = collections.Counter(r["doc_id"] for r in corpus_pipeline.mixed(spark, table, SF).collect())
    assert got == {i: n for i, n in want.items() if n} and max(got.values()) <= 2


def test_odd_and_empty_tables(spark, odd, empty):
    for docs, most in ((odd, 10), (empty, 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF)
            assert after.columns == docs.columns and after.count() <= most
        assert corpus_pipeline.token_ids(spark, docs, SF).count() == docs.count()


def test_near_duplicates_leave_by_brute_force(spark, table):
    """Sets of five-word shingles, all pairs."""
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    want = {i for i, (_, _, kept) in brute(texts, 5, 80).items() if kept}
    got = corpus_pipeline.without_near_duplicates(spark, table, SF).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {i: texts[i] for i in want} and len(got) == len(want) < len(texts)


def test_columns_named_like_helpers(spark, table):
    docs = table.limit(30).withColumns({c: F.lit(1) for c in ("own", "times", "copy", "_own", "gone", "alone", "_id", "_times", "_copy")})
    for stage in (corpus_pipeline.without_near_duplicates, corpus_pipeline.mixed):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.count() > 0


def test_whole_pipeline_is_its_stages_in_order(spark, table):
    """The last stage's ids are those of the texts that the earlier ones leave, one row each, and give these texts back."""
    docs, seen = table, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), table.schema)
        seen.append(docs.count())
    assert [name.split(" ")[0] for name, _ in corpus_pipeline.STAGES] == ["quality", "MinHash", "substring", "mixing", "SentencePiece"]
    assert table.count() > seen[0] > seen[1] >= seen[2]
    model = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    left = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in left.elements())
    texts = dict(left)
    ids = {r["doc_id"]: list(r["ids"]) for r in got}
    for doc_id, text in texts:
        assert model.decode(ids[doc_id]).split() == (text or "").split()
