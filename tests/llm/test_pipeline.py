"""Each stage of the pipeline against what its operator says of its own input."""

import corpus_pipeline as P
from cartulary.llm import line_dedup, passage_quality, secret_scans, shingle_join
from cartulary.llm.shared import Scratch, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch = Scratch(spark, "test")
    docs = table(spark, SF, "documents")
    outs = [docs]
    for _, stage in P.STAGES:
        outs.append(scratch.write(stage(spark, outs[-1], SF)))
    assert all(o.columns == list(P.COLUMNS) for o in outs[:-1])
    scored = passage_quality.score(outs[0], passage_quality.trained(outs[0], table(spark, SF, "labels")))
    assert {r.doc_id for r in outs[1].collect()} == {r.doc_id for r in scored.where("predicted = 1").collect()}
    cut = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup.dedup(outs[1], Scratch(spark, "test")).collect()}
    left = {r.doc_id: r.text for r in outs[2].collect()}
    assert left == {d: t for d, (t, n) in cut.items() if n == 0 or t.strip()}
    groups = {r.doc_id: r.component_id for r in shingle_join.linked(outs[2], Scratch(spark, "test")).collect()}
    assert {r.doc_id for r in outs[3].collect()} == {d for d, c in groups.items() if d == c}
    masked = {r.doc_id: r.text for r in outs[4].collect()}
    assert masked.keys() == {r.doc_id for r in outs[3].collect()}
    assert secret_scans.scan(outs[4]).where("size(spans) > 0").count() == 0
    assert {r.doc_id for r in outs[5].collect()} == masked.keys()


def test_empty_and_null(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b", "en", "s", 3)], table(spark, SF, "documents").schema)
    for _, stage in P.STAGES[1:]:
        odd = stage(spark, odd, SF)
    assert odd.select("doc_id").distinct().count() == 2
