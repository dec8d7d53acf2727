"""What a Python worker holds of a batch of texts."""

import inspect

import pyarrow as pa
from pyspark.sql import functions as F

from cartulary.operators import search, structure


def test_chunks_leave_before_all_are_made(spark, monkeypatch):
    texts = ["line one\nline two", None, "", "é" * 30 + "\n\nx", "a\n" * 50]
    monkeypatch.setattr(structure, "PART_BYTES", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c", "d", "e"]), pa.array(texts)], names=["doc_id", "text"])
    out = list(structure._chunk_batches([batch], 10))
    want = [(d, i, c) for d, t in zip("abcde", texts, strict=True) for i, c in enumerate(structure.chunks(t or "", 10))]
    assert [(r["doc_id"], r["pos"], r["chunk"]) for b in out for r in b.to_pylist()] == want
    assert len(out) > 5 and max(b.num_rows for b in out) <= 2
    got = structure.chunked(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), 10)
    assert sorted((r.pos, r.chunk) for r in got.collect()) == sorted((i, c) for _, i, c in want)


def test_words_go_to_python_as_one_string(spark):
    df = spark.createDataFrame([("The well-known Works of 3.5 cats",), ("the",), ("",), (None,), ("...",)], "t string")
    got = [r[0] for r in df.select(search.lexemes(F.col("t"))).collect()]
    assert got == [[None, "well-known", "well", "known", "work", None, "3.5", "cat"], [None], [], [], []]
    assert ".split(" in inspect.getsource(search._lexemes.func)
