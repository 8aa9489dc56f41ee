"""Texts of a batch are encoded a bounded number at a time."""

import pyarrow as pa

from polysense.llm import packing, queries


def test_a_large_batch_is_handed_on_in_parts_with_the_same_rows():
    path, pattern = queries.vocabulary()
    texts = [None if i % 7 == 0 else f"word {i} " * (i % 50) for i in range(2 * packing.TEXTS + 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    encode = packing._encode(path, pattern, queries.SPECIAL, packing.WINDOW, packing.END_ID)
    parts = list(encode(iter([batch])))
    assert [p.num_rows for p in parts] == [packing.TEXTS, packing.TEXTS, 5]
    got = [r for p in parts for r in p.to_pylist()]
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    coder = packing.load_encoder(path, pattern, queries.SPECIAL)
    assert [r["doc_tokens"] for r in got] == [len(coder(t or "")) + 1 for t in texts]
