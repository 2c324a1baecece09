"""What a worker keeps while it encodes, and after."""

from __future__ import annotations

import gc

import pyarrow as pa

from spindrift.llm import bpe


def test_cached_pieces_are_packed_and_go_with_their_task(spark):
    caught = {}

    class Frame:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, run, ddl):
            caught["run"] = run

    bpe.bpe_round_trip(Frame(), bpe.vocabulary_path(), keep_ids=True)
    words = " ".join(f"w{i:x}" for i in range(2000))
    tasks = caught["run"](iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([words])], names=["doc_id", "text"])]))
    out = next(tasks)
    encoder = next(x for x in gc.get_objects() if isinstance(x, bpe.Encoder))
    assert encoder.young and all(type(ids) is bytes and len(ids) % 4 == 0 for ids in encoder.young.values())
    assert sum(len(x) // 4 for x in encoder.encode(words)) == out.column(1)[0].as_py()
    del encoder
    assert list(tasks) == []
    gc.collect()
    assert not any(isinstance(x, bpe.Encoder) for x in gc.get_objects())
