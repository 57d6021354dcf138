"""Documents packed into batches of a few megabytes, as units that later rounds return to.

A batch is several rows of less than half a megabyte each (a longer document is a row of its own), since executors handle
many such values with less memory than a few large ones.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shelfwise.functions.staging import stage
from shelfwise.llm.shingles import buffers, pieces
from shelfwise.llm.text import whole

BATCH_BYTES = 4 << 20
ROW_BYTES = 400 << 10
#: Texts are written once and shuffled in every round: packed by a better codec than that of shuffles.
CODEC = "zstd"
BATCHES = "batch bigint, ids binary, known binary, offsets binary, text binary, size bigint"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, size = TaskContext.get().partitionId() << 32, 0
    for batch in (piece for every in batches for piece in pieces(every, limit=ROW_BYTES)):
        data, offsets = buffers(batch.column(1))
        ids = batch.column(0)
        if size + len(data) > BATCH_BYTES and size:
            number, size = number + 1, 0
        size += len(data)
        yield pa.RecordBatch.from_pydict({
            "batch": [number], "ids": [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()],
            "known": [ids.is_valid().to_numpy(zero_copy_only=False).tobytes()], "offsets": [offsets.astype(np.int64).tobytes()],
            "text": [pa.compress(data.tobytes(), codec=CODEC, asbytes=True)], "size": [len(data)]})


def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of a task that belong to one batch; a batch that is cut by tasks comes in parts."""
    held: list[dict] = []
    for many in batches:
        for i in range(len(many)):
            row = many.slice(i, 1).to_pylist()[0]
            if held and held[0]["batch"] != row["batch"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def text_batches(docs: DataFrame, label: str) -> DataFrame:
    """A written table of BATCHES rows: doc_ids and whether they are known, text offsets and bytes (null texts empty)."""
    return stage(docs.select("doc_id", whole().alias("text")).mapInArrow(_pack, BATCHES), label)


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, whether they are known, text offsets and text bytes of a batch row."""
    text = pa.decompress(row["text"], decompressed_size=row["size"], codec=CODEC, asbytes=True) if row["size"] else b""
    return (np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), np.frombuffer(row["offsets"], np.int64),
            np.frombuffer(text, np.uint8))
