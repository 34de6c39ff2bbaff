"""BPE encoding and decoding of whole texts over the automaton of bpe.py."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.bpe import ByteBPE, default_path, load
from netsift.llm.common import release, table, texts_of

#: Documents of one returned batch.
BATCH = 256


def decoded(codec: ByteBPE, labels: pa.Array, ids: pa.ListArray) -> pa.Array:
    """The texts of lists of ids: arc labels one after another; codec.decode where these are no UTF-8."""
    spelled = labels.take(ids.values)
    if not len(spelled):
        return pa.array([""] * len(ids), pa.large_string())
    ends = np.frombuffer(spelled.buffers()[1], np.int64)[np.asarray(ids.offsets)]
    texts = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(ends), spelled.buffers()[2])
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        texts = pa.array([codec.decode(x) for x in ids.to_pylist()], pa.large_string())
    return texts


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids: array<int>, decoded: string) of every row of docs.

    ids are those of the tokenizers library without added special tokens,
    truncation or padding; a special string within a text becomes its id.  A null
    text is the empty one, with no ids.  decoded spells ids by their labels and
    equals the text.  Rows stay as they are, repeated ones too; empty input, no rows.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        labels = pa.array(codec.labels, pa.large_binary())
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                ids = codec.encode_all([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)]) // 4
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), listed, decoded(codec, labels, listed).cast(pa.string())], names=["doc_id", "ids", "decoded"])
        release()

    rows = texts_of(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests() -> dict[str, Column]:
    """n_tokens, ids_sha256 and decoded_sha256 over encode_decode's columns."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return {"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(listed.cast("binary"), 256), "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256)}


def op6_bpe_codec(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document; a null text is the empty one, with no ids."""
    return encode_decode(table(spark, sf_dir, "documents")).withColumns(digests()).drop("ids", "decoded")
