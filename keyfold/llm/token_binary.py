"""Token ids as Arrow IPC files of fixed-size lists.

Each file is a shard of consecutive documents: record batches of equal-length
sequences ``ids`` (the narrowest unsigned type that holds the vocabulary) and
bit-packed ``mask`` (false only in the padding of a shard's last sequence). All
batches but the last have the same number of rows, so sequence s of a mapped
file is row s % rows of batch s // rows, without copying. The schema's metadata
holds the shard's place and a table of its documents (id, n_tokens).

Documents are dealt by ranges of their id and sorted, so shards follow in id
order. Files are written by Spark's committing text writer, one value a file:
the format's closing magic is the line separator, so any file system that Spark
reaches will do, and a task that is lost leaves nothing behind.

Defined results: a null text is empty and still gets its end id; a text of any length
is one document of one shard, which may be longer for it; null ids come first; rows
that repeat an id stay next to each other, ordered by a hash of their text; an empty
table writes no shard and reads back empty; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.llm.tokenization import encoder

MAGIC = "ARROW1"


def _shard(ids: np.ndarray, docs: pa.Table, place: dict, length: int, rows: int) -> bytes:
    n = max(1, -(-len(ids) // length))
    padded = np.zeros(n * length, ids.dtype)
    padded[: len(ids)] = ids
    mask = np.arange(n * length) < len(ids)
    index = pa.BufferOutputStream()
    with pa.ipc.new_stream(index, docs.schema) as w:
        w.write_table(docs)
    schema = pa.schema(
        [("ids", pa.list_(pa.from_numpy_dtype(ids.dtype), length)), ("mask", pa.list_(pa.bool_(), length))],
        metadata={b"place": json.dumps(place).encode(), b"documents": index.getvalue().to_pybytes()},
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, schema) as w:
        for i in range(0, n, rows):
            cut = slice(i * length, min(n, i + rows) * length)
            w.write_batch(
                pa.record_batch(
                    [pa.FixedSizeListArray.from_arrays(pa.array(x[cut]), length) for x in (padded, mask)], schema=schema
                )
            )
    return sink.getvalue().to_pybytes()


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 0,
    sequence_length: int = 1024,
    batch_rows: int = 256,
    shard_tokens: int = 4_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    special_as_text: bool = False,
) -> None:
    """Encode every whole text and write the shards below ``path``.

    A shard closes after the document that brings it to ``shard_tokens``.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, special_as_text)
        dtype = np.dtype("<u2" if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        end = np.array([end_id], dtype)
        part, no = TaskContext.get().partitionId(), 0
        ids, doc_ids, counts, total, kind = [], [], [], 0, None

        def flush() -> pa.RecordBatch:
            table = pa.table({"doc_id": pa.array(doc_ids, kind), "n_tokens": pa.array(counts, pa.int64())})
            place = {"part": part, "no": no, "n_tokens": total}
            return pa.record_batch([pa.array([_shard(np.concatenate(ids), table, place, sequence_length, batch_rows)], pa.binary())], ["content"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, own in zip(batch.column(0).to_pylist(), enc.encode_batch(batch.column(1))):
                ids += (own.astype(dtype), end)
                doc_ids.append(doc_id)
                counts.append(len(own) + 1)
                total += len(own) + 1
                if total >= shard_tokens:
                    yield flush()
                    ids, doc_ids, counts, total, no = [], [], [], 0, no + 1
        if doc_ids:
            yield flush()

    d = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__hash"), F.spark_partition_id().alias("__from"))
    # rows of one id, and equal rows, can go to several shards
    order = [F.col("__id").asc_nulls_first(), F.col("__hash"), F.col("__from")]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order, "__text")
    d = d.select("__id", "__text").mapInArrow(encode, "content binary")
    # the writer puts the closing magic back
    body = F.expr(f"substring(content, 1, octet_length(content) - {len(MAGIC)})").cast("string")
    d.select(body.alias("value")).write.option("lineSep", MAGIC).option("maxRecordsPerFile", 1).text(path)


def read_tokens(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(part, no, doc_id, shard_start, n_tokens, ids_crc32) per document, from the files.

    ``id_type`` is the type of the ids that were written.
    ``ids_crc32`` is over the document's ids as little-endian unsigned 32-bit integers.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                reader = pa.ipc.open_file(content.as_buffer())
                place = json.loads(reader.schema.metadata[b"place"])
                docs = pa.ipc.open_stream(reader.schema.metadata[b"documents"]).read_all()
                parts = []
                for i in range(reader.num_record_batches):
                    b = reader.get_batch(i)
                    ids = b.column(0).flatten().to_numpy(zero_copy_only=True)
                    parts.append(ids[b.column(1).flatten().to_numpy(zero_copy_only=False)])
                ids = np.concatenate(parts).astype("<u4")
                counts = docs["n_tokens"].to_numpy()
                ends = np.cumsum(counts)
                if len(ids) != place["n_tokens"] or (len(ends) and ends[-1] != len(ids)):
                    raise ValueError(f"shard {place} holds {len(ids)} ids")
                crcs = [zlib.crc32(ids[e - n : e].data) for n, e in zip(counts, ends)]
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(counts), place["part"], np.int64)),
                        pa.array(np.full(len(counts), place["no"], np.int64)),
                        docs["doc_id"].combine_chunks(),
                        pa.array(ends - counts),
                        pa.array(counts),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["part", "no", "doc_id", "shard_start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(decode, f"part long, no long, doc_id {id_type}, shard_start long, n_tokens long, ids_crc32 long")


def with_starts(read: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before. The running sum has one row a shard."""
    sums = read.groupBy("part", "no").agg(F.sum("n_tokens").alias("__n"))
    order = W.orderBy("part", "no").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("part", "no", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__before"))
    d = read.join(sums, ["part", "no"])
    return d.withColumn("start", F.col("__before") + F.col("shard_start")).drop("__before")
