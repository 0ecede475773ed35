"""Far too many small files: indexed archive containers.

Original bytes are packed, with path, sequence number, offset, length and
checksum of each entry, into large blocks.  A container is one row: its
payload and its index.  Entries are read back by slice, losslessly and in
parallel; a container needs no other one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.paths import same_path

#: Size of a container, before its last entry is added.
BLOCK_BYTES = 1 << 20

CONTAINER = (
    "container_id string, n_entries int, n_payload bigint, payload binary, "
    "entries array<struct<path:string,seq_no:int,position:bigint,size:bigint,crc:bigint>>"
)
_ENTRY = pa.struct([("path", pa.string()), ("seq_no", pa.int32()), ("position", pa.int64()), ("size", pa.int64()), ("crc", pa.int64())])
_SCHEMA = pa.schema([("container_id", pa.string()), ("n_entries", pa.int32()), ("n_payload", pa.int64()), ("payload", pa.binary()), ("entries", pa.list_(_ENTRY))])


def best_deliveries(fragments: DataFrame) -> DataFrame:
    """One body per (path, seq_no): the longest delivery, of equals the earliest, then the smallest id.

    Copies meet in a partial aggregation first, so many deliveries of one
    piece cost no more than their reading.  A null body counts as empty; rows
    without path or seq_no hold nothing that could be placed and are left out.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    return (
        fragments.where("source_path is not null and seq_no is not null")
        .select(same_path(F.col("source_path")).alias("path"), "seq_no", body.alias("body"), F.octet_length(body).alias("size"), F.col("arrived_at"), "fragment_id")
        .groupBy("path", "seq_no")
        .agg(F.max_by("body", F.struct("size", -F.coalesce(F.unix_micros("arrived_at"), F.lit(0)), -F.col("fragment_id"))).alias("body"))
    )


def pack(pieces: DataFrame, block_bytes: int = BLOCK_BYTES, partitions: int | None = None) -> DataFrame:
    """Pieces (path, seq_no, body) as containers, in the order of path and seq_no.

    The range partitioning splits a source of any size between its pieces; a
    task holds one container at a time.  Only the last container of a
    partition may stay small.  A piece larger than a block gets a container
    for itself.  No pieces give no containers.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payload, index = bytearray(), []

        def flush() -> pa.RecordBatch:
            data = bytes(payload)
            first = index[0]
            name = f"{zlib.crc32(first['path'].encode()):08x}-{first['seq_no']}-{zlib.crc32(data):08x}"
            columns = ([name], [len(index)], [len(data)], [data], [list(index)])
            payload.clear()
            index.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in batches:
            for path, seq_no, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = body.as_py().encode() if isinstance(body, pa.StringScalar) else (body.as_py() or b"")
                if index and len(payload) + len(data) > block_bytes:
                    yield flush()
                index.append({"path": path, "seq_no": seq_no, "position": len(payload), "size": len(data), "crc": zlib.crc32(data)})
                payload += data
        if index:
            yield flush()

    slim = pieces.select("path", "seq_no", "body")
    spread = slim.repartitionByRange(partitions, "path", "seq_no") if partitions else slim.repartitionByRange("path", "seq_no")
    return spread.sortWithinPartitions("path", "seq_no").mapInArrow(build, CONTAINER)


def unpack(containers: DataFrame) -> DataFrame:
    """The pieces of containers again: (path, seq_no, body); a wrong checksum is an error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, payload, entries in zip(batch["container_id"], batch["payload"], batch["entries"], strict=True):
                rows = []
                for e in entries:
                    data = payload[e["position"] : e["position"] + e["size"]]
                    if len(data) != e["size"] or zlib.crc32(data) != e["crc"]:
                        raise ValueError(f"container {name}: damaged entry {e['path']} {e['seq_no']}")
                    rows.append((e["path"], e["seq_no"], data.decode()))
                yield pd.DataFrame(rows, columns=["path", "seq_no", "body"])

    return containers.select("container_id", "payload", "entries").mapInPandas(read, "path string, seq_no int, body string")


def lookup(containers: DataFrame, path: str, seq_no: int | None = None) -> DataFrame:
    """Pieces of one path, or one piece, read from the containers whose index names it."""
    named = F.exists("entries", lambda e: (e["path"] == path) & (F.lit(True) if seq_no is None else e["seq_no"] == seq_no))
    pieces = unpack(containers.where(named)).where(F.col("path") == path)
    return pieces if seq_no is None else pieces.where(F.col("seq_no") == seq_no)


_LINE_END = re.compile(r"\r\n|\r|\n")


def records(pieces: DataFrame) -> DataFrame:
    """Records of each piece: (path, seq_no, n_records, n_bytes); a record is a line that isn't blank."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [[x for x in _LINE_END.split(body) if x.strip()] for body in batch["body"]]
            yield pd.DataFrame(
                {"path": batch["path"], "seq_no": batch["seq_no"], "n_records": [len(x) for x in lines], "n_bytes": [sum(len(line.encode()) for line in x) for x in lines]}
            )

    return pieces.mapInPandas(count, "path string, seq_no int, n_records bigint, n_bytes bigint")


def write_archive(fragments: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> None:
    """Containers of all fragments as files of about one block each."""
    pack(best_deliveries(fragments), block_bytes).write.mode("overwrite").option("maxRecordsPerFile", 1).parquet(folder)


def found_sources(fragments: DataFrame) -> DataFrame:
    """What the archive holds of every source with two or more pieces, counted after unpacking."""
    held = records(unpack(pack(best_deliveries(fragments))))
    return (
        held.groupBy(F.col("path").alias("source_path"))
        .agg(F.count("*").alias("n_fragments"), F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"))
        .where("n_fragments >= 2")
    )
