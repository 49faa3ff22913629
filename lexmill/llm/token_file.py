"""Token ids in binary files of patched frame-of-reference blocks.

The ids of all documents, in ascending order of id, form one stream over the parts of a dataset. A part is a file:

    magic, then segments of about SEGMENT ids, then the document table, then the footer with their places.

A segment is cut into blocks of BLOCK ids. Of each block the minimum is subtracted; the rest is packed at the width
that a percentile of its values needs; values that need more bits are patched from an exception list. The start of
every block in the packed words is stored, so a reader may decode any block alone.

Defined results: a null text counts as empty (its document holds the end id only); a null document id sorts first and
is read back as null; rows that repeat an id stand next to each other, ordered by text; an empty table gives a dataset
without parts, which reads as no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import session
from lexmill.llm.tokens import encode_column, grouped

BLOCK = 128
SEGMENT = 1 << 20
#: Share of a block's values that the packed width must hold.
PERCENTILE = 0.9
MAGIC = b"LXPF0001"
_FOOTER = struct.Struct("<QQQ8s")  # place of the segment list, its length, ids in the part, magic
_SEGMENT = struct.Struct("<QQQQ")  # ids, blocks, packed 64-bit words, exceptions


def pack_segment(ids: np.ndarray) -> bytes:
    """One segment: header, block minima, widths, exception counts, block starts, packed words, exceptions."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    values = np.empty(blocks * BLOCK, np.uint32)
    values[:n], values[n:] = ids, ids[-1] if n else 0
    values = values.reshape(blocks, BLOCK)
    least = values.min(axis=1) if blocks else np.empty(0, np.uint32)
    rest = values - least[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    rank = int(PERCENTILE * (BLOCK - 1))
    width = np.partition(bits, rank, axis=1)[:, rank] if blocks else np.empty(0, np.uint8)
    row, col = np.nonzero(bits > width[:, None])
    counts = np.bincount(row, minlength=blocks).astype(np.uint8)
    start = np.zeros(blocks + 1, np.uint64)
    np.cumsum(width.astype(np.uint64) * (BLOCK // 64), out=start[1:])
    words = np.zeros(int(start[-1]), np.uint64)
    for w in np.unique(width):
        if not (w := int(w)):
            continue
        rows = np.flatnonzero(width == w)
        low = np.ascontiguousarray((rest[rows] & np.uint32((1 << w) - 1)).T).astype(np.uint64)
        packed = np.zeros((w * BLOCK // 64 + 1, len(rows)), np.uint64)
        for j in range(BLOCK):
            k, shift = divmod(j * w, 64)
            packed[k] |= low[j] << np.uint64(shift)
            if shift + w > 64:
                packed[k + 1] |= low[j] >> np.uint64(64 - shift)
        places = start[rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // 64)
        words[places] = packed[:-1].T
    head = _SEGMENT.pack(n, blocks, len(words), len(row))
    return b"".join((head, least.astype("<u4").tobytes(), width.tobytes(), counts.tobytes(), start.astype("<u8").tobytes(), words.astype("<u8").tobytes(), col.astype(np.uint8).tobytes(), rest[row, col].astype("<u4").tobytes()))


def unpack_segment(data: bytes) -> np.ndarray:
    n, blocks, n_words, n_exceptions = _SEGMENT.unpack_from(data)
    at = _SEGMENT.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, count, at)
        at += found.nbytes
        return found

    least, width, counts = take("<u4", blocks), take("u1", blocks), take("u1", blocks)
    start, words = take("<u8", blocks + 1), take("<u8", n_words)
    col, over = take("u1", n_exceptions), take("<u4", n_exceptions)
    rest = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if not (w := int(w)):
            continue
        rows = np.flatnonzero(width == w)
        places = start[rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // 64)
        packed = np.ascontiguousarray(words[places].T)
        low = np.empty((BLOCK, len(rows)), np.uint32)
        mask = np.uint64((1 << w) - 1)
        for j in range(BLOCK):
            k, shift = divmod(j * w, 64)
            value = packed[k] >> np.uint64(shift)
            if shift + w > 64:
                value = value | packed[k + 1] << np.uint64(64 - shift)
            low[j] = value & mask
        rest[rows] = low.T
    rest[np.repeat(np.arange(blocks), counts), col] = over
    return (rest + least[:, None]).reshape(-1)[:n]


def _store(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def _write_part(place: str, part: int, attempt: int, batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> tuple | None:
    store, root = _store(place)
    end = np.array([end_id], "<u4").tobytes()
    name = f"part-{part:06d}-{attempt}.pfor"  # what a failed attempt leaves is in no manifest
    segments, doc_ids, nulls, sizes, held, n_held, total, out = [], [], [], [], [], 0, 0, None

    def flush() -> None:
        nonlocal held, n_held
        if n_held:
            segments.append(out.tell())
            out.write(pack_segment(np.frombuffer(b"".join(held), "<u4")))
            held, n_held = [], 0

    for batch in grouped(batches):
        if not batch.num_rows:
            continue
        if out is None:
            out = store.open_output_stream(f"{root}/{name}")
            out.write(MAGIC)
        ids = batch.column(0)
        doc_ids.append(ids.fill_null(0).to_numpy())
        nulls.append(ids.is_null().to_numpy(zero_copy_only=False))
        for found in encode_column(batch.column(1), tokenizer):
            held += (found, end)
            sizes.append(len(found) // 4 + 1)
            n_held += sizes[-1]
            total += sizes[-1]
            if n_held >= SEGMENT:
                flush()
    if out is None:
        return None
    flush()
    segments.append(out.tell())
    out.write(np.concatenate(doc_ids).astype("<i8").tobytes() + np.concatenate(nulls).astype("u1").tobytes() + np.array(sizes, "<u8").tobytes())
    at = out.tell()
    out.write(np.array(segments, "<u8").tobytes())
    out.write(_FOOTER.pack(at, len(segments), total, MAGIC))
    size = out.tell()
    out.close()
    return name, len(sizes), total, size


def read_part(data: pa.NativeFile) -> Iterator[tuple[list, np.ndarray, list[bytes]]]:
    """The documents of a part, segment by segment: ids, starts within the part, and token ids as bytes."""
    data.seek(data.size() - _FOOTER.size)
    at, n_places, _, magic = _FOOTER.unpack(data.read(_FOOTER.size))
    if magic != MAGIC:
        raise ValueError("not a token file")
    data.seek(at)
    places = np.frombuffer(data.read(8 * n_places), "<u8").tolist()
    data.seek(places[-1])
    table = data.read(at - places[-1])
    n = len(table) // 17
    ids, nulls, sizes = np.frombuffer(table, "<i8", n), np.frombuffer(table, "u1", n, 8 * n), np.frombuffer(table, "<u8", n, 9 * n).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    have, base, done = b"", 0, 0
    for here, there in zip(places, places[1:], strict=False):
        data.seek(here)
        have += unpack_segment(data.read(there - here)).astype("<u4").tobytes()
        last = int(np.searchsorted(starts, base + len(have) // 4, side="right")) - 1
        cut = [have[4 * (int(starts[i]) - base) : 4 * (int(starts[i + 1]) - base)] for i in range(done, last)]
        yield [None if nulls[i] else int(ids[i]) for i in range(done, last)], starts[done:last], cut
        have, base, done = have[4 * (int(starts[last]) - base) :], int(starts[last]), last


def write(docs: DataFrame, place: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append end_id to each, and write the parts and a manifest (one line per part) to `place`.

    Only the manifest, a row per part, passes through the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spread = F.xxhash64("text")  # rows that repeat an id need not share a part
    rows = rows.repartitionByRange(session.n_partitions(spark), "id", spread).sortWithinPartitions("id", spread, "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        made = _write_part(place, context.partitionId(), context.taskAttemptId(), batches, tokenizer, end_id)
        if made:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "docs", "ids", "bytes"), made, strict=True))], schema=pa.schema([("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    store, root = _store(place)
    store.create_dir(root, recursive=True)
    parts = sorted(tuple(r) for r in rows.mapInArrow(task, "file string, docs long, ids long, bytes long").collect())
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps([dict(zip(("file", "docs", "ids", "bytes"), p, strict=True)) for p in parts]).encode())


def read(spark: SparkSession, place: str) -> DataFrame:
    """The documents of a dataset: doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit)."""
    store, root = _store(place)
    with store.open_input_stream(f"{root}/manifest.json") as found:
        parts = json.loads(found.read())
    bases = np.cumsum([0] + [p["ids"] for p in parts]).tolist()
    rows = [(p["file"], base) for p, base in zip(parts, bases, strict=False)]
    files = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, root = _store(place)
                with store.open_input_file(f"{root}/{row['file']}") as data:
                    for ids, starts, found in read_part(data):
                        for i in range(0, len(ids), session.ARROW_ROWS):
                            cut = slice(i, i + session.ARROW_ROWS)
                            sizes = [len(x) // 4 for x in found[cut]]
                            yield pa.RecordBatch.from_arrays([pa.array(ids[cut], pa.int64()), pa.array(starts[cut] + row["base"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(found[cut], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(task, "doc_id long, start long, n_tokens long, ids binary")
