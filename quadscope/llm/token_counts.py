"""Token counts by a separator scan of flat token files.

A flat file is nothing but little-endian unsigned 16- or 32-bit token ids, an end-of-document id after
every document, no index.  Files are read as a stream in path order; large ones are cut into ranges that
tasks read one by one.  A range is searched block by block (vectorised comparison with the separator);
documents that cross blocks are stitched by a prefix scan over the blocks' open ends, and those that cross
ranges or files by a prefix scan over one summary row a range.

``write_flat`` makes such files with Spark's own text writer (the row separator is the separator id's
bytes), so they may lie in any store that Spark reaches.  The rows' ids are written by the same job, so that
no second scan of the table has to meet the rows in the same split and order.

Edge cases: an empty file adds nothing; neighbouring separators are documents of 0 tokens; tokens after
the last separator of the stream are a document that is marked as not closed; a file whose size is no
multiple of the id's width is an error; null and empty texts are documents of 0 tokens; repeated rows are
documents of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common, sentencepiece_bpe

#: Token ids searched at a time; slices (of about 1,000,000 bytes of text at most) of a flat file.
BLOCK, FILE_SLICES = 1 << 20, 32
#: Bytes of a file that a task holds at most.
WHOLE = 1 << 26
SEPARATOR = 2  # </s>, which no text is encoded to


def write_flat(docs: DataFrame, model_path: str, path: str, separator: int = SEPARATOR) -> None:
    """Encode ``text`` and write flat 16-bit files below ``path``/kind=0, in the order of the rows.  The same
    task attempt writes its rows' ``doc_id`` below ``path``/kind=1, a line for each slice: the place of its
    first row in the task and the ids as an Arrow stream."""
    with open(model_path, "rb") as f:  # a vocabulary file of the driver; its size bounds the broadcast
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece_bpe.load(data.value)
        if model.size > 1 << 16 or separator in model.ids.values():
            raise ValueError("the vocabulary does not fit")
        ending, nth = np.array([separator], "<u2").tobytes(), 0
        gc.disable()  # millions of small strings and tuples without cycles
        try:
            for batch in _common.slices(batches, 1_000_000):
                found = [np.fromstring(ids, np.uint16, sep=",").tobytes() if ids else b"" for _, ids, _ in model.round_trip([t or "" for t in batch.column(1).to_pylist()])]
                values = [ending.join(found), b"%d %s" % (nth, _packed(batch.column(0)))]
                yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([nth, nth], pa.int64()), pa.array(values, pa.binary())], ["kind", "nth", "value"])
                nth += batch.num_rows
        finally:  # the worker goes on to other tasks
            gc.enable()

    rows = docs.select("doc_id", "text").mapInArrow(run, "kind int, nth long, value binary")
    rows = rows.sortWithinPartitions("kind", "nth").select("kind", F.col("value").cast("string").alias("value"))
    rows.write.partitionBy("kind").options(**_ends(separator)).option("maxRecordsPerFile", FILE_SLICES).text(path)


def _ends(separator: int) -> dict[str, str]:
    return {"lineSep": np.array([separator], "<u2").tobytes().decode("latin-1"), "encoding": "ISO-8859-1"}


def _packed(ids: pa.Array) -> bytes:
    """A line without separators: base64 of the ids as an Arrow stream."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids], ["doc_id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return base64.b64encode(sink.getvalue())


def _ids(docs: DataFrame, path: str, separator: int = SEPARATOR) -> DataFrame:
    """(task, nth, doc_id) as ``write_flat`` left them."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first, _, packed = line.partition(" ")
                for ids in pa.ipc.open_stream(base64.b64decode(packed)):
                    m = ids.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([task] * m, pa.int32()), pa.array(np.arange(m) + int(first), pa.int64()), ids.column(0)], ["task", "nth", "doc_id"])

    lines = docs.sparkSession.read.options(**_ends(separator)).text(f"{path}/kind=1")
    return lines.select(_task(F.input_file_name()), "value").mapInArrow(run, f"task int, nth long, doc_id {kind}")


def _task(file):
    return F.regexp_extract(file, r"part-(\d+)-[^/]*$", 1).cast("int").alias("task")


def block_scan(tokens: np.ndarray, separator: int, block: int = BLOCK) -> tuple[np.ndarray, int]:
    """(length up to each separator of a stream, length after the last), searched block by block."""
    starts = range(0, len(tokens), block)
    found = [np.flatnonzero(tokens[s : s + block] == separator) for s in starts]
    if not found:
        return np.zeros(0, np.int64), 0
    sizes = np.array([min(block, len(tokens) - s) for s in starts], np.int64)
    some = np.array([len(f) > 0 for f in found])
    tail = np.where(some, sizes - 1 - np.array([f[-1] if len(f) else 0 for f in found]), sizes)
    # open length before block b: the tails since the last block with a separator
    total = np.append(0, np.cumsum(tail))
    last = np.maximum.accumulate(np.where(some, np.arange(len(some)), -1))
    base = np.where(last >= 0, total[np.maximum(last, 0)], 0)
    after = total[1:] - base
    before = np.append(0, after[:-1])
    lengths = [np.diff(np.append(-1, f)) - 1 for f in found]
    for k in np.flatnonzero(some):
        lengths[k][0] += before[k]
    return np.concatenate(lengths), int(after[-1])


def read_range(path: str, start: int, size: int) -> bytes:
    """Bytes of a file in any store that pyarrow knows."""
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        store, name = fs.LocalFileSystem(), unquote(urlparse(path).path)
    else:
        store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        return f.read_at(size, start)


def scan(spark: SparkSession, path: str, separator: int = SEPARATOR, width: int = 2, whole: int = WHOLE, read=read_range) -> DataFrame:
    """(file, start, place, n_tokens, closed): every document by the file and the range, from byte ``start``,
    in which it ends, and its place there.  Files of up to ``whole`` bytes are one range, which Spark reads;
    larger ones are cut into ranges of that size, which tasks read by ``read(path, start, size)``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    whole -= whole % width

    def told(file: str, start: int, content) -> pa.RecordBatch:
        lengths, tail = block_scan(np.frombuffer(content, f"<u{width}"), separator)
        n = len(lengths)
        # place -1: the range's summary
        return pa.RecordBatch.from_arrays([pa.array([file] * (n + 1)), pa.array([start] * (n + 1), pa.int64()), pa.array(np.arange(-1, n)), pa.array(np.append(tail, lengths))], ["file", "start", "place", "n_tokens"])

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield told(batch.column(0)[i].as_py(), 0, batch.column(1)[i].as_buffer())

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                yield told(file, start, read(file, start, size))

    shape = "file string, start long, place long, n_tokens long"
    parts = files.where(F.col("length") <= whole).select("path", "content").mapInArrow(at_once, shape)
    large = files.where(F.col("length") > whole).select("path", "length")
    ranges = large.select("path", F.explode(F.expr(f"sequence(0L, length - 1, {whole}L)")).alias("start"), "length").select("path", "start", F.least(F.lit(whole), F.col("length") - F.col("start")).alias("size"))
    parts = parts.unionByName(ranges.repartition("path", "start").mapInArrow(by_range, shape))
    rows = _common.written(parts, "separators")
    ends = rows.groupBy("file", "start").agg(F.sum(F.when(F.col("place") < 0, F.col("n_tokens"))).alias("tail"), F.count(F.when(F.col("place") >= 0, 1)).alias("docs"))
    # a row for each file or ``whole`` bytes of one, so one task is enough for the scan over them
    w = Window.orderBy("file", "start")
    ends = ends.withColumn("run", F.coalesce(F.sum((F.col("docs") > 0).cast("int")).over(w), F.lit(0)))
    ends = ends.withColumn("after", F.sum("tail").over(Window.partitionBy("run").orderBy("file", "start")))
    ends = ends.withColumn("before", F.coalesce(F.lag("after").over(w), F.lit(0))).withColumn("last", F.lead("file").over(w).isNull())
    firsts = ends.select("file", "start", "before")
    closed = rows.where("place >= 0").join(F.broadcast(firsts) if _few(firsts) else firsts, ["file", "start"])
    closed = closed.select("file", "start", "place", F.when(F.col("place") == 0, F.col("n_tokens") + F.col("before")).otherwise(F.col("n_tokens")).alias("n_tokens"), F.lit(True).alias("closed"))
    return closed.unionByName(ends.where("last and after > 0").select("file", "start", F.col("docs").alias("place"), F.col("after").alias("n_tokens"), F.lit(False).alias("closed")))


def _few(files: DataFrame, limit: int = 10_000) -> bool:
    return files.limit(limit + 1).count() <= limit


def count(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens) of every row: flat files are written below the shared folder and scanned; the
    n-th document of a task's flat files is the n-th of the ids that this task wrote beside them."""
    spark = docs.sparkSession
    path = _common.scratch_dir(spark, "flat")
    write_flat(docs, model_path, path)
    if "kind" not in spark.read.format("binaryFile").load(path).columns:  # no row, hence no file
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens")).limit(0)
    found = scan(spark, f"{path}/kind=0").withColumn("task", _task(F.col("file")))
    ranges = found.groupBy("task", "file", "start").count()
    ranges = ranges.withColumn("skip", F.coalesce(F.sum("count").over(Window.partitionBy("task").orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = found.join(ranges.select("file", "start", "skip"), ["file", "start"]).select("task", (F.col("skip") + F.col("place")).alias("nth"), "n_tokens")
    rows = _ids(docs, path).withColumn("_id", F.lit(True)).join(numbered.withColumn("_count", F.lit(True)), ["task", "nth"], "full")
    torn = F.raise_error(F.concat(F.lit("ids and flat files of task "), F.col("task"), F.lit(" differ at row "), F.col("nth")))
    return rows.select("doc_id", F.when(F.col("_id").isNull() | F.col("_count").isNull(), torn.cast("long")).otherwise(F.col("n_tokens")).alias("n_tokens"))
