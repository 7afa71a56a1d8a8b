"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from ..sources.store import discard, written  # noqa: F401

#: Code points handled at a time inside one Python task; bounds its memory.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that the cluster names in spark.checkpoint.dir."""
    return f"{store.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """Left join with ``right``, of which ``key`` is unique.  Keys that hold more than a thousandth of the
    ``rows`` of ``left`` (and 1,000 of them) are fewer than 1,000, hence joined by broadcast; the others meet
    by a shuffle."""
    keys = [r[0] for r in left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max(1000, rows // 1000)).select(key).collect()]
    if not keys:
        return left.join(right, key, "left")
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    hot = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, "left")
    return left.where(~is_hot).join(right, key, "left").unionByName(hot)


def fold(key: str, buckets: int):
    """crc32 of the key as text, modulo ``buckets`` (a null key counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % F.lit(buckets)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, limit: int) -> DataFrame:
    """About ``limit`` rows (doc_id, text, label) at most, picked by a hash of doc_id among the labelled
    rows with ``train`` true.  The picked ids are bounded by ``limit``, hence broadcast."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train).select("doc_id", F.col(label).cast("int").alias("label")).dropDuplicates(["doc_id"])
    total = rows.count()
    if total > limit:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * limit / total))
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_CHARS, column: str = "text", rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one slice holds about ``size`` bytes of ``column`` or a single row, and
    ``rows`` rows at most."""
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(lengths):
            if (held and held + n > size) or i - start >= rows:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with more underscores where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def chunked(it, n: int):
    it = iter(it)
    while part := list(islice(it, n)):
        yield part
