"""Streams: reading positions with optimistic versions, login throttling, folders that grow."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codexmill.operators.catalog import attempt
from codexmill.session import shared_dir


def merge_progress(stream: DataFrame) -> DataFrame:
    """Accepted writes of (user_id, book_id, seq, base, updated_at, char_offset), state kept by key: the version and the refused count.

    A write whose base is older than the stored version is refused; a base of 0 or null always wins. The batch
    twin is operators.catalog.merge_progress."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, offset, refused = state.get if state.exists else (0, 0, 0)
        for b in batches:
            for r in b.sort_values("seq").itertuples():
                base = 0 if pd.isna(r.base) else int(r.base)
                if base == 0 or version <= base:
                    version, offset = int(r.updated_at), int(r.char_offset)
                else:
                    refused += 1
        state.update((version, offset, refused))
        yield pd.DataFrame({"user_id": [key[0]], "book_id": [key[1]], "version": [version], "char_offset": [offset], "refused": [refused]})

    return stream.groupBy("user_id", "book_id").applyInPandasWithState(fold, "user_id string, book_id long, version long, char_offset long, refused long", "version long, char_offset long, refused long", "update", GroupStateTimeout.NoTimeout)


def latest_positions(stream: DataFrame) -> DataFrame:
    """The newest position of each (user, book) so far; late writes with older versions do not win."""
    best = F.max_by(F.struct("char_offset", "updated_at"), F.struct("updated_at", "char_offset"))
    return stream.groupBy("user_id", "book_id").agg(best.alias("p")).select("user_id", "book_id", "p.*")


def throttle(stream: DataFrame, gap: int = 60, limit: int = 5) -> DataFrame:
    """(key, failures, blocked_until) after each attempt (key, t, ok): attempts while blocked do not count, a success clears, and so does a gap."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = tuple(state.get) if state.exists else (0, 0, 0, False)
        for b in batches:
            for r in b.sort_values("t").itertuples():
                own, _ = attempt(own, int(r.t), bool(r.ok), gap, limit)
        state.update(own)
        n, _, last, _ = own
        yield pd.DataFrame({"key": [key[0]], "failures": [n], "blocked_until": [last + gap if n >= limit else 0]})

    return stream.groupBy("key").applyInPandasWithState(fold, "key long, failures long, blocked_until long", "n long, first long, last long, open boolean", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, keys: list[str], values: list[str], name: str) -> DataFrame:
    """Runs an aggregating stream over all that is there and gives each key's last values.

    Updates go to files in the shared folder, batch by batch; nothing is held on the driver."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode("update").foreachBatch(lambda b, i: b.withColumn("_batch", F.lit(i)).write.mode("append").parquet(f"{path}/rows"))
    run.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'{c} {t}' for c, t in stream.dtypes)}, _batch long").parquet(f"{path}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v")).select(*keys, "v.*")


def windowed_activity(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by hour and type, with a watermark for late ones."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def folder_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as they come, as operators of sources.folder take them."""
    from codexmill.sources.folder import EXTENSIONS, HEAD, extension

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return files.where(extension(F.col("path")).isin(*EXTENSIONS)).select("path", F.regexp_extract("path", r"([^/]+)\z", 1).alias("file"), extension(F.col("path")).alias("format"), F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("file_mtime"), F.sha2(F.substring("content", 1, HEAD), 256).alias("file_hash"), "content")
