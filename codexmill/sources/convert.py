"""External converters as functions of bytes, for ingest: bounded in time, results kept by the input's hash; and files published whole."""

from __future__ import annotations

import hashlib
import os
import subprocess
import tempfile
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Seconds that a converter may take.
TIMEOUT = 1800


def command(args: list[str], suffix_in: str, suffix_out: str, cache: str | None = None, timeout: int = TIMEOUT) -> Callable[[bytes], bytes]:
    """A converter that runs a command; '{in}' and '{out}' in its arguments stand for the files. A failure or a timeout is an error of the file.

    Work files lie in the task's own temporary folder and go with it; `cache` is a folder that all executors share."""

    def convert(data: bytes) -> bytes:
        kept = os.path.join(cache, hashlib.sha256(data).hexdigest() + suffix_out) if cache else None
        if kept and os.path.exists(kept):
            with open(kept, "rb") as f:
                return f.read()
        with tempfile.TemporaryDirectory() as d:
            src, dst = os.path.join(d, "in" + suffix_in), os.path.join(d, "out" + suffix_out)
            with open(src, "wb") as f:
                f.write(data)
            subprocess.run([a.replace("{in}", src).replace("{out}", dst) for a in args], check=True, timeout=timeout, capture_output=True)
            with open(dst, "rb") as f:
                got = f.read()
        if kept:
            publish(kept, got)
        return got

    return convert


def publish(path: str, data: bytes) -> None:
    """Writes a file that is seen whole or not at all: to a name of its own first, then renamed."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path))
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        os.unlink(tmp)
        raise


def publish_table(spark: SparkSession, written: str, path: str) -> None:
    """Puts a written folder in the place of another by renaming, through the file system that holds them; the old one goes last."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(written).getFileSystem(spark._jsc.hadoopConfiguration())
    old = p(path + ".old")
    fs.delete(old, True)
    if fs.exists(p(path)):
        fs.rename(p(path), old)
    if not fs.rename(p(written), p(path)):
        fs.rename(old, p(path))
        raise OSError(f"cannot publish {path}")
    fs.delete(old, True)
