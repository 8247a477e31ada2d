"""Files that appear whole and once: the entries of commit logs."""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import SparkSession

#: Texts of entries that were read; an entry never changes once it is there.
_read: dict[str, str] = {}


def path_of(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _local(p, fs) -> str | None:
    return p.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its text, unless one of that name is there; of several writers one succeeds.

    The file is written under another name and then linked (local folders) or renamed to its own, which fails where that exists.
    """
    p, fs = path_of(spark, path)
    part = f".{uuid.uuid4().hex}.part"
    if local := _local(p, fs):
        folder = os.path.dirname(local)
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{part}", "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(f"{folder}/{part}", local)
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{folder}/{part}")
        _read[path] = text
        return True
    own = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), part)
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    done = False
    with contextlib.suppress(Exception):  # some stores return false where the name is taken, others raise
        done = not fs.exists(p) and fs.rename(own, p)
    if done:
        _read[path] = text
    else:
        fs.delete(own, False)
    return done


def text_of(spark: SparkSession, path: str) -> str:
    """The text of an entry."""
    if path not in _read:
        p, fs = path_of(spark, path)
        if local := _local(p, fs):
            with open(local, encoding="utf-8") as f:
                found = f.read()
        else:
            stream = fs.open(p)
            try:
                found = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        _read[path] = found
    return _read[path]


def names(spark: SparkSession, path: str) -> list[str]:
    p, fs = path_of(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    for key in [k for k in _read if k == path or k.startswith(f"{path}/")]:
        del _read[key]
    p, fs = path_of(spark, path)
    fs.delete(p, True)
