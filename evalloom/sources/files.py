"""Small files beside the tables that Spark writes: manifests, events, reports, annotation tasks.

A path belongs to the file system that Spark would use for it. Local ones are read and written by Python; all others
(hdfs, s3a, abfs, a default file system that is no local one) through Hadoop's file system in the driver's JVM.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession


def _hadoop(path: str):
    """(file system, path) in the JVM, or None for a local path."""
    scheme = re.match(r"([a-zA-Z][\w+.-]*):/", path)
    if scheme and scheme[1] == "file":
        return None
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    conf = spark._jsc.hadoopConfiguration()
    if not scheme and str(conf.get("fs.defaultFS") or "file:///").startswith("file:"):
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf), place


def local(path: str) -> str:
    """A local path without its scheme."""
    return re.sub(r"^file:/+", "/", path)


def exists(path: str) -> bool:
    found = _hadoop(path)
    return os.path.exists(local(path)) if found is None else found[0].exists(found[1])


def names(path: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    if not exists(path):
        return []
    found = _hadoop(path)
    return sorted(os.listdir(local(path)) if found is None else [s.getPath().getName() for s in found[0].listStatus(found[1])])


def read_text(path: str) -> str:
    found = _hadoop(path)
    if found is None:
        with open(local(path), encoding="utf-8") as f:
            return f.read()
    stream = found[0].open(found[1])
    try:
        return SparkSession.getActiveSession()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """The file appears whole or not at all."""
    found = _hadoop(path)
    if found is None:
        path = local(path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + ".new", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(path + ".new", path)
        return
    fs, place = found
    new = place.suffix(".new")
    out = fs.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(place, False)
    fs.rename(new, place)


def copy_from(stream, path: str) -> None:
    """A stream's bytes as a file, a block at a time; the file appears whole or not at all."""
    found = _hadoop(path)
    if found is None:
        import shutil

        path = local(path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + ".new", "wb") as f:
            shutil.copyfileobj(stream, f)
        os.replace(path + ".new", path)
        return
    fs, place = found
    new = place.suffix(".new")
    out = fs.create(new, True)
    try:
        while block := stream.read(1 << 20):
            out.write(bytearray(block))
    finally:
        out.close()
    fs.rename(new, place)


def join_parts(folder: str, path: str) -> None:
    """The part files that executors wrote, one after another as one file; bytes only, no row passes Python."""
    found = _hadoop(path)
    parts = [n for n in names(folder) if n.startswith("part-")]
    if found is None:
        import shutil

        with open(local(path), "wb") as out:
            for n in parts:
                with open(f"{local(folder)}/{n}", "rb") as f:
                    shutil.copyfileobj(f, out)
        shutil.rmtree(local(folder))
        return
    fs, place = found
    jvm = SparkSession.getActiveSession()._jvm
    out = fs.create(place, True)
    try:
        for n in parts:
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}"))
            try:
                jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out)
            finally:
                stream.close()
    finally:
        out.close()
    fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)
