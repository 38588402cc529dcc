"""Files that are made once, whoever comes first.

Several jobs may want to make the same file.  It is written under a name of its own and
then given its final name in one step that fails if the name is taken: a hard link on a
mounted file system, a rename without overwriting elsewhere.  So a file is never seen half
written, and the loser finds the winner's.  The rename is atomic on file systems such as
HDFS; an object store whose rename copies is no place for these files.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The path as Hadoop's, and the file system that it is on."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(found), fs


def _link(spark: SparkSession, draft, target) -> None:
    nio = spark._jvm.java.nio.file
    at = [nio.Paths.get(p.toUri()) for p in (target, draft)]
    nio.Files.createLink(*at)


def _rename(spark: SparkSession, draft, target) -> None:
    jvm = spark._jvm
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    never = spark.sparkContext._gateway.new_array(rename, 1)
    never[0] = rename.NONE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        target.toUri(), spark._jsc.hadoopConfiguration()
    )
    files.rename(draft, target, never)


def put_once(spark: SparkSession, path: str, content: bytes) -> bool:
    """Make the file ``path``; False, and nothing changed, if it is there already."""
    target, fs = file_system(spark, path)
    if fs.exists(target):
        return False
    draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(content))
        out.close()
        (_link if target.toUri().getScheme() == "file" else _rename)(spark, draft, target)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(draft, False)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder that are not hidden; none if it is not there."""
    path, fs = file_system(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n for n in found if n[0] not in "._")
