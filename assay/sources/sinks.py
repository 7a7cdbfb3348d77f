"""Single text files in a given order: tasks write the pieces, the commit joins them as streams of bytes.

No row passes the driver's Python: parts are sorted files in the same store, and joining them copies bytes from file to file
in the driver's JVM with a small buffer. A file takes its place only when it is whole."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_pieces(rows: DataFrame, path: str, order: list[str], piece: Column, head: str = "", between: str = "\n", tail: str = "") -> None:
    """The pieces (text, no nulls) in the given order, with `between` between them, `head` before and `tail` after them, as one UTF-8 file.

    An existing file is replaced. No rows give head and tail alone."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    parts, whole = (jvm.org.apache.hadoop.fs.Path(f"{path}.{kind}-{uuid.uuid4().hex}") for kind in ("parts", "new"))
    rows.orderBy(*order).select(piece.alias("value")).write.option("lineSep", between).text(parts.toString())
    # Part files are named by partition, and partitions are ranges in order.
    number = re.compile(r"^part-(\d+)")
    found = sorted((int(m[1]), s.getLen(), s.getPath()) for s in fs.listStatus(parts) if (m := number.match(s.getPath().getName())) and s.getLen()) if fs.exists(parts) else []
    fs.setWriteChecksum(False)
    try:
        out = fs.create(whole, True)
        try:
            out.write(bytearray(head.encode()))
            for k, (_, size, part) in enumerate(found):
                # The last piece's separator isn't copied.
                left, source = size - (len(between.encode()) if k == len(found) - 1 else 0), fs.open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.org.apache.commons.io.input.BoundedInputStream(source, left), out, 1 << 16, False)
                finally:
                    source.close()
            out.write(bytearray(tail.encode()))
        finally:
            out.close()
        fs.delete(target, False)
        fs.rename(whole, target)
    finally:
        fs.setWriteChecksum(True)
        fs.delete(whole, False)
        fs.delete(parts, True)


def write_array(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON array, an indented element a row, in the given order; columns of the order that end in _ord aren't written."""
    kept = [c for c in df.columns if c not in order or not c.endswith("_ord")]
    write_pieces(df, path, order, F.to_json(F.struct(*kept), {"pretty": "true"}), "[\n", ",\n", "\n]\n")
