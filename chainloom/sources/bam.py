"""BAM files as SAM text lines.

A BAM file is a chain of gzip members, so it is decompressed as a stream and
its records are decoded one after another; a worker holds one record and one
output batch. A file is read by one task: there is no public index of record
starts to split it by, so very large files are best given as several.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .files import located

# Fixed values of the format.
_OPERATIONS, _FIXED = "MIDNSHP=X", struct.Struct("<iiBBHHHiiii")
BATCH = 5_000


def _lines(path: str, records: bool = True) -> Iterator[str]:
    with gzip.open(path, "rb") as f:
        if f.read(4) != b"BAM\1":
            raise ValueError(f"{path}: not a BAM file")
        text = f.read(struct.unpack("<i", f.read(4))[0]).rstrip(b"\0").decode("utf-8", "replace")
        yield from text.splitlines()
        if not records:
            return
        names = []
        for _ in range(struct.unpack("<i", f.read(4))[0]):
            names.append(f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode())
            f.read(4)
        while head := f.read(4):
            data = f.read(struct.unpack("<i", head)[0])
            ref, pos, n_name, mapq, _, n_ops, flag, n_seq, next_ref, next_pos, size = _FIXED.unpack_from(data)
            at = _FIXED.size + n_name
            name = data[_FIXED.size : at - 1].decode()
            ops = struct.unpack_from(f"<{n_ops}I", data, at)
            cigar = "".join(f"{x >> 4}{_OPERATIONS[x & 15]}" for x in ops) or "*"
            rname, rnext = (names[k] if k >= 0 else "*" for k in (ref, next_ref))
            yield "\t".join(map(str, (name, flag, rname, pos + 1, mapq, cigar, rnext, next_pos + 1, size, "*" if n_seq else "*", "*")))


def read_lines(spark: SparkSession, paths: list[str], records: bool = True) -> DataFrame:
    """(file_name, line_no, line) in the shape of ``sources.gtf.read_lines``, for ``sources.sam``; one task per file. Without ``records`` only the header is read."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, name in zip(pdf["path"], pdf["name"]):
                rows = []
                for n, line in enumerate(_lines(path, records), 1):
                    rows.append((name, n, line))
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=["file_name", "line_no", "line"])
                        rows = []
                yield pd.DataFrame(rows, columns=["file_name", "line_no", "line"])

    files = spark.createDataFrame(list(located(spark, paths).items()), "path string, name string").repartition(max(1, len(paths)))
    return files.mapInPandas(decode, "file_name string, line_no int, line string")
