"""Files to chunks of whole lines: at most MAX_BYTES bytes and MAX_LINES lines each; a longer line is cut between code points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES, MAX_LINES = 8192, 120
_SCHEMA = T.ArrayType(T.StructType([T.StructField("byte_start", T.LongType()), T.StructField("byte_end", T.LongType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("text", T.StringType())]))


def split_file(text: str, max_bytes: int = MAX_BYTES, max_lines: int = MAX_LINES) -> list[tuple]:
    """(byte_start, byte_end, start_line, end_line, text); joined, the texts are the file."""
    out: list[tuple] = []
    held: list[str] = []
    size, at, first = 0, 0, 1

    def close(last: int) -> None:
        nonlocal held, size, at
        if held:
            out.append((at, at + size, first, last, "".join(held)))
            at += size
        held, size = [], 0

    for number, line in enumerate(text.splitlines(keepends=True) or [""], 1):
        n = len(line.encode())
        if held and (size + n > max_bytes or len(held) == max_lines):
            close(number - 1)
        if n > max_bytes:
            raw, s = line.encode(), 0
            while s < n:
                e = min(s + max_bytes, n)
                while e < n and raw[e] >> 6 == 2:  # inside a code point
                    e -= 1
                out.append((at, at + e - s, number, number, raw[s:e].decode()))
                at += e - s
                s = e
            continue
        if not held:
            first = number
        held.append(line)
        size += n
    close(number)
    return out


@F.pandas_udf(_SCHEMA)
def chunks_of(text: pd.Series) -> pd.Series:
    names = ("byte_start", "byte_end", "start_line", "end_line", "text")
    return pd.Series([None if t is None else [dict(zip(names, c)) for c in split_file(t)] for t in text])


def chunk_files(files: DataFrame, workspace: str = "w") -> DataFrame:
    """path, digest, chunk_id and the chunk's ranges and text."""
    c = files.select("path", "digest", F.explode(chunks_of("text")).alias("c")).select("path", "digest", "c.*")
    return c.withColumn("chunk_id", F.sha2(F.concat_ws("\x00", F.lit(workspace), "path", "digest", "byte_start", "byte_end"), 256))
