"""What the corpus operators share: words, stable copies, row names and bounds."""

from __future__ import annotations

import contextlib
import ctypes
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.plans.stable import shared_folder as shared_folder
from nearfield.plans.stable import stable as stable

#: The words of the corpus contracts, as one class of characters for Python and one for its complement in Java.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone. `lower` does just that on ASCII text and is far cheaper than `translate`."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_array(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def find_words(text: str | None) -> list[str]:
    """`word_array` in Python."""
    return WORD.findall((text or "").translate(ASCII_LOWER)) if text else []


#: Bits of a map of hashes: 4 MB whatever the corpus. A fuller map lets more rows pass and stays right.
MAP_BITS = 1 << 25


def bit_map(hashes: DataFrame) -> bytes:
    """A map with a bit set for each value of the first column, a long, at its remainder by MAP_BITS; the bit `b` is
    `map[b >> 3] >> (b & 7) & 1`. Tasks pack pages of it, so the driver gets no more than the map. Empty if none is set."""
    bit = F.pmod(F.col(hashes.columns[0]), F.lit(MAP_BITS))

    def packed(batches):
        for batch in batches:
            out = []
            for some in batch.column(1).to_pylist():
                page = np.zeros(1024, bool)
                page[some] = True
                out.append(np.packbits(page, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["page", "data"])

    pages = hashes.select(F.floor(bit / 1024).alias("page"), (bit % 1024).cast("int").alias("bit"))
    found = pages.groupBy("page").agg(F.collect_set("bit").alias("some")).mapInArrow(packed, "page long, data binary").collect()
    if not found:
        return b""
    out = np.zeros((MAP_BITS >> 10, 128), np.uint8)
    for r in found:
        out[r.page] = np.frombuffer(r.data, np.uint8)
    return out.tobytes()


def slices(batches, rows: int = 512):
    """The batches in slices, so that what a task makes of one stays small while its rows are long."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def lean(f):
    """f for mapInArrow, after which the worker gives the memory that it no longer needs back to the system: workers live on, and
    what one operator has taken would else be missing for the next."""

    def run(batches):
        yield from f(batches)
        release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


def private(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
