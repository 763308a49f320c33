"""Byte-level BPE encoding and decoding.

A corpus repeats its words, so each distinct one is encoded once. Texts are taken in blocks of bounded size; a
block has a dictionary of its distinct words and, for each text, the sequence of their numbers, which is the
explode with positions in packed form. The dictionaries (not the occurrences) are shuffled on a hash of the
word; a task that gets all blocks' words of some hashes encodes each distinct one once and sends the ids back
to the blocks, where the sequences are replaced by ids position by position.

A word here is what stands between two spaces, to which the space before it belongs; the pattern then splits it
into its pre-tokens. Where other white space touches a space, the words are the pattern's own matches.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StructField, StructType

from nearfield.llm.common import lean, partitions, release, slices

#: Characters of text in a block. A longer text is a block by itself.
BLOCK_CHARS = 6_000_000
#: Words that a task of the encoder remembers; one that comes later again is encoded again.
KNOWN = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a .tiktoken file: 50,256 entries or so, bounded by the vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: White space, for which the pattern looks further than to the next space.
_exotic = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_touching = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")


def split_words(text: str, find) -> list[str]:
    """The words in order. One that ends in a space is meant without it; the others are meant with a space before."""
    if text[0].isspace() or text[-1].isspace() or any(t in text for t in _touching) or _exotic(text):
        return [m + " " for m in find(text)]
    words = text.split(" ")
    words[0] += " "
    return words


def pre_tokens(word: str, find) -> list[str]:
    return find(word[:-1] if word[-1] == " " else " " + word)


def _blocks(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[tuple[int, list]]:
    """(block number, rows of id and text); numbers are unique over the tasks and the same whenever a task reads
    the same rows in the same order, as a scan of a table does."""
    part, block, chars, rows = TaskContext.get().partitionId(), 0, 0, []
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            if rows and chars + len(text) > block_chars:
                yield (part << 24) + block, rows
                rows, chars, block = [], 0, block + 1
            rows.append((i, text))
            chars += len(text)
    if rows:
        yield (part << 24) + block, rows


def _pack(numbers: np.ndarray) -> bytes:
    """Byte planes, so that the seldom used high bytes cost nearly nothing when compressed."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, ids) for each row: `ids` holds the token ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Rows with equal or null ids stay rows of their own. Other columns are not
    read. The table is scanned twice, so it must be stable, as any table that Spark can recompute is.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type, id_arrow = source.schema["id"].dataType.simpleString(), to_arrow_type(source.schema["id"].dataType)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))  # bounded by the vocabulary
    tasks = partitions(spark)

    def dictionaries(batches):
        find, pack = regex.compile(pattern).findall, zstandard.ZstdCompressor(level=1)
        for block, rows in _blocks(batches, block_chars):
            known: dict[str, None] = {}
            for _, text in rows:
                if text:
                    known.update(dict.fromkeys(split_words(text, find)))
            words = [w.encode() for w in known]
            bucket = np.fromiter((zlib.crc32(w) % (2 * tasks) for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(2 * tasks + 1))
            for b in range(2 * tasks):
                if (numbers := order[ends[b] : ends[b + 1]]).size:
                    some = [words[n] for n in numbers]
                    sizes = np.fromiter(map(len, some), np.uint32, len(some))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int32()), pa.array([block], pa.int64()), *(pa.array([pack.compress(x)], pa.binary()) for x in (_pack(numbers), _pack(sizes), b"".join(some)))],
                        ["bucket", "block", "numbers", "sizes", "words"],
                    )

    def encoded(batches):
        """Rows of a bucket come from all blocks; a word is encoded when it is first met and remembered."""
        find, one = regex.compile(pattern).findall, tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})._encode_single_piece
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor().decompress

        class Ids(dict):
            def __missing__(self, word: bytes) -> bytes:
                self[word] = out = np.array([i for m in pre_tokens(word.decode(), find) for i in one(m)], "<u4").tobytes()
                return out

        known = Ids()
        for batch in batches:
            for block, numbers, sizes, words in zip(*(c.to_pylist() for c in batch.columns[1:])):
                ends, words = np.cumsum(_unpack(unpack(sizes))).tolist(), unpack(words)
                if len(known) > KNOWN:
                    known.clear()
                ids = [known[words[a:b]] for a, b in zip([0, *ends], ends)]
                lengths = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([numbers], pa.binary()), *(pa.array([pack.compress(x)], pa.binary()) for x in (_pack(lengths), _pack(np.frombuffer(b"".join(ids), "<u4"))))],
                    ["block", "numbers", "lengths", "token_ids"],
                )

    def positions(batches):
        find, pack = regex.compile(pattern).findall, zstandard.ZstdCompressor(level=3)
        for block, rows in _blocks(batches, block_chars):
            number = defaultdict(count().__next__)
            for start in range(0, len(rows), 256):
                some = rows[start : start + 256]
                sequences = []
                for _, text in some:
                    words = split_words(text, find) if text else []
                    sequences.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        pa.array([[i for i, _ in some]], pa.list_(id_arrow)),
                        pa.array([[len(s) for s in sequences]], pa.list_(pa.int32())),
                        pa.array([pack.compress(_pack(np.concatenate(sequences)))], pa.binary()),
                    ],
                    ["block", "ids", "counts", "sequence"],
                )

    def reassembled(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        parts = [tuple(_unpack(unpack(x)) for x in row) for row in zip(*(right.column(c).to_pylist() for c in ("numbers", "lengths", "token_ids")))]
        table = [b""] * (1 + max((int(p[0].max()) for p in parts), default=-1))
        for numbers, lengths, token_ids in parts:
            data, ends = token_ids.tobytes(), (np.cumsum(lengths) * 4).tolist()
            for number, a, b in zip(numbers.tolist(), [0, *ends], ends):
                table[number] = data[a:b]
        get, ids, out = table.__getitem__, [], []
        for some, counts, data in zip(*(left.column(c).to_pylist() for c in ("ids", "counts", "sequence"))):
            sequence, at = _unpack(unpack(data)).tolist(), 0
            for i, n in zip(some, counts):
                ids.append(i)
                out.append(b"".join(map(get, sequence[at : at + n])))
                at += n
        return pa.table({id_col: pa.array(ids, id_arrow), "ids": pa.array(out, pa.binary())})

    def placed(left: pa.Table, right: pa.Table) -> pa.Table:
        out = reassembled(left, right)
        release()
        return out

    words = source.mapInArrow(lean(dictionaries), "bucket int, block long, numbers binary, sizes binary, words binary").repartition(tasks, "bucket")
    back = words.mapInArrow(lean(encoded), "block long, numbers binary, lengths binary, token_ids binary")
    rows = source.mapInArrow(lean(positions), f"block long, ids array<{id_type}>, counts array<int>, sequence binary")
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(placed, f"{id_col} {id_type}, ids binary")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds `decoded`, the bytes of the tokens: each id is looked up in the token-byte table, which is sent
    whole to the tasks since the vocabulary bounds it. Null ids give null; an unknown id is an error."""
    spark = encoded.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    at = encoded.columns.index(ids_col)
    names = [*encoded.columns, "decoded"]

    def decoded(batches):
        table = [b""] * (max(ranks.value.values(), default=-1) + 1)
        for token, rank in ranks.value.items():
            table[rank] = token
        get = table.__getitem__
        for batch in slices(batches):
            out = [None if x is None else b"".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names)

    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])
    return encoded.mapInArrow(lean(decoded), schema)
