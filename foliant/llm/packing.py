"""Best-fit packing into token sequences by hierarchical residual packing.

Texts are tokenised where they are read; only longer documents are cut, the first piece taking the
remainder so that every other piece fills a sequence. Pieces (a few numbers each, no texts) are dealt
out evenly; each partition packs its own best-fit decreasing and sends off bins that are full or
nearly so. Underfull bins become the items of the next round, over fewer partitions, and so on until
a round has one partition or more rounds would not help. Rounds are written to the shared folder, so
a lost executor never makes two branches see different bins. No partition gets more than about
``ROUND_ITEMS`` items: while there are more, they stay spread over several, each of which has more
items than best fit needs.

With ``SLACK`` 0 only full bins are sent off before the last round, which needs the fewest sequences; a larger
one sends nearly full ones off as well and so shortens the rounds.

Null texts are empty; a document always ends with id 0, so an empty one has one token. Repeated
rows are packed as often as they come. Rows with a null id are packed like any other. A very long
text is tokenised whole and gives many pieces. An empty table gives an empty result. Columns other than id
and text are ignored.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._shared import durable, require, slices, table

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k"
#: Bins with at most this many free places are not packed any further.
SLACK = 0
ROUND_ITEMS = 50_000
FAN_IN = 8

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
PLACED = f"{PIECES}, bin string, used int, offset int"


class Encoder:
    """Token ids of the named public vocabulary, as ``tokenizers`` gives them with no special tokens added.

    The same vocabulary is read as ranks, whose ids are the same and come several times faster. A
    text that spells out the vocabulary's special token, which ``tokenizers`` would take for it,
    is left to ``tokenizers``.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, name: str = TOKENIZER):
        import public_tokenizers
        import tiktoken

        self.path = public_tokenizers.path
        self.name = name
        with open(self.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def __call__(self, text: str) -> np.ndarray:
        if self.SPECIAL in text:
            return np.array(self.exact(text), dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")

    def exact(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path(f"{self.name}.json"))
        return self.slow.encode(text, add_special_tokens=False).ids


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))] if length > capacity else [(0, length)]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset of each item, used of each bin), best-fit decreasing, ties in the given order."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    used: list[int] = []
    open_bins: dict[int, list[int]] = {}  # free places -> bins
    free: list[int] = []  # the keys of open_bins, in order
    for item in order.tolist():
        size = int(sizes[item])
        at = bisect_left(free, size)
        if at < len(free):
            room = free[at]
            stack = open_bins[room]
            b = stack.pop()
            if not stack:
                del open_bins[room], free[at]
        else:
            room, b = capacity, len(used)
            used.append(0)
        bins[item], offsets[item] = b, used[b]
        used[b] += size
        if room > size:
            left = room - size
            if left in open_bins:
                open_bins[left].append(b)
            else:
                open_bins[left] = [b]
                insort(free, left)
    return bins, offsets, np.array(used, dtype=np.int64)


def _tokenise(capacity: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(name)
        for batch in slices(batches):
            rows: list[tuple] = []
            ids_of = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids_of, batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = zip(*rows) if rows else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def pieces_of(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    rows = require(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_tokenise(capacity, tokenizer), PIECES)


def _pack_round(capacity: int, round_no: int):
    """Items are the bins of the round before (each piece a bin of its own at first); one call for each part."""

    def pack_part(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(got)
        part = rows.column("part")[0].as_py()
        keys = rows.column("bin").combine_chunks().dictionary_encode()
        names = np.array(keys.dictionary.to_pylist())
        by_name = np.empty(len(names), dtype=np.int64)  # items in an order that does not hang on arrival
        by_name[np.argsort(names)] = np.arange(len(names))
        item = by_name[keys.indices.to_numpy()]
        size = np.zeros(len(names), dtype=np.int64)
        size[item] = rows.column("used").to_numpy()
        b, offset, used = best_fit(size, capacity)
        out = rows.drop_columns(["part", "bin", "used", "offset"])
        label = pa.array([f"{round_no}-{part}-{i}" for i in range(len(used))])
        out = out.append_column("bin", label.take(pa.array(b[item])))
        out = out.append_column("used", pa.array(used[b[item]].astype(np.int32)))
        out = out.append_column("offset", pa.array((rows.column("offset").to_numpy() + offset[item]).astype(np.int32)))
        yield from out.to_batches(max_chunksize=20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            part = batch.column("part").to_numpy()
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            for s, e in zip(starts, [*starts[1:], len(part)]):
                if held and held[-1].column("part")[0].as_py() != part[s]:
                    yield from pack_part(held)
                    held = []
                held.append(batch.slice(s, e - s))
        if held:
            yield from pack_part(held)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """``pieces`` with sequence_id and offset. The tokens of ``pieces`` should already be written down."""
    number = F.monotonically_increasing_id()
    items = pieces.select(
        *[f.split()[0] for f in PIECES.split(", ")],
        number.alias("n"),
        F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece", number).alias("bin"),
        F.col("length").alias("used"),
        F.lit(0).alias("offset"),
    )
    parts, round_no, done = max(1, -(-pieces.count() // ROUND_ITEMS)), 0, []
    deal, left, open_bins = F.xxhash64("n"), None, items
    while True:
        now = durable(
            open_bins.withColumn("part", F.pmod(deal, F.lit(parts)).cast("int"))
            .drop("n")
            .repartition(parts, "part")
            .sortWithinPartitions("part")
            .mapInArrow(_pack_round(capacity, round_no), PLACED)
        )
        done.append(now.where(F.col("used") >= capacity - slack))
        open_bins = now.where(F.col("used") < capacity - slack)
        if parts == 1:
            break
        bins = open_bins.select("bin").distinct().count()
        fewest = -(-bins // ROUND_ITEMS)
        if not bins or (fewest > 1 and left is not None and bins >= left):
            break
        parts, left, round_no = min(parts, max(fewest, parts // FAN_IN, 1)), bins, round_no + 1
        deal = F.xxhash64("bin", F.lit(round_no))
    placed = open_bins
    for d in done:
        placed = placed.unionByName(d)
    name = F.split("bin", "-")
    # Round, partition and number in one long: 8, 24 and 31 bits.
    sequence = F.shiftleft(name[0].cast("long"), 55) + F.shiftleft(name[1].cast("long"), 31) + name[2].cast("long")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", sequence.alias("sequence_id"), F.col("offset").cast("long")
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, **columns) -> DataFrame:
    return pack(durable(pieces_of(docs, capacity, tokenizer, **columns)), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
