"""Near copies by the exact Jaccard similarity of word shingles.

Two texts are linked if they share at least ``similarity`` of their distinct five-word shingles. Texts
with equal sets of shingles are one set from the start. Candidates share a band of a MinHash signature:
with 32 bands of 4 values a pair at similarity 0.8 misses every band with probability
(1 - 0.8^4)^32 < 5e-8, and nearer pairs more seldom still. Every candidate is verified by its exact
similarity. Pairs are first told apart by sketches, four bits of each of the signature's 128 values: more
of these differ than a similar pair lets differ but with probability 1e-9 (:func:`most_differing`), so that
few sets travel to be verified. In each band's group all sets are first compared with the smallest, so that many copies of one
text do not make all their pairs. Groups that this has not joined are compared once more: small ones pair by
pair, large ones in blocks of bounded size in the task that reads them, whose common shingles are counted by
matrix products; a run of one key that is larger than a block is sent off in blocks, which meet in pairs in
tasks of their own. Only links that join something are written, never a group's pairs.

Null texts count as empty, and empty texts are equal to each other. Rows with equal ids are rows of their
own. Rows with a null id get the component of the rows that share their set, and null where none of those
has an id. A very long text is one set, and a block holds few of such. An empty table gives an empty result. Columns
other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._shared import durable, require, slices
from foliant.llm.simhash import components
from foliant.llm.simhash import near_duplicates as golay_duplicates

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
SEED = 42
#: Bits of each value of a signature that a sketch keeps.
SKETCH_BITS = 4
#: Chance that the sketches of a similar pair differ too much.
MISSED = 1e-9
#: Groups up to this size are compared pair by pair.
SMALL = 8
#: Most sets and most shingles of a block of a large group.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: Shingles whose sets are counted by one matrix product.
COLUMNS = 4096

_RNG = np.random.default_rng(SEED)
_MIX = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_FLIP = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted 64-bit hashes of the text's distinct shingles; one shingle for a text of fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words] if words else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 4096):  # a very long text is taken piece by piece
        least = np.minimum(least, ((hashes[i : i + 4096, None] ^ _FLIP) * _MIX).min(axis=0))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    values = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(v.tobytes(), i) for i, v in enumerate(values)], np.uint64).view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Bits 20 and up of each value, one bit of all values after another, as 64-bit words."""
    bits = (least[None, :] >> np.arange(20, 20 + SKETCH_BITS, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def most_differing(similarity: float, missed: float = MISSED) -> int:
    """The number of values that differ in their kept bits which a similar pair exceeds with a chance below ``missed``."""
    n, p = BANDS * ROWS, (1 - similarity) * (1 - 2.0**-SKETCH_BITS)
    tail = 0.0
    for k in range(n, -1, -1):
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail >= missed:
            return k
    return 0


def _address(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Addresses and bands of the texts' sets; the sets themselves are made again for candidates alone."""
    for batch in slices(batches):
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        least = [signature(x) for x in sets]
        keys = pa.array([bands(m) if len(x) else [] for x, m in zip(sets, least)], pa.list_(pa.int64()))
        columns = [batch.column("doc_id"), pa.array([_address(x) for x in sets], pa.binary()), keys, pa.array([sketch(m) for m in least], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "address", "keys", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of rows whose text has the address that is asked for."""
    for batch in slices(batches):
        rows = zip(*(batch.column(c).to_pylist() for c in ("text", "address", "name")))
        found = [(n, x) for t, a, n in rows if _address(x := shingles(t)) == a]
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in found], pa.int64()), pa.array([x.view(np.int64) for _, x in found], pa.list_(pa.int64()))], ["rep", "hashes"]
        )


def forest(sets: list[np.ndarray], similarity: float, split: int | None = None) -> list[tuple[int, int]]:
    """Places of the pairs that join the sets which are similar enough, link by link.

    With ``split`` only pairs of one of the first ``split`` sets and one of the others count.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], dtype=np.float64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size.astype(np.int64))
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    cut = n if split is None else split
    others = slice(0, n) if split is None else slice(split, n)
    # Whole numbers up to 2**24 are exact in single precision.
    both = np.zeros((cut, n if split is None else n - split), dtype=np.float32)
    for start in range(0, int((count > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        holds = np.zeros((n, COLUMNS), dtype=np.float32)
        holds[owner[lo:hi], column[lo:hi] - start] = 1
        both += holds[:cut] @ holds[others].T
    linked = np.zeros((n, n), bool)
    for i in range(cut):
        linked[i, others] = both[i] >= (size[i] + size[others] - both[i]) * similarity - 1e-9
    if split is not None:
        linked |= linked.T
    left, out, stack = np.ones(n, bool), [], []
    for first in range(n):
        if left[first]:
            left[first] = False
            stack.append(first)
        while stack:
            at = stack.pop()
            new = np.flatnonzero(linked[at] & left)
            left[new] = False
            out.extend((at, int(i)) for i in new)
            stack.extend(new.tolist())
    return out


_SWEPT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("block", pa.int32()), ("hashes", pa.list_(pa.int64()))])
_SWEPT_DDL = "a long, b long, key long, block int, hashes array<long>"


def _links(reps: list[int], found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        pairs = np.array([(reps[i], reps[j]) for i, j in found])
        none = [pa.nulls(len(pairs), t) for t in (pa.int64(), pa.int32(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1)), *none], schema=_SWEPT)


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(rep, hashes) of each row."""
    hashes = batch.column("hashes")
    flat, at = hashes.flatten().to_numpy(), np.r_[0, np.cumsum(pa.compute.list_value_length(hashes).to_numpy())]
    for i, rep in enumerate(batch.column("rep").to_pylist()):
        yield rep, flat[at[i] : at[i + 1]]


def _sweep(similarity: float):
    """Rows arrive by key: links of groups that fit into a block, and the members of larger ones in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks, size = None, 0, 0
        reps: list[int] = []
        sets: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal blocks, size
            n = len(reps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps), pa.nulls(n, pa.int64()), pa.array([key] * n), pa.array([blocks] * n, pa.int32()), pa.array(sets, pa.list_(pa.int64()))], schema=_SWEPT
            )
            blocks, size = blocks + 1, 0
            reps.clear()
            sets.clear()

        def end() -> Iterator[pa.RecordBatch]:
            nonlocal blocks, size
            if blocks and reps:
                yield from send()
            elif len(reps) > 1:
                yield from _links(reps, forest(sets, similarity))
            blocks, size = 0, 0
            reps.clear()
            sets.clear()

        for batch in batches:
            for k, (rep, x) in zip(batch.column("key").to_pylist(), _rows_of(batch)):
                if k != key:
                    yield from end()
                    key = k
                if reps and (len(reps) >= BLOCK or size + len(x) > BLOCK_SHINGLES):
                    yield from send()
                reps.append(rep)
                sets.append(x)
                size += len(x)
        yield from end()

    return run


def _sweep_blocks(similarity: float):
    """Rows arrive by (key, i, j): two blocks of one key, of which the links between them are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def end() -> Iterator[pa.RecordBatch]:
            if held:
                held.sort(key=lambda r: not r[0])
                reps, sets = [r for _, r, _ in held], [x for *_, x in held]
                split = None if at[1] == at[2] else sum(first for first, *_ in held)
                yield from _links(reps, forest(sets, similarity, split))
                held.clear()

        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")))
            for now, block, (rep, x) in zip(places, batch.column("block").to_pylist(), _rows_of(batch)):
                if now != at:
                    yield from end()
                    at = now
                held.append((block == now[1], rep, x))
        yield from end()

    return run


def _large_groups(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join what is similar within each group of (key, rep, hashes)."""
    swept = durable(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_sweep(similarity), _SWEPT_DDL))
    cut = swept.where(F.col("key").isNotNull()).withColumnRenamed("a", "rep")
    pairs = (
        cut.join(cut.groupBy("key").agg(F.max("block").alias("last")), "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "hashes")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(_sweep_blocks(similarity), _SWEPT_DDL)
    )
    return swept.where(F.col("key").isNull()).unionByName(pairs).select("a", "b").distinct()


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    # In whole numbers of shingles, with room for the last bit of the product alone.
    enough = both >= (F.size("x") + F.size("y") - both) * F.lit(float(similarity)) - F.lit(1e-9)
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b").distinct()


def _alike(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sketches let them be similar enough."""
    left = sketches.select(F.col("name").alias("a"), F.col("sketch").alias("x"))
    right = sketches.select(F.col("name").alias("b"), F.col("sketch").alias("y"))
    words = BANDS * ROWS // 64
    differing = F.lit(0)
    for w in range(words):
        any_bit = F.lit(0).cast("long")
        for i in range(w, words * SKETCH_BITS, words):
            any_bit = any_bit.bitwiseOR(F.col("x")[i].bitwiseXOR(F.col("y")[i]))
        differing += F.bit_count(any_bit)
    return pairs.join(left, "a").join(right, "b").where(differing <= most_differing(similarity)).select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id): one row per input row."""
    rows = require(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = durable(rows.mapInArrow(_prints, "doc_id long, address binary, keys array<long>, sketch array<long>"))
    names = durable(
        prints.where(F.col("doc_id").isNotNull())
        .groupBy("address")
        .agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
        .withColumn("name", F.xxhash64("address"))
    )
    keyed = names.select(F.explode("keys").alias("key"), F.col("name").alias("rep"))
    groups = keyed.groupBy("key").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    member = durable(keyed.join(groups, "key"))
    wanted = durable(
        names.join(member.select(F.col("rep").alias("name")).distinct(), "name").select(F.col("rep").alias("doc_id"), "address", "name", "sketch")
    )
    sketches = wanted.select("name", "sketch")
    sets = durable(rows.join(wanted.drop("sketch"), "doc_id").select("text", "address", "name").mapInArrow(_sets, "rep long, hashes array<long>"))
    near = durable(_alike(member.where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), sketches, similarity))
    stars = durable(_similar(near, sets, similarity))
    roots = components(stars).select(F.col("node").alias("rep"), "root")
    rooted = durable(member.join(roots, "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root")))
    # A group whose members are all joined has no pairs left.
    sizes = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n")
    rest = durable(rooted.join(sizes, "key"))
    few = rest.where(F.col("n") <= SMALL)
    other = few.select("key", F.col("rep").alias("b"), F.col("root").alias("other"))
    pairs = few.withColumnRenamed("rep", "a").join(other, "key").where("root <> other and a < b").select("a", "b").distinct()
    many = rest.where(F.col("n") > SMALL).select("key", "rep").join(sets, "rep")
    links = stars.unionByName(_similar(durable(_alike(pairs, sketches, similarity)), sets, similarity)).unionByName(_large_groups(many, similarity))
    # Ids instead of names; rows that repeat an id with other texts join what each of them joins.
    ids = components(durable(links.select("a", "b")))
    whole = durable(names.join(ids, names["name"] == ids["node"], "left").select("address", "rep", F.coalesce("root", "name").alias("root")))
    least = whole.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.select("doc_id", "address").join(whole.join(least, "root").select("address", "component_id"), "address", "left").select("doc_id", "component_id")


def joined_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id): the groups of Golay-code fuzzy hashing, joined further by :func:`near_copies`; one row per input row.

    Fingerprints within 4 bits link two texts as in :mod:`foliant.llm.simhash`. Texts at ``similarity`` mostly differ in more
    bits than its keys can find, so their links are added to those; none is taken away.
    """
    ids = require(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    similar = durable(near_copies(ids, similarity=similarity))
    links = golay_duplicates(ids).select("doc_id", "component_id").unionByName(similar)
    links = durable(links.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).where("a < b").distinct())
    roots = components(links)
    joined = similar.join(roots, similar["component_id"] == roots["node"], "left")
    return joined.select("doc_id", F.coalesce("root", "component_id").alias("component_id"))
