"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half the XXH64 values of the
text's word shingles. Two fingerprints are linked if at most 4 bits differ.

Candidate keys. The bits are cut into segments A (23), B (23) and C (18). The binary Golay code of
length 23 is perfect with covering radius 3, so two 23-bit words at distance 2 or less have a word
halfway that lies within 3 of some codeword; both are then within 4 of it. A segment's code keys are
the indices of all codewords within 4, six at most. By the pigeonhole principle 4 errors fall in one
of these ways, each with its own family of keys of 29 to 35 bits:

* C is whole: A or B has at most 2 errors: (codeword of A, C) or (codeword of B, C);
* A is whole and B has at most 2: (A, codeword of B); or B has more, so C has at most 1 and one of
  its halves is whole: (A, half of C); and the same with A and B changed about;
* all three have errors, A has 1, B at most 2 and C 1: (half of A, codeword of B, half of C); and the
  same with A and B changed about;
* A and B have 1 each and C 2: (half of A, half of B, third of C).

A key of 29 bits is shared by about two of 10^9 fingerprints that lie anyhow, so groups stay small
but for texts that are alike. Rows are sorted by key and swept once. A key's group gives links only:
for a group of more than a few fingerprints a spanning forest, found by visiting each fingerprint
once, so no group's pairs are written out. A run of one key is sent off in blocks of ``BLOCK`` as it
is read, so no task holds more of it; the blocks of a key meet in pairs in tasks of their own.
Fingerprints are deduplicated before keys are made, so a text that a third of all rows share is one
fingerprint.

Null texts count as empty, and empty texts have fingerprint zero, linked like any other. Rows with
equal ids are rows of their own. Rows with a null id get the component of the rows that share their
fingerprint, and null where none of those has an id. An empty table gives an empty result.
A very long text is hashed whole, and its bits are counted piece by piece. Columns other than id and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._shared import durable, forget, require, slices, table, written

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Largest group of one key that a single sweep compares in place.
BLOCK = 2048
#: Groups up to this size are compared pair by pair, larger ones through a spanning forest.
SMALL = 8
#: Generator polynomial of the binary Golay code of length 23: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    # bytes.lower changes A-Z alone and bytes.split cuts at the six ASCII white-space characters.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(s), SEED) for s in zip(*(words[i:] for i in range(width)))]
    raw = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(raw), 65536):  # a very long text is counted piece by piece
        ones += np.unpackbits(raw[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit number; no text is shuffled."""
    rows = require(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


@cache
def _codewords() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codeword by index, index by systematic data, error pattern by syndrome)."""
    def remainder(x: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            x = np.where(x >> bit & 1, x ^ (GOLAY << (bit - 11)), x)
        return x

    data = np.arange(4096, dtype=np.int64) << 11
    codewords = data | remainder(data)
    singles = 1 << np.arange(23, dtype=np.int64)
    zero, one = np.zeros(1, np.int64), singles
    two = np.array([a | b for i, a in enumerate(singles) for b in singles[:i]])
    three = np.array([a | b | c for i, a in enumerate(singles) for j, b in enumerate(singles[:i]) for c in singles[:j]])
    errors = np.concatenate([zero, one, two, three])
    by_syndrome = np.zeros(2048, dtype=np.int64)
    by_syndrome[remainder(errors)] = errors
    # Codewords of weight 7 at a coset's leader of weight 3 give the other codewords at distance 4.
    sevens = codewords[np.bitwise_count(codewords.astype(np.uint64)) == 7]
    return codewords, by_syndrome, sevens


@cache
def _near_by_syndrome() -> np.ndarray:
    """For each syndrome the error patterns of weight 4 or less that lead to a codeword, -1 padded.

    A word whose nearest codeword is at distance 3 has five more at distance 4; a word nearer to
    its codeword has none within 4.
    """
    _, leaders, sevens = _codewords()
    out = np.full((2048, 6), -1, dtype=np.int64)
    for s, e in enumerate(leaders):
        other = e ^ sevens
        near = other[np.bitwise_count(other.astype(np.uint64)) <= 4]
        found = np.concatenate([[e], near])
        out[s, : len(found)] = found
    return out


def golay_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6): the 12-bit indices of all codewords within 4 of each 23-bit word, -1 padded."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    errors = _near_by_syndrome()[rest]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


def candidate_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): every key of every fingerprint; linked fingerprints share at least one."""
    u = fps.astype(np.uint64)
    a, b, c = (u >> np.uint64(41)).astype(np.int64), (u >> np.uint64(18) & np.uint64(0x7FFFFF)).astype(np.int64), (u & np.uint64(0x3FFFF)).astype(np.int64)
    ga, gb = golay_keys(a), golay_keys(b)
    row = np.arange(len(u))
    rows, keys = [], []

    def add(family: int, key: np.ndarray, ok: np.ndarray) -> None:
        r = np.broadcast_to(row.reshape(-1, *[1] * (key.ndim - 1)), key.shape)[ok]
        rows.append(r)
        keys.append(key[ok] | (np.int64(family) << 56))

    yes = np.ones(len(u), bool)
    halves = lambda x, low: (x >> low, x & ((1 << low) - 1))
    a2, b2, c2 = halves(a, 11), halves(b, 11), halves(c, 9)
    c3 = (c >> 12, c >> 6 & 0x3F, c & 0x3F)
    for family, whole, own, other, codes in ((0, a, ga, b2, gb), (10, b, gb, a2, ga)):
        add(family, (own << 18) | c[:, None], own >= 0)
        add(family + 1, (whole[:, None] << 12) | codes, codes >= 0)
        for i, h in enumerate(c2):
            add(family + 2 + i, (whole << 9) | h, yes)
            for j, o in enumerate(other):
                add(family + 4 + 2 * i + j, (((own << 12) | o[:, None]) << 9) | h[:, None], own >= 0)
    for i, x in enumerate(a2):
        for j, y in enumerate(b2):
            for k, z in enumerate(c3):
                add(20 + 6 * i + 3 * j + k, (((x << 12) | y) << 6) | z, yes)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, rep = batch.column("fp").to_numpy(), batch.column("rep").to_numpy()
        for i in range(0, len(fp), 4096):
            rows, keys = candidate_keys(fp[i : i + 4096])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(fp[i : i + 4096][rows]), pa.array(rep[i : i + 4096][rows])], ["key", "fp", "rep"]
            )


def _forest(fp: np.ndarray, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (places) of a spanning forest of the links of one group, at most one a fingerprint.

    With ``split`` only links between the first ``split`` fingerprints and the others count.
    """
    left = np.arange(len(fp))
    source, target = [], []
    stack: list[int] = []
    while len(left):
        if not stack:
            stack.append(left[0])
            left = left[1:]
        at = stack.pop()
        reach = np.bitwise_count(fp[left] ^ fp[at]) <= MAX_BITS
        if split is not None:
            reach &= (left < split) != (at < split)
        if reach.any():
            new = left[reach]
            source.append(np.full(len(new), at))
            target.append(new)
            stack.extend(new.tolist())
            left = left[~reach]
    return (np.concatenate(source), np.concatenate(target)) if source else (np.zeros(0, int), np.zeros(0, int))


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("block", pa.int32())])


def _edge_batch(a, b) -> pa.RecordBatch:
    none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int64(), pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *none], schema=_EDGE)


def _block_batch(key: int, block: int, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    """Members of a group that is too large for one task."""
    n = len(fp)
    return pa.RecordBatch.from_arrays(
        [pa.array(rep), pa.nulls(n, pa.int64()), pa.array(np.full(n, key)), pa.array(fp.view(np.int64)), pa.array(np.full(n, block, dtype=np.int32))], schema=_EDGE
    )


def _whole_runs(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of groups that are complete, or their members in blocks."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    big = size > SMALL
    small = np.repeat(~big, size)
    k, f, r = key[small], fp[small], rep[small]
    a, b = [], []
    for step in range(1, SMALL):
        hit = np.flatnonzero((k[step:] == k[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= MAX_BITS))
        a.append(r[hit])
        b.append(r[hit + step])
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        yield _edge_batch(a, b)
    for s, n in zip(start[big], size[big]):
        f, r = fp[s : s + n], rep[s : s + n]
        if n > BLOCK:
            for i in range(0, n, BLOCK):
                yield _block_batch(int(key[s]), i // BLOCK, f[i : i + BLOCK], r[i : i + BLOCK])
            continue
        x, y = _forest(f)
        if len(x):
            yield _edge_batch(r[x], r[y])


class _Run:
    """The last key's rows so far, at most ``BLOCK`` of them: full blocks are sent off."""

    def __init__(self, key: int):
        self.key, self.blocks = key, 0
        self.fp, self.rep = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, fp: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.fp, self.rep = np.concatenate([self.fp, fp]), np.concatenate([self.rep, rep])
        while len(self.fp) > BLOCK:
            yield _block_batch(self.key, self.blocks, self.fp[:BLOCK], self.rep[:BLOCK])
            self.blocks += 1
            self.fp, self.rep = self.fp[BLOCK:], self.rep[BLOCK:]

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.blocks:
            yield _block_batch(self.key, self.blocks, self.fp, self.rep)
        else:
            yield from _whole_runs(np.full(len(self.fp), self.key), self.fp, self.rep)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive in order of key. Only the run of the last key waits for the next batch."""
    run: _Run | None = None
    for batch in batches:
        key, fp, rep = (batch.column(c).to_numpy() for c in ("key", "fp", "rep"))
        fp = fp.view(np.uint64)
        if run is not None:
            more = int(np.searchsorted(key, run.key, side="right"))
            yield from run.add(fp[:more], rep[:more])
            if more == len(key):
                continue
            yield from run.end()
            key, fp, rep = key[more:], fp[more:], rep[more:]
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield from _whole_runs(key[:cut], fp[:cut], rep[:cut])
        run = _Run(int(key[-1]))
        yield from run.add(fp[cut:], rep[cut:])
    if run is not None:
        yield from run.end()


def _sweep_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks of a large group, each pair in one run of (key, first, second)."""
    held: list = []
    at = None

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        fp, rep, mine = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(~mine, kind="stable")
        fp, rep = fp[order], rep[order]
        split = int(mine.sum())
        s, t = _forest(fp, None if at[1] == at[2] else split)
        if len(s):
            yield _edge_batch(rep[s], rep[t])

    for batch in batches:
        key, i, j, block = (batch.column(c).to_numpy() for c in ("key", "i", "j", "block"))
        fp, rep = batch.column("fp").to_numpy().view(np.uint64), batch.column("a").to_numpy()
        change = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        for s, e in zip(change, np.r_[change[1:], len(key)]):
            now = (key[s], i[s], j[s])
            if now != at:
                yield from flush()
                at = now
            held.append((fp[s:e], rep[s:e], block[s:e] == i[s:e]))
    yield from flush()


_EDGE_DDL = "a long, b long, key long, fp long, block int"


def link_edges(distinct: DataFrame) -> DataFrame:
    """(a, b): links between representatives of (fp, rep) that keep every component whole."""
    keyed = distinct.mapInArrow(_keyed, "key long, fp long, rep long")
    swept = durable(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_sweep, _EDGE_DDL))
    cut = swept.where(F.col("key").isNotNull())
    heavy = (
        cut.join(cut.groupBy("key").agg(F.max("block").alias("last")), "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "a")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(_sweep_blocks, _EDGE_DDL)
    )
    return swept.where(F.col("key").isNull()).unionByName(heavy).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, by large and small stars.

    Each round turns every node's larger neighbours to its smallest neighbour, then its smaller
    ones; the rounds end when the edges are stars. Minima are aggregates with a map side, and a
    hub's rows are joined (which Spark may split), never gathered.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            seen = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            seen = e.select(F.col("b").alias("a"), F.col("a").alias("b"))  # neighbours below the node
        least = seen.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        moved = seen.join(least, seen["a"] == least["n"]).where(F.col("b") > F.col("a")) if large else seen.join(least, seen["a"] == least["n"])
        out = moved.select(F.col("m").alias("a"), "b")
        if not large:  # the node itself moves under its smallest neighbour, too
            out = out.unionByName(least.select(F.col("m").alias("a"), F.col("n").alias("b")))
        return out.where("a <> b").distinct()

    now, path = written(edges.where("a < b").distinct())
    before = None
    while True:
        old = path
        now, path = written(star(star(now, True), False))
        forget(edges.sparkSession, old)
        size = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == before:
            break
        before = size
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per input row."""
    prints = durable(fingerprints(docs, id_col, text_col))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(link_edges(distinct.where(F.col("rep").isNotNull())))
    labels = distinct.join(roots, distinct["rep"] == roots["node"], "left").select(
        F.col("fp").alias("l_fp"), F.coalesce("root", "rep").alias("component_id")
    )
    return prints.join(labels, F.col("fp") == F.col("l_fp")).select("doc_id", "fp", "component_id")


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
