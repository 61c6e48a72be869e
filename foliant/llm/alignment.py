"""Alignment of two tokenizers' tokens by the bytes that they cover.

A is a byte-level BPE read by ``tokenizers``, B a sentencepiece BPE with byte fallback. Both libraries' spans are
coarse cuts: A's are ranges of characters, B's (from its proto) ranges of bytes, and both are right wherever a token
holds whole characters. Where a token is part of a character (A's tokens inside a multibyte character all span the
whole of it, B's byte tokens give an empty span but for the last) the cut is refined by the bytes that the token
decodes to. Offsets where tokens of both end cut a text into groups; tokens link where their bytes overlap.

Texts are tokenised by segment, a run of white space and what follows it up to the next: neither tokenizer has a
token across such a place (A's pattern splits there, and B's vocabulary is searched for a counter-example when it is
loaded; were there one, a segment would be the whole text). A task aligns each different segment once: the segments
it has not met are joined and encoded together, and the alignment is cut at their borders. What it remembers is bounded.

A task's documents form blocks of bounded size. A block has a row for each document (its segments and what is known
of it alone) and one row for the block itself: its different id pairs with their counts, and which pairs each segment
links. Pair counts of all blocks are added up, a block's own pairs are joined with the totals, and block and totals
meet once more to score the documents. So what is shuffled is one row a block and pair, and a few numbers a different
segment of a document; neither tokens nor links are.

Documents whose text is null or empty, or whose tokens of either kind do not spell out a space and the text, have no
tokens: zeros, and '' for the hash. Repeated rows are documents of their own and count each time. A null id stays. A
very long text is a block of its own, whatever its length. An empty table gives an empty result. Other columns are
ignored. Pair counts have no ties to settle: every pair at its B id's highest count is a best one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm._shared import durable, require, slices, table

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k", "piece_bpe_32k"
#: Segments, repeats included, and different segments, after which a block is closed.
BLOCK_SEGMENTS, BLOCK_DIFFERENT = 2_000_000, 150_000
#: Alignments that a task remembers, and bytes of new segments that are encoded together.
REMEMBERED, ENCODED = 500_000, 20_000
#: White space and what follows, up to the next space or line end that comes after something else.
SEGMENT = re.compile(r"\s+\S*(?:[^\S \n]\s*\S*)*")
B_SPACE = "▁"

DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
STORED = f"block long, {DOC}, segments array<int>, times array<int>, pairs array<long>, pair_n array<long>, links_from array<int>, link array<int>, link_n array<int>"
SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_level() -> dict[str, int]:
    """Byte-level BPE's alphabet: bytes that print stand for themselves, the others, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    return shown | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Pair:
    """The two tokenizers with the bytes of each of their ids."""

    def __init__(self, a: str = TOKENIZER_A, b: str = TOKENIZER_B):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(f"{a}.json"))
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{b}.model"))
        shown = _byte_level()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(B_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_whole, self.b_whole = (np.array([_whole(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.b_whole &= [not self.b.is_byte(i) for i in range(len(pieces))]
        # A cut before a space or line end that follows anything else is safe if no piece of B goes across one.
        self.segmented = not any(re.search(rf"[^{B_SPACE}\n]({B_SPACE}|\n)|{B_SPACE}\n|\n.", p, re.S) for p in pieces)

    def segments(self, text: str) -> list[str]:
        return SEGMENT.findall(" " + text) if self.segmented else [" " + text]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
        """(ids, byte ends) by A and by B of a text that begins with a space, and whether both spell it out."""
        raw = text.encode()
        enc = self.a.encode(text, add_special_tokens=False)
        a = np.array(enc.ids, dtype=np.int64)
        ends = np.fromiter(chain.from_iterable(enc.offsets), dtype=np.int64, count=2 * len(a))[1::2]
        if len(raw) != len(text):  # characters to bytes
            lead = np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80
            ends = np.append(np.flatnonzero(lead), len(raw))[ends]
        proto = self.b.encode(text[1:], num_threads=1, return_type="proto").pieces
        b = np.array([p.id for p in proto], dtype=np.int64)
        b_ends = np.array([p.end for p in proto], dtype=np.int64) + 1  # the space that B adds
        ok = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw == b"".join(map(self.b_bytes.__getitem__, b.tolist()))
        return a, _refined(ends, self.a_length[a], self.a_whole[a]), b, _refined(b_ends, self.b_length[b], self.b_whole[b]), ok


def _whole(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def _refined(ends: np.ndarray, length: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Byte ends: the library's, but for runs of tokens that are parts of characters, which go on by their bytes."""
    if whole.all():
        return ends
    parts = np.flatnonzero(~whole)
    out, runs = ends.copy(), np.split(parts, np.flatnonzero(np.diff(parts) > 1) + 1)
    for run in runs:
        first = run[0]
        out[run] = (out[first - 1] if first else 0) + np.cumsum(length[run])
    return out


def links_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of all tokens whose bytes overlap, by A and then B. Tokens without bytes overlap none."""
    a_starts, b_starts = (np.append(0, e[:-1]) for e in (a_ends, b_ends))
    first = np.searchsorted(b_ends, a_starts, side="right")
    last = np.searchsorted(b_starts, a_ends, side="left")
    n = np.where(a_ends > a_starts, np.maximum(last - first, 0), 0)
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[at]


class Aligner:
    """Alignments of segments, remembered up to a bound, in arrays.

    ``known`` gives a segment's number, or -1 where its tokens do not spell it out. ``numbers`` has its tokens of A and B, groups
    and links, ``texts`` its groups as text; ``starts``, ``code`` and ``times`` its id pairs and how many links each has.
    """

    def __init__(self, pair: Pair):
        self.pair = pair
        self.words = [str(i) for i in range(max(len(pair.a_bytes), len(pair.b_bytes)))]
        self.digits = np.array([len(w) for w in self.words], dtype=np.int64)
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.numbers, self.starts = np.zeros((0, 4), dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.code, self.times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.new: list[tuple] = []

    def _keep(self, segments: list[str]) -> None:
        """Forget all but these."""
        spelled = [s for s in segments if self.known[s] >= 0]
        at = np.array([self.known[s] for s in spelled], dtype=np.int64)
        entry, sizes = self.entries(at)
        texts, numbers, code, times = [self.texts[i] for i in at.tolist()], self.numbers[at], self.code[entry], self.times[entry]
        known = dict(zip(spelled, range(len(spelled)))) | {s: -1 for s in segments if self.known[s] < 0}
        self.known, self.texts, self.numbers, self.code, self.times = known, texts, numbers, code, times
        self.starts = np.append(0, np.cumsum(sizes))

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the id pairs of these segments, one after another, how many each has)."""
        begin, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes), sizes

    def learn(self, segments: list[str]) -> np.ndarray:
        """The numbers of ``segments``."""
        if len(self.known) + len(segments) > REMEMBERED:
            self._keep([s for s in segments if s in self.known])
        batch: list[str] = []
        size = 0
        for s in segments:
            if s not in self.known:
                batch.append(s)
                size += len(s)
                # White space at a segment's end is at its text's end; nothing may come after it.
                if size >= ENCODED or not self.pair.segmented or s[-1].isspace():
                    self._encode(batch)
                    batch, size = [], 0
        if batch:
            self._encode(batch)
        if self.new:
            numbers, counts, code, times = zip(*self.new)
            self.numbers = np.concatenate([self.numbers, *numbers])
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(np.concatenate(counts)))
            self.code, self.times = np.concatenate([self.code, *code]), np.concatenate([self.times, *times])
            self.new = []
        return np.array(list(map(self.known.__getitem__, segments)), dtype=np.int64)

    def _encode(self, segments: list[str]) -> None:
        """All together, for their borders are cuts of both tokenizers; in halves where some do not spell out."""
        joined = " a" + "".join(segments) if self.pair.segmented else segments[0]
        a, a_ends, b, b_ends, ok = self.pair.encode(joined)
        if not ok:
            if len(segments) == 1:
                self.known[segments[0]] = -1
            else:
                half = len(segments) // 2
                self._encode(segments[:half])
                self._encode(segments[half:])
            return
        borders = np.cumsum([2 if self.pair.segmented else 0, *(len(s.encode()) for s in segments)])
        shared = a_ends[b_ends[np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)] == a_ends]
        cuts = shared[np.append(True, shared[1:] != shared[:-1])]
        a_at, b_at, cut_at = (np.where(borders > 0, np.searchsorted(e, borders, side="right"), 0) for e in (a_ends, b_ends, cuts))
        # Equal pairs of one segment become one entry: sorted by segment and pair, runs are counted.
        at, to = links_of(a_ends, b_ends)
        of, code = np.searchsorted(a_at, at, side="right") - 1, (a[at] << 32) | b[to]
        at_of = np.searchsorted(of, np.arange(len(segments) + 1))
        order = np.lexsort((code, of))
        of, code = of[order], code[order]
        first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (code[1:] != code[:-1])))
        times = np.diff(np.append(first, len(of)))
        inside = of[first] >= 0  # not the word before the first segment
        self.texts += self._texts(a, a_ends, b, b_ends, cuts, cut_at)
        numbers = np.stack([np.diff(a_at), np.diff(b_at), np.diff(cut_at), np.diff(at_of)], axis=1)
        self.new.append((numbers, np.bincount(of[first][inside], minlength=len(segments)), code[first][inside], times[inside]))
        begin = len(self.texts) - len(segments)
        self.known.update(zip(segments, range(begin, begin + len(segments))))

    def _texts(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, cuts: np.ndarray, cut_at: np.ndarray) -> list[str]:
        """``a1,a2|b1;..`` of each segment: all ids in one order with what stands after each, cut at the segments' borders."""
        of_a, of_b = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)  # tokens without bytes stay with the group before them
        n_a, n_b = np.bincount(of_a, minlength=len(cuts)), np.bincount(of_b, minlength=len(cuts))
        begin = np.append(0, np.cumsum(n_a + n_b))
        ids, after = np.empty(begin[-1], dtype=np.int64), np.full(begin[-1], ",")
        ids[begin[of_a] + np.arange(len(a)) - (np.cumsum(n_a) - n_a)[of_a]] = a
        ids[begin[of_b] + n_a[of_b] + np.arange(len(b)) - (np.cumsum(n_b) - n_b)[of_b]] = b
        after[begin[:-1] + n_a - 1], after[begin[1:] - 1] = "|", ";"
        text = "".join(chain.from_iterable(zip(map(self.words.__getitem__, ids.tolist()), after.tolist())))
        places = np.append(0, np.cumsum(self.digits[ids] + 1))[begin][cut_at].tolist()
        return [text[s : e - 1] for s, e in zip(places, places[1:])]


@cache
def _aligner(a: str, b: str) -> Aligner:
    """A worker's tasks share what it has aligned."""
    return Aligner(Pair(a, b))


class _Numbers(dict):
    """Segment -> its number in a block, in order of coming."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def _flat(lists: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*lists, np.zeros(0, dtype=np.int64)]).astype(kind)))


def _block(aligner: Aligner, number: int, rows: list[tuple[int | None, np.ndarray]], names: _Numbers) -> Iterator[pa.RecordBatch]:
    """The rows of a block: one a document, and then its own."""
    at = aligner.learn(list(names))
    bad = at < 0
    numbers = np.where(bad[:, None], 0, aligner.numbers[at]) if len(aligner.numbers) else np.zeros((len(at), 4), dtype=np.int64)
    texts = [aligner.texts[i] if i >= 0 else "" for i in at.tolist()]
    occurs = np.zeros(len(at), dtype=np.int64)
    ids, totals, hashes, own, times = [], [], [], [], []
    for doc_id, found in rows:
        if bad.any() and bad[found].any():
            found = found[:0]
        different, n = np.unique(found, return_counts=True)
        occurs[different] += n
        ids.append(doc_id), own.append(different), times.append(n)
        totals.append(n @ numbers[different])
        hashes.append(sha256(";".join(map(texts.__getitem__, found.tolist())).encode()).hexdigest() if len(found) else "")
    # The id pairs of the segments that occur, each segment's together.
    entry, some = aligner.entries(at[occurs > 0])
    sizes = np.zeros(len(at), dtype=np.int64)
    sizes[occurs > 0] = some
    link_n = aligner.times[entry]
    pairs, link = np.unique(aligner.code[entry], return_inverse=True)
    pair_n = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(pair_n, link, link_n * np.repeat(occurs, sizes))
    totals = np.array(totals, dtype=np.int64).reshape(-1, 4)
    schema = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "segments", "times", "pairs", "pair_n", "links_from", "link", "link_n"]

    def nothing(kind, n: int) -> pa.Array:
        return pa.nulls(n, kind)

    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    for s in range(0, len(rows), 2000):
        e = min(len(rows), s + 2000)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number] * (e - s), pa.int64()), pa.array(ids[s:e], pa.int64()), *(pa.array(totals[s:e, c]) for c in range(4)), pa.array(hashes[s:e], pa.string()),
                _flat(own[s:e], np.int32), _flat(times[s:e], np.int32), nothing(longs, e - s), nothing(longs, e - s), nothing(ints, e - s), nothing(ints, e - s), nothing(ints, e - s),
            ],
            schema,
        )
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()), *(nothing(pa.int64(), 1) for _ in range(5)), nothing(pa.string(), 1), nothing(ints, 1), nothing(ints, 1),
            _flat([pairs], np.int64), _flat([pair_n], np.int64), _flat([np.cumsum([0, *sizes])], np.int32), _flat([link], np.int32), _flat([link_n], np.int32),
        ],
        schema,
    )


def _align(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(a, b), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        names, size = _Numbers(), 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = np.array([names[s] for s in aligner.pair.segments(text)] if text else [], dtype=np.int32)
                rows.append((doc_id, found))
                size += len(found)
                if size >= BLOCK_SEGMENTS or len(names) >= BLOCK_DIFFERENT:
                    yield from _block(aligner, number, rows, names)
                    rows, names, size, number = [], _Numbers(), 0, number + 1
        if rows:
            yield from _block(aligner, number, rows, names)

    return run


def blocks_of(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = require(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_align(a, b), STORED)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best) over the corpus: how many links hold an id pair, and whether it is its B id's highest.

    An id of B meets at most all ids of A, so its window has a bound.
    """
    entry = F.explode(F.arrays_zip("pairs", "pair_n")).alias("e")
    counts = blocks.where("pairs is not null").select(entry).groupBy(F.col("e.pairs").alias("pair")).agg(F.sum("e.pair_n").alias("count"))
    b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    return counts.withColumn("best", F.col("count") == F.max("count").over(b))


def _score(stored: pa.Table, totals: pa.Table) -> pa.Table:
    """One block: its documents' sums over their links. ``totals`` has a count for each of the block's pairs."""
    own = stored.column("pairs").is_valid()
    docs, head = stored.filter(stored.column("pairs").is_null()), stored.filter(own)
    at = totals.column("at").to_numpy()
    count, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    count[at], best[at] = totals.column("count").to_numpy(), totals.column("best").to_numpy().astype(np.int64)
    part = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy().astype(np.int64)
    starts, link, link_n = (part(head, c) for c in ("links_from", "link", "link_n"))
    segments, times = part(docs, "segments"), part(docs, "times")
    sizes = docs.column("segments").combine_chunks().value_lengths().to_numpy()
    ends = np.append(0, np.cumsum(sizes))

    def by_doc(value: np.ndarray) -> pa.Array:
        run = np.append(0, np.cumsum(link_n * value[link]))
        of = np.append(0, np.cumsum((run[starts[1:]] - run[starts[:-1]])[segments] * times))
        return pa.array(of[ends[1:]] - of[ends[:-1]])

    out = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(out | {"n_best": by_doc(best), "count_sum": by_doc(count), "groups_sha256": docs.column("groups_sha256")})


def align_tokens(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, **columns) -> DataFrame:
    """One row a document: tokens, groups and links of both tokenizers, and its links' counts over the corpus."""
    blocks = durable(blocks_of(docs, a, b, **columns))
    counts = durable(pair_counts(blocks))
    places = blocks.where("pairs is not null").select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("at", "pair"))
    totals = places.join(counts, "pair").select("of_block", "at", "count", "best")
    return blocks.groupBy("block").cogroup(totals.groupBy("of_block")).applyInArrow(_score, SCORED)


def op12_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))
