import random
from collections import Counter
from hashlib import sha256

import pytest

from foliant.llm import alignment as A

DDL = "doc_id long, text string, block long, pairs string"  # the last two clash with the operator's own
ALPHABET = ["a", "b", "the ", "ing", " ", "  ", "\n", "\n\n", "\t", " \n", ".", ",", "1", "é", "ß", "日本", "₿", "\U0001f600", " ", " ", "\x1c", "\x00", "▁", "<|endoftext|>", "<s>", "'s", "\r\n", "é", "ﬁ"]


@pytest.fixture(scope="module")
def plain_parts():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def plain_tokens(parts, text):
    """(id, bytes) of both tokenizers over the whole text, by single tokens."""
    a, b = parts
    shown = A._byte_level()
    left = [(i, bytes(shown[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])


def plain(parts, docs):
    """Every byte of every text, token by token."""
    known, counts = [], Counter()
    for doc_id, text in docs:
        left, right = plain_tokens(parts, text) if text else ([], [])
        owner = [[k for k, (_, x) in enumerate(side) for _ in x] for side in (left, right)]
        links = sorted(set(zip(*owner)))
        ends = [[sum(len(x) for _, x in side[: k + 1]) for k in range(len(side))] for side in (left, right)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for (i, _), e in zip(side, es) if lo < e <= hi) for side, es in zip((left, right), ends)))
        pairs = [(left[i][0], right[j][0]) for i, j in links]
        counts.update(pairs)
        known.append((doc_id, len(left), len(right), len(groups), pairs, sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return sorted(
        (str(d), n_a, n_b, g, len(p), sum(counts[x] == top[x[1]] for x in p), sum(counts[x] for x in p), h) for d, n_a, n_b, g, p, h in known
    )


def rows(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(ALPHABET[: rng.choice([6, 12, len(ALPHABET)])]) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, "clash") for d, t in docs], DDL)


def test_against_single_bytes(spark, plain_parts):
    docs = texts(300, 4)
    assert rows(A.align_tokens(frame(spark, docs).repartition(3))) == plain(plain_parts, docs)


def test_small_blocks_and_memory_change_nothing(spark, plain_parts, monkeypatch):
    docs = texts(60, 5) + texts(20, 5)
    want = plain(plain_parts, docs)
    batches = frame(spark, docs).select("doc_id", "text").toArrow().to_batches()
    for segments, different, remembered, encoded in ((50, 20, 30, 10), (10**6, 10**6, 10, 40)):
        monkeypatch.setattr(A, "BLOCK_SEGMENTS", segments)
        monkeypatch.setattr(A, "BLOCK_DIFFERENT", different)
        monkeypatch.setattr(A, "REMEMBERED", remembered)
        monkeypatch.setattr(A, "ENCODED", encoded)
        monkeypatch.setattr(A.TaskContext, "get", classmethod(lambda c: type("T", (), {"partitionId": staticmethod(lambda: 2)})))
        made = list(A._align(A.TOKENIZER_A, A.TOKENIZER_B)(iter(batches)))
        blocks = spark.createDataFrame(A.pa.Table.from_batches(made).to_pylist(), A.STORED)
        monkeypatch.setattr(A, "blocks_of", lambda *a, **b: blocks)
        monkeypatch.setattr(A, "durable", lambda df: df)
        assert rows(A.align_tokens(None)) == want
        assert made[0].column("block")[0].as_py() == 2 << 32


def test_whole_texts_where_segments_are_not_safe(plain_parts):
    pair = A._aligner(A.TOKENIZER_A, A.TOKENIZER_B).pair
    assert pair.segmented
    whole = A.Pair()
    whole.segmented = False
    for _, text in texts(80, 6):
        if not text:
            continue
        one, many = A.Aligner(whole), A.Aligner(pair)
        parts = pair.segments(text)
        assert "".join(parts) == " " + text
        at, each = one.learn([" " + text])[0], many.learn(parts)
        if at < 0:
            assert (each < 0).any()
        else:
            assert one.texts[at] == ";".join(many.texts[k] for k in each)
            assert one.numbers[at].tolist() == many.numbers[each].sum(axis=0).tolist()


def test_refined_cuts_are_those_of_the_bytes(plain_parts):
    pair = A._aligner(A.TOKENIZER_A, A.TOKENIZER_B).pair
    for _, text in texts(200, 7):
        a, a_ends, b, b_ends, ok = pair.encode(" a" + text)
        if ok:
            assert a_ends.tolist() == pair.a_length[a].cumsum().tolist()
            assert b_ends.tolist() == pair.b_length[b].cumsum().tolist()


def test_edges(spark, plain_parts):
    docs = [(1, None), (1, None), (2, ""), (None, "x y"), (None, "x y"), (3, " "), (4, "a" * 300_000), (5, "▁"), (6, "é ₿ " * 40), (7, "\n\n")]
    got = rows(A.align_tokens(frame(spark, docs)))
    short = [d for d in docs if d[0] != 4]
    assert [r for r in got if r[0] in ("1", "2", "5")] == [(k, 0, 0, 0, 0, 0, 0, "") for k in ("1", "1", "2", "5")]
    # The long text's tokens meet none of the others'.
    assert [r for r in got if r[0] != "4"] == plain(plain_parts, short)
    assert sum(r[1] for r in got if r[0] == "4") > 30_000
    assert A.align_tokens(frame(spark, []).limit(0)).count() == 0


def test_the_query(spark, sf_dir, plain_parts):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = rows(A.op12_token_spans(spark, sf_dir))
    assert len(got) == len(docs)
    few = {str(d): t for d, t in docs if t and len(t) < 1500}
    for r in got:
        if r[0] in few:
            left, right = plain_tokens(plain_parts, few[r[0]])
            assert r[1:3] == (len(left), len(right))
    assert sum(r[5] for r in got) > 0.5 * sum(r[4] for r in got)
