import hashlib
import random
import re
import time

from foliant.llm import secrets as S

DDL = "doc_id long, text string, lang string"


def base_spans(text):
    """The contract, word by word."""
    text = text or ""
    found = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_base_spans_on_random_texts():
    rng = random.Random(1)
    parts = ["password", "Token", "API_KEY", "apikey", "=", ": ", '"', "'", " ", "abcdefgh", "xyz", "AKIA", "ABCDEF123456", "0" * 31, "f", "é", "\n", "=="]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert [f for f in S.find_secrets(text) if f[0] in S.BASE_KINDS] == base_spans(text), text


def test_a_dropped_match_uses_up_its_text():
    assert S.find_secrets("password: token:abcdefghij") == []
    assert S.find_secrets("toKen=ſecretſecret") == []


def test_added_kinds_keep_base_ones():
    text = "-----BEGIN RSA PRIVATE KEY----- token=eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl https://u:p@h.example"
    kinds = [f[0] for f in S.find_secrets(text)]
    assert kinds == ["pem", "assign", "jwt", "url"]


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), DDL)


def test_edges_and_copies(spark):
    secret = "password = hunter2hunter2"
    docs = frame(spark, (1, secret, "en"), (2, secret, "en"), (2, secret, "en"), (None, secret, None), (3, None, None), (4, "", "x"), (5, "é" * 70_000 + secret, "x"))
    found, ledger = S.scan_secrets(docs)
    rows = found.collect()
    assert sorted((str(r.path), len(r.findings or [])) for r in rows) == [("1", 1), ("2", 1), ("2", 1), ("3", 0), ("4", 0), ("5", 1), ("None", 1)]
    assert ledger.count() == 3  # the shared text, the empty one, the long one
    long = next(r for r in rows if r.path == 5).findings[0]
    assert (long.start, long.end) == (70_000, 70_000 + len(secret))


def test_only_unseen_pairs_are_scanned(spark):
    old, new = frame(spark, (1, "token=aaaaaaaa", "")), frame(spark, (1, "token=aaaaaaaa", ""), (2, "token=bbbbbbbb", ""))
    _, ledger = S.scan_secrets(old)
    unseen = S.scan_unseen(new, ledger)
    assert [r.blob for r in unseen.collect()] == [hashlib.sha256(b"token=bbbbbbbb").hexdigest()]
    assert S.scan_unseen(new, ledger, rule_version=2).count() == 2
    found, grown = S.scan_secrets(new, ledger)
    assert grown.count() == 2 and all(len(r.findings) == 1 for r in found.collect())


def test_empty_table(spark):
    found, ledger = S.scan_secrets(frame(spark).limit(0))
    assert found.count() == 0 and ledger.count() == 0


def test_kinds_found_by_their_middle_equal_their_patterns():
    rng = random.Random(8)
    parts = ["eyJ", ".", "eyJabcdefgh", "abcdefgh", "x", "_", "-", "://", "a", "1", "u:p@h", "@", ":", "/", " ", "ftp+x", "é", "eyJ1234567", ".eyJ"]
    for n in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        got = S.find_secrets(text)
        for kind in ("jwt", "url"):
            assert [(s, e) for k, s, e in got if k == kind] == [m.span() for m in re.finditer(S.ADDED[kind], text)], text


def test_long_runs_take_time_in_proportion():
    n = 5_000_000
    for text in ("ab1" * (n // 3) + " ://", "eyJ" * (n // 3), "eyJabcdefgh." * (n // 12), "a://" * (n // 4), "0f" * (n // 2), ".eyJ" * (n // 4), "password" * (n // 8), "-----BEGIN " * (n // 11)):
        began = time.perf_counter()
        S.find_secrets(text)
        assert time.perf_counter() - began < 20  # some seconds at most; a scan from every start would take hours
