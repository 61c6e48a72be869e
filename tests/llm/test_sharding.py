import heapq
import random
import zlib
from collections import Counter, defaultdict

from foliant.llm import sharding as S

DDL = "doc_id long, text string, shard int, slot string"  # the last two clash with columns of the result


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, "é" * rng.choice([0, 3, 40, 200, 900]), 7, "clash") for i in range(n)]


def plain_edit(entries, shards):
    """Keep the largest slots of each shard up to a fair share; give the others, largest first, to the least loaded shard."""
    share = -(-sum(e[2] for e in entries) // shards)
    by_shard, loads, where, moved = defaultdict(list), [0] * shards, {}, []
    for slot, part, size, shard in entries:
        by_shard[shard].append((-size, slot, part))
    for shard, own in by_shard.items():
        upto = 0
        for size, slot, part in sorted(own):
            upto -= size
            if upto <= share:
                loads[shard] -= size
                where[slot, part] = shard
            else:
                moved.append((size, slot, part))
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    for size, slot, part in sorted(moved):
        load, s = heapq.heappop(heap)
        where[slot, part] = s
        heapq.heappush(heap, (load - size, s))
    return where


def check_places(docs, got, shards):
    sizes = sorted((d is None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == sizes
    places = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def loads_of(got):
    out = Counter()
    for r in got:
        out[r.shard] += r["size"]
    return out


def test_places_are_gapless_and_sizes_near_equal(spark, tmp_path):
    docs = rows_of(3000)
    got = S.shard_records(spark.createDataFrame(docs, DDL), str(tmp_path / "map"), shards=8, slots=512).collect()
    check_places(docs, got, 8)
    loads = loads_of(got)
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 2 * 916 * 2
    assert len({r.virtual_slot for r in got}) > 400


def test_the_edit_against_a_plain_version(spark, tmp_path):
    path = str(tmp_path / "map")
    S.shard_records(spark.createDataFrame(rows_of(2000), DDL), path, shards=7, slots=128).count()
    old, new = S.read_version(spark, path, 1).collect(), S.read_version(spark, path).collect()
    assert all(r.version == 1 and r.shard == (r.slot + r.part) % 7 for r in old) and all(r.version == 2 for r in new)
    want = plain_edit([(r.slot, r.part, r.bytes, r.shard) for r in old], 7)
    assert {(r.slot, r.part): r.shard for r in new} == want
    assert sum(want[r.slot, r.part] != r.shard for r in old) < len(old) / 2  # an edit, not a new deal


def test_one_shard_more_takes_slots_only_into_itself(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = spark.createDataFrame(rows_of(4000), DDL)
    S.shard_records(docs, path, shards=6, slots=512).count()
    S.save_version(S.grow(S.read_version(spark, path), 6), path)
    before = {(r.slot, r.part): r.shard for r in S.read_version(spark, path, 2).collect()}
    after = S.read_version(spark, path).collect()
    assert {r.version for r in after} == {3}
    moved = [r for r in after if before[r.slot, r.part] != r.shard]
    assert moved and {r.shard for r in moved} == {6}
    load = Counter()
    for r in after:
        load[r.shard] += r.bytes
    assert max(load.values()) < 1.1 * sum(load.values()) / 7


def test_shards_are_given_up_by_an_edit(spark, tmp_path):
    path = str(tmp_path / "map")
    S.shard_records(spark.createDataFrame(rows_of(1000), DDL), path, shards=6, slots=128).count()
    S.save_version(S.rebalance(S.read_version(spark, path), 4), path)
    assert {r.shard for r in S.read_version(spark, path).collect()} == {0, 1, 2, 3}


def test_a_key_with_a_third_of_all_rows_is_split(spark, tmp_path):
    docs = rows_of(1000) + [(5, "hot " * 20, 1, "x")] * 500 + [(None, None, None, None)] * 500
    df = spark.createDataFrame(docs, DDL).repartition(3)
    got = S.shard_records(df, str(tmp_path / "map"), shards=8, slots=256).collect()
    check_places(docs, got, 8)
    loads = loads_of(got)
    assert max(loads.values()) < 1.1 * sum(loads.values()) / 8
    assert len({r.shard for r in got if r.doc_id == 5}) > 2


def test_reruns_agree(spark, tmp_path):
    df = spark.createDataFrame(rows_of(800), DDL)
    one = {r.doc_id: (r.shard, r.slot) for r in S.shard_records(df, str(tmp_path / "a")).collect()}
    assert one == {r.doc_id: (r.shard, r.slot) for r in S.shard_records(df, str(tmp_path / "b")).collect()}


def test_edges(spark, tmp_path):
    docs = [(1, None, 0, ""), (1, None, 0, ""), (None, "", 0, ""), (None, None, 0, ""), (2, "long " * 200_000, 0, ""), (3, "\U0001f600", 0, "")]
    got = S.shard_records(spark.createDataFrame(docs, DDL), str(tmp_path / "a"), shards=3).collect()
    check_places(docs, got, 3)
    assert len({r.shard for r in got if r["size"] < 100}) == 2  # the large record is a shard's whole load
    empty = spark.createDataFrame([], DDL)
    assert S.shard_records(empty, str(tmp_path / "b"), shards=3).count() == 0
    assert S.read_version(spark, str(tmp_path / "b")).where("shard = slot % 3").count() == S.SLOTS


def test_the_query_is_native(spark, sf_dir):
    df = S.op11_virtual_slots(spark, sf_dir)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = df.collect()
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    check_places([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()], rows, S.SHARDS)
