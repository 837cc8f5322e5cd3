import hashlib
import math
import zlib
from collections import Counter, defaultdict

from lectern.llm.sharding import shard, write_shards


def test_shard(docs, rows):
    got = shard(docs, [1.0] * 16).collect()
    text = lambda r: (r[1] or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len(text(r)) + 1, zlib.crc32(text(r))) for r in rows)
    slots, by_id = defaultdict(list), defaultdict(set)
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
        by_id[r.doc_id].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for k, s in by_id.items() if k is not None)


def test_shards_are_those_of_the_least_draws(docs, rows):
    def best(key, n):
        draw = lambda i: -math.log((int(hashlib.md5(f"{key}#{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52))
        return min(range(n), key=lambda i: (draw(i), i))

    got = {(r.doc_id, r.text_crc32): (r.shard, r.grown_shard) for r in shard(docs, [1.0] * 16).collect()}
    for r in rows:
        text = (r[1] or "").encode()
        key = str(r[0]) if r[0] is not None else "text:" + hashlib.md5(text).hexdigest()
        assert got[r[0], zlib.crc32(text)] == (best(key, 16), best(key, 17))


def test_weights(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text")
    n = Counter(r.shard for r in shard(docs, [1.0, 2.0, 0.0, 1.0]).collect())
    assert set(n) == {0, 1, 3} and abs(n[1] - 10000) < 400
    moved = shard(docs, [1.0] * 4, [1.0, 1.0, 1.0, 3.0]).filter("shard != grown_shard")
    assert {r.grown_shard for r in moved.select("grown_shard").distinct().collect()} == {3}


def test_empty(no_docs, spark, docs, tmp_path):
    assert shard(no_docs, [1.0] * 16).count() == 0
    write_shards(docs, [1.0] * 4, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
