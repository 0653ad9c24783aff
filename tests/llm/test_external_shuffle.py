import zlib
from collections import Counter, defaultdict

from tallyproof.llm.external_shuffle import external_shuffle, fisher_yates, shard_digest


def test_shards_hold_every_row_once_and_grow_into_the_new_one(spark):
    rows = [(i, f"text {i % 37} " * (i % 9), 1, "x") for i in range(900)]
    rows += [(7, "again", 1, "x")] * 300 + [(None, None, 1, "x"), (901, "", 1, "x"), (902, "é" * 4000, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string").repartition(5)
    got = shard_digest(docs, bucket_bytes=2000).collect()
    assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in got) == Counter(
        (i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, _, _ in rows
    )
    slots, shards = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        shards[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8) and 0 <= r["shard"] < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    assert len({r["bucket"] for r in got if r["doc_id"] == 7}) > 2  # repeats of one row spread over buckets
    moved = sum(r["grown_shard"] == 8 for r in got if r["doc_id"] != 7)
    assert 50 < moved < 160
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["slot"]) if r["shard"] == 3 and r["doc_id"] is not None]
    assert order != sorted(order)


def test_files_hold_the_texts_in_order_and_empty_tables_pass(spark, tmp_path):
    docs = spark.createDataFrame([(i, str(i) * 50) for i in range(200)], "doc_id long, text string")
    table = external_shuffle(docs, shards=3, bucket_bytes=1500, path=str(tmp_path / "a"))
    again = external_shuffle(docs, shards=3, bucket_bytes=1500, path=str(tmp_path / "b"))
    assert sorted(table.collect()) == sorted(again.collect())
    assert {(r["doc_id"], r["text"]) for r in table.collect()} == {(i, str(i) * 50) for i in range(200)}
    assert shard_digest(docs.limit(0)).count() == 0


def test_repeats_give_one_order_in_any_layout(spark):
    rows = [(i, f"text {i} " * (i % 7)) for i in range(200)] + [(5, "again")] * 90 + [(5, "other")] * 3 + [(None, None)] * 4 + [(None, "")] * 2 + [(6, None), (6, "")]
    shuffled = lambda r, n, **more: external_shuffle(
        spark.createDataFrame(r, "doc_id long, text string").repartition(n), shards=3, seed=5, bucket_bytes=900, **more
    ).orderBy("shard", "bucket", "pos").collect()
    one = shuffled(rows, 1)
    assert one == shuffled(rows[::-1], 5) == shuffled(rows, 3, most_broadcast=0)
    assert Counter((r["doc_id"], r["text"]) for r in one) == Counter(rows)
    assert len({r["bucket"] for r in one if r["text"] == "again"}) > 2


def test_order_depends_on_rows_and_seed_alone_and_equals_a_plain_shuffle(spark):
    rows = [(i, f"text {i} " * (i % 7)) for i in range(300)]
    schema = "doc_id long, text string"
    same = [
        external_shuffle(spark.createDataFrame(r, schema).repartition(n), shards=3, seed=5, bucket_bytes=900).orderBy("shard", "bucket", "pos").collect()
        for r, n in ((rows, 1), (rows[::-1], 4))
    ]
    assert same[0] == same[1] and len({(r["shard"], r["bucket"]) for r in same[0]}) > 6
    other = external_shuffle(spark.createDataFrame(rows, schema), shards=3, seed=6, bucket_bytes=900).orderBy("shard", "bucket", "pos").collect()
    assert [r["doc_id"] for r in other] != [r["doc_id"] for r in same[0]]
    keyed = spark.createDataFrame(rows, schema).selectExpr("doc_id", "xxhash64(6, doc_id, crc32(text), cast(null as bigint)) AS mix").collect()
    mix = {r["doc_id"]: r["mix"] for r in keyed}
    groups = {}
    for r in same[0]:
        groups.setdefault((r["shard"], r["bucket"]), []).append(r["doc_id"])
    for (shard, bucket), ids in groups.items():
        held = sorted(ids, key=lambda i: mix[i])
        assert ids == [held[k] for k in fisher_yates(len(held), zlib.crc32(f"5:{shard}:{bucket}".encode()))]
