import hashlib

from meshlark.llm import sharding as H


def brute(rows, limit):
    items = [(int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16), len((t or "").encode())) for d, t in rows]
    out = []
    for h, _ in items:
        d = 0
        while True:
            own = [x for x in items if x[0] >> (60 - d) == h >> (60 - d)]
            if sum(n for _, n in own) <= limit or len({x[0] for x in own}) == 1 or d == 60:
                break
            d += 1
        out.append((format(h >> (60 - d), f"0{d}b") if d else "", d, sum(n for _, n in own)))
    return sorted(out)


def test_against_a_directory_of_lists(spark, awkward):
    rows = [(i, "x" * ((i * 37) % 500)) for i in range(300)] + [(999, "y" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = H.assign(df, limit=2000).collect()
    assert sorted((r["shard"], r["depth"], r["shard_bytes"]) for r in got) == brute(rows, 2000)
    assert all(r["shard_bytes"] <= 2000 or r["oversized"] for r in got) and sum(r["oversized"] for r in got) == 1
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = H.assign(awkward, limit=3000).collect()
    assert sorted((r["shard"], r["depth"], r["shard_bytes"]) for r in got) == brute(rows, 3000)


def test_only_oversized_buckets_split(spark, monkeypatch):
    """One long document doesn't split buckets of others, and buckets beyond the first directory's depth are found."""
    rows = [(0, "y" * 500000), *((i, "x" * 100) for i in range(1, 200)), *((1000, "z" * 300) for _ in range(50)), (None, "n" * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for ahead, step in ((3, 8), (0, 1)):
        monkeypatch.setattr(H, "AHEAD", ahead)
        monkeypatch.setattr(H, "STEP", step)
        for limit in (10**6, 4000, 1000):
            got = H.assign(df, limit=limit).collect()
            assert sorted((r["shard"], r["depth"], r["shard_bytes"]) for r in got) == brute(rows, limit)
    whole = H.assign(df, limit=10**7).collect()
    assert {(r["shard"], r["depth"], r["shard_rows"]) for r in whole} == {("", 0, len(rows))}


def test_prefixes_tile_the_hash_space(spark):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(500)], "doc_id long, text string")
    shards = [r["shard"] for r in H.directory(H.assign(df, limit=4000)).collect()]
    assert len(set(shards)) == len(shards) and not any(a != b and b.startswith(a) for a in shards for b in shards)


def test_written_shards_hold_every_row(spark, tmp_path, awkward, nothing, clashing):
    path = str(tmp_path / "shards")
    H.write_shards(awkward.where("doc_id IS NOT NULL"), path, limit=5000)
    back = spark.read.parquet(path)
    assert back.count() == awkward.where("doc_id IS NOT NULL").count()
    assert H.assign(nothing).count() == 0 and H.assign(clashing(awkward)).count() == awkward.count()


def test_written_shards_hold_rows_without_an_id(spark, tmp_path, awkward, clashing):
    path = str(tmp_path / "shards")
    assigned = H.write_shards(awkward, path, limit=5000)
    back = spark.read.parquet(path)
    assert (back.count(), back.where("doc_id IS NULL").count()) == (awkward.count(), 1) and assigned.count() == awkward.count()
    names = {(r["doc_id"], r["shard"]) for r in back.collect()}
    assert names == {(r["doc_id"], "s" + r["shard"]) for r in assigned.collect()}
    H.write_shards(clashing(awkward), f"{path}-clashing", limit=5000)
    assert spark.read.parquet(f"{path}-clashing").count() == awkward.count()
