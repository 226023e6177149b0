"""Files that settle, and the store of contents with its manifest."""

import os

import pytest
from pyspark.sql import functions as F

from seriesloom.streaming import ingest, manifest
from seriesloom.streaming.settled import SettledReader, settled_files

ROWS = "content_hash string, at long"


def reader(tmp_path, **options):
    return SettledReader({"path": str(tmp_path / "in"), "log": str(tmp_path / "log"), "settle": "0.05", **options})


def names(r, start, end):
    return [f[0] for part in r.partitions(start, end) for f in part.files]


def test_a_file_that_grows_is_not_released(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    still, grows = tmp_path / "in" / "deep" / "still.bin", tmp_path / "in" / "grows.bin"
    still.write_bytes(b"12345")
    grows.write_bytes(b"1")
    r = reader(tmp_path)
    look = r._look

    def growing():
        with open(grows, "ab") as f:
            f.write(b"2")
        return look()

    r._look = growing
    first = r.latestOffset()
    assert names(r, r.initialOffset(), first) == ["deep/still.bin"]
    assert r.latestOffset() == first  # it grew again between the looks
    r._look = look
    last = reader(tmp_path).latestOffset()  # a restart goes on from the log
    assert names(reader(tmp_path), first, last) == ["grows.bin"] and reader(tmp_path).latestOffset() == last
    (row,) = [b.to_pylist()[0] for part in r.partitions(first, last) for b in r.read(part)]
    assert row["content"] == grows.read_bytes() and row["length"] == grows.stat().st_size


def test_changed_files_come_again_and_others_never(tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.bin", "b.bin", "c.txt"):
        (tmp_path / "in" / name).write_bytes(b"1")
    r = reader(tmp_path, pattern="*.bin", maxfilespertrigger="1", filespertask="1")
    one, two = r.latestOffset(), r.latestOffset()
    assert names(r, r.initialOffset(), two) == ["a.bin", "b.bin"] and names(r, one, two) == ["b.bin"]
    assert len(r.partitions(r.initialOffset(), two)) == 2 and r.latestOffset() == two
    os.remove(tmp_path / "in" / "b.bin")
    (tmp_path / "in" / "a.bin").write_bytes(b"123")
    assert names(r, two, r.latestOffset()) == ["a.bin"]


def test_missing_folder_is_empty(tmp_path):
    assert reader(tmp_path).latestOffset() == {"releases": 0}


def test_stream_reads_each_file_once_over_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def run():
        files = settled_files(spark, str(tmp_path / "in"), str(tmp_path / "log"), settle=0.2, per_batch=2)
        query = (
            files.select("path", "length", F.length("content").alias("bytes")).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema("path string, length long, bytes int").parquet(str(tmp_path / "out")).collect())

    want = []
    for k in range(5):
        (tmp_path / "in" / f"f{k}").write_bytes(b"x" * k)
        want.append((f"f{k}", k, k))
    seen = []
    for _ in range(4):
        seen = run()
    assert seen == want
    (tmp_path / "in" / "g").write_bytes(b"yy")
    run()
    assert run() == [*want, ("g", 2, 2)]


def batch(spark, keys, at=0):
    return spark.createDataFrame([(k, at) for k in keys], ROWS)


def stored(spark, store):
    return sorted(tuple(r) for r in manifest.read_store(spark, store, batch(spark, []).schema).collect())


def test_batches_are_stored_once(spark, tmp_path):
    store = str(tmp_path / "store")
    assert stored(spark, store) == []
    assert manifest.append_batch(batch(spark, ["a", "b", "b", None]), store, "r-0") == 2
    assert manifest.append_batch(batch(spark, ["zz"]), store, "r-0") == 0  # the key is done
    assert manifest.append_batch(batch(spark, ["b", "c"], 1), store, "r-1") == 1
    assert manifest.append_batch(batch(spark, []), store, "r-2") == 0
    assert [k for k, _ in stored(spark, store)] == ["a", "b", "c"]


def test_work_of_a_batch_does_not_grow_with_the_store(spark, tmp_path):
    store = str(tmp_path / "store")
    manifest.append_batch(batch(spark, [f"k{i}" for i in range(5000)]), store, "r-0", prefixes=64)
    some = batch(spark, ["k7", "new"], 1).withColumn("prefix", F.pmod(F.xxhash64("content_hash"), F.lit(64)).cast("int"))
    touched = [r["prefix"] for r in some.select("prefix").distinct().collect()]
    folders = manifest.live_folders(spark, store, touched)
    files = spark.read.parquet(*manifest._paths(store, folders)).inputFiles()
    assert len(manifest.live_folders(spark, store)) == 64 and len(folders) == len(touched) <= 2 and len(files) == len(folders)
    assert manifest.append_batch(batch(spark, ["k7", "new"], 1), store, "r-1", prefixes=64) == 1
    assert len(stored(spark, store)) == 5001


def test_a_batch_that_failed_half_way_is_not_read_and_is_replaced(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    manifest.append_batch(batch(spark, ["a"]), store, "r-0")
    commit = manifest._commit

    def fail(*_):
        raise RuntimeError("lost before the manifest")

    monkeypatch.setattr(manifest, "_commit", fail)
    with pytest.raises(RuntimeError):
        manifest.append_batch(batch(spark, ["b", "c"]), store, "r-1")
    assert [k for k, _ in stored(spark, store)] == ["a"]
    monkeypatch.setattr(manifest, "_commit", commit)
    assert manifest.append_batch(batch(spark, ["b", "c"]), store, "r-1") == 2
    assert [k for k, _ in stored(spark, store)] == ["a", "b", "c"]


def test_merged_folders_hold_the_same_rows(spark, tmp_path):
    store = str(tmp_path / "store")
    for k in range(5):
        manifest.append_batch(batch(spark, [f"x{j}" for j in range(3 * k, 3 * k + 4)], k), store, f"r-{k}", prefixes=2)
    before = stored(spark, store)
    assert manifest.merge_folders(spark, store, batch(spark, []).schema, most=3) == 2
    assert stored(spark, store) == before and len(manifest.live_folders(spark, store)) == 2
    assert manifest.append_batch(batch(spark, ["x3", "y"]), store, "r-9", prefixes=2) == 1
    assert len(stored(spark, store)) == len(before) + 1


def test_contents_over_several_runs_and_a_lost_checkpoint(spark, tmp_path):
    spark.createDataFrame([(f"c{i % 7}", i) for i in range(50)], ROWS).write.parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    for progress in ("one", "one", "two"):
        rows = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
        ingest.ingest_stream(rows, store, str(tmp_path / progress))
    assert [k for k, _ in stored(spark, store)] == [f"c{i}" for i in range(7)]
