"""Faults that were mended: late rows of a stream, long contents, equal file names, clusters without a shared folder."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_io import write_wav

from seriesloom import session
from seriesloom.operators import dedup, keyframes
from seriesloom.sources import recordings
from seriesloom.streaming import ingest, stateful


def test_rows_out_of_order_are_settled_in_order(spark, tmp_path):
    rng = np.random.default_rng(1)
    z = rng.normal(0.2, 1, 12)
    waves = [[0, 1, 3, 4], [2, 7], [3, 6, 5], [11, 9], [8, 10]]
    for at, wave in enumerate(waves):
        rows = [("s", n, float(z[n]), False) for n in wave] + ([("s", 12, None, True)] if at == 4 else [])
        spark.createDataFrame(rows, "k string, n long, z double, closing boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.use_rocksdb(spark)
        stream = spark.readStream.schema("k string, n long, z double, closing boolean").parquet(f"{tmp_path}/in")
        got = stateful.run_available(stateful.cusum_stream(stream, ["k"], 1.0, slack=0.1), str(tmp_path / "run"))
    s = w = 0.0
    want = []
    for n, v in enumerate(z):
        s, w = max(0.0, s + v - 0.1), max(0.0, w + v)
        want.append((n, round(s, 9), round(w, 9)))
    assert sorted((r["n"], round(r["s"], 9), round(r["w"], 9)) for r in got.collect()) == want


def test_one_hash_for_a_content_of_any_length(spark):
    rows = spark.range(40).select(F.lit("s").alias("k"), F.col("id").alias("n"), (F.col("id") * 7 % 5).alias("v"))
    out = dedup.content_hash(rows, ["k"], F.col("v"), fan=2, depth=3).collect()
    level = [str(n * 7 % 5) for n in range(40)]
    for size in (2, 2, len(level)):
        level = [hashlib.sha256(",".join(level[a : a + size]).encode()).hexdigest() for a in range(0, len(level), size)]
    assert [r["content_hash"] for r in out] == level


def test_equal_names_in_two_folders_are_two_series(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        write_wav(tmp_path / name / "x.wav", np.full((10, 1), 5))
    rows = recordings.long_samples(recordings.read_recordings(spark, str(tmp_path)))
    assert {r[0]: r[1] for r in rows.groupBy("series_id").count().collect()} == {"a/x": 10, "b/x": 10}


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return Conf()

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session(), "x")


def test_leaky_sums_equal_the_recursion():
    steps = np.random.default_rng(2).normal(size=(2, 50))
    want, e = [], np.zeros(2)
    for m in range(50):
        e = 0.8 * e + steps[:, m]
        want.append(e)
    np.testing.assert_allclose(keyframes.leaky_sums(steps, 0.8), np.array(want).T, atol=1e-12)
