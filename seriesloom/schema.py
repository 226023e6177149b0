"""Explicit schemas of the stored tables; nothing is inferred on read."""

from pyspark.sql import types as T

SAMPLES = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("channel", T.IntegerType(), False),
        T.StructField("chunk", T.IntegerType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("x", T.ArrayType(T.DoubleType()), False),
    ]
)
RECORDINGS = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("sr", T.IntegerType(), False),
        T.StructField("channels", T.IntegerType(), False),
        T.StructField("sample_bits", T.IntegerType(), False),
        T.StructField("frames", T.LongType(), False),
    ]
)
STATE = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("n", T.LongType(), False),
        T.StructField("a", T.DoubleType()),
        T.StructField("i", T.DoubleType()),
        T.StructField("chroma", T.ArrayType(T.DoubleType())),
        T.StructField("engagement", T.DoubleType()),
    ]
)
META = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("content_hash", T.StringType()),
        T.StructField("sr", T.IntegerType()),
        T.StructField("hop", T.IntegerType()),
        T.StructField("n_fft", T.IntegerType()),
        T.StructField("bpm", T.DoubleType()),
        T.StructField("bpm_confidence", T.DoubleType()),
        T.StructField("beats", T.IntegerType()),
        T.StructField("r0", T.DoubleType()),
        T.StructField("floor_db", T.DoubleType()),
        T.StructField(
            "force_weighting",
            T.StructType([T.StructField("w_amp", T.DoubleType()), T.StructField("w_int", T.DoubleType())]),
        ),
        T.StructField("caveats", T.ArrayType(T.StringType())),
    ]
)
LEDGER = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("song_id", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("record_file", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("bpm", T.DoubleType()),
        T.StructField("n_frames", T.LongType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("prev_hash", T.StringType()),
        T.StructField("block_hash", T.StringType()),
    ]
)
SNAPSHOTS = T.StructType(
    [
        T.StructField("machine_id", T.StringType(), False),
        T.StructField("snap", T.IntegerType(), False),
        T.StructField("t_h", T.DoubleType()),
        T.StructField("sr", T.DoubleType()),
        T.StructField("x", T.ArrayType(T.IntegerType())),
    ]
)
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
