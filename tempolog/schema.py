"""Table layouts and fixed constants."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and order of the stage tables.
CONTRACT_COLUMNS = ("timestamp_utc", "uid", "session_id", "method", "path", "referer", "user_agent", "ip", "op_category")
SESSION_COLUMNS = CONTRACT_COLUMNS + ("delta_t_seconds", "log_delta_t")
DELTIFIED_COLUMNS = SESSION_COLUMNS + (
    "robust_z", "robust_z_clipped", "prev_q25_seconds", "prev_q75_seconds", "burst_ratio")
SCORED_COLUMNS = (
    "timestamp_utc", "uid", "session_id", "op_category", "z", "z_hat", "s_cls", "s_time", "S", "flag_cls", "flag_dt")

# Constants of the method.
GAP_EPSILON = 1e-3        # seconds, inside ln() for gaps and features
FIT_EPSILON = 1e-9        # seconds, inside ln() for the timing model; also the floor of sigma
SCALE_FLOOR = 1e-8        # smallest divisor of the model's z
MAD_SCALE = 1.4826
CLIP = 5.0
MIN_USER_ROWS = 5         # fewer rows than this: global statistics
HISTORY = 5               # earlier gaps seen by the rolling quartiles
MIN_BINS, MAX_BINS = 32, 256
OTSU_MAX_RATIO = 0.9
DEFAULT_THRESHOLD_SECONDS = 3600.0
UNKNOWN_OPS = ("__unknown__", "__unk__", "unknown", "unk")
PROTECTED_OPS = ("UPDATE", "DELETE")


def _fields(names, doubles=(), ints=()):
    kinds = {"timestamp_utc": T.TimestampType(), **{n: T.DoubleType() for n in doubles}, **{n: T.IntegerType() for n in ints}}
    return T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])


CONTRACT_SCHEMA = _fields(CONTRACT_COLUMNS)
SESSION_SCHEMA = _fields(SESSION_COLUMNS, doubles=SESSION_COLUMNS[9:])
DELTIFIED_SCHEMA = _fields(DELTIFIED_COLUMNS, doubles=DELTIFIED_COLUMNS[9:])
SCORED_SCHEMA = _fields(SCORED_COLUMNS, doubles=("z", "z_hat", "s_cls", "s_time", "S"), ints=("flag_cls", "flag_dt"))
