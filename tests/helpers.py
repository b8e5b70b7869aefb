from datetime import datetime, timezone

SECOND = 1_000_000


def us(text: str) -> int:
    return round(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1e6)


def events(spark, rows):
    """rows: (uid, session_id, seconds, op); the index is the position in the list."""
    data = [(i, u, s, round(t * SECOND), o) for i, (u, s, t, o) in enumerate(rows)]
    return spark.createDataFrame(data, "idx bigint, uid string, session_id string, ts_us bigint, op string")


def column(df, name, key="idx"):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r[key])]
