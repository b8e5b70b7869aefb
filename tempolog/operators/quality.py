"""Data-quality checks. Each returns every violation, as ``rule, row_key, column_name, value``.

:func:`require_clean` turns any of them into the strict form that fails on the first offence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tempolog.functions.scalars import has_zone, is_iso, is_utc, parse_time
from tempolog.plans.joins import lookup
from tempolog.plans.timeline import timeline
from tempolog.schema import CONTRACT_COLUMNS, UNKNOWN_OPS


class ContractError(ValueError):
    """A table does not meet the contract."""


def require_clean(violations: DataFrame) -> None:
    """Raise with one example if there is any violation."""
    first = violations.first()
    if first is not None:
        raise ContractError(f"{first['rule']}: row {first['row_key']}, column {first['column_name']}, value {first['value']!r}")


def _violations(df: DataFrame, key: str, checks: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """One scan for any number of checks; a row yields one violation per failed check.

    The list of a row is made once, in a projection below the outer explode: an inner one adds a filter that makes
    it again, and a filter function over the list keeps it out of generated code.
    """
    kind = "array<struct<rule:string,column_name:string,value:string>>"
    found = F.concat(*[
        F.when(failed, F.array(F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column_name"), F.col(column).cast("string").alias("value"))))
        .otherwise(F.array()).cast(kind)
        for rule, column, failed in checks
    ])
    return (
        df.select(F.col(key).cast("string").alias("row_key"), found.alias("found"))
        .select("row_key", F.explode_outer("found").alias("v")).where(F.col("v").isNotNull())
        .select("v.rule", "row_key", "v.column_name", "v.value")
    )


Rules = list[tuple[str, str, Column]]


def check(table: DataFrame, key: str, *rules: Rules) -> DataFrame:
    """The violations of any number of rule lists (``*_rules`` below) in one scan of the table."""
    return _violations(table, key, [r for some in rules for r in some])


def _empty(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column).cast("string") == "")


# --- mapping and normalisation ----------------------------------------------------------------------------------

def check_mapping(mapping: Mapping[str, str], columns: Sequence[str]) -> None:
    """The mapping is from contract columns to source columns; all but ``ip`` are needed."""
    unknown = sorted(set(mapping) - set(CONTRACT_COLUMNS))
    if unknown:
        raise ContractError(f"UNKNOWN_MAPPING_KEY: {unknown}")
    if any(not isinstance(v, str) for v in mapping.values()):
        raise ContractError("INVALID_MAPPING_VALUE: source columns must be names")
    missing = sorted(set(CONTRACT_COLUMNS) - set(mapping) - {"ip"})
    if missing:
        raise ContractError(f"MISSING_MAPPING: {missing}")
    absent = sorted(set(mapping.values()) - set(columns))
    if absent:
        raise ContractError(f"MISSING_INPUT_COLUMNS: {absent}")


def map_columns(raw: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Rename source columns to the contract, as text; a contract column without a source is empty."""
    check_mapping(mapping, raw.columns)
    columns = [
        (F.coalesce(F.col(mapping[c]).cast("string"), F.lit("")) if c in mapping else F.lit("")).alias(c)
        for c in CONTRACT_COLUMNS
    ]
    return raw.select(*columns, *keep)


def normalize_contract(mapped: DataFrame) -> DataFrame:
    """Parse the time of a mapped table; times that cannot be read become null (see :func:`check_timestamps`)."""
    return mapped.withColumn("timestamp_utc", parse_time("timestamp_utc"))


def required_rules() -> Rules:
    """Empty required values; an absent ``ip`` is accepted on input."""
    return [("MISSING_REQUIRED_VALUE", c, _empty(c)) for c in CONTRACT_COLUMNS if c != "ip"]


def check_required(mapped: DataFrame, key: str) -> DataFrame:
    return check(mapped, key, required_rules())


def timestamp_rules(column: str = "timestamp_utc") -> Rules:
    """Times that are neither an epoch nor ISO 8601 with a zone."""
    return [("INVALID_TIMESTAMP", column, ~_empty(column) & parse_time(column).isNull())]


def check_timestamps(mapped: DataFrame, key: str, column: str = "timestamp_utc") -> DataFrame:
    return check(mapped, key, timestamp_rules(column))


def contract_row_rules(require_ip: bool = True, corrupt: str | None = None) -> Rules:
    """Full check of a contract table held as text: nothing empty, time is ISO in UTC, no surplus cells.

    ``corrupt`` names the corrupt-record column of a permissive CSV read.
    """
    t = F.col("timestamp_utc")
    checks = [("EMPTY_VALUE", c, _empty(c)) for c in CONTRACT_COLUMNS if c != "ip" or require_ip]
    checks += [
        ("NOT_ISO8601", "timestamp_utc", ~_empty("timestamp_utc") & ~is_iso(t)),
        ("NO_UTC_OFFSET", "timestamp_utc", is_iso(t) & ~has_zone(t)),
        ("NOT_UTC", "timestamp_utc", is_iso(t) & has_zone(t) & ~is_utc(t)),
    ]
    if corrupt is not None:
        checks.append(("EXTRA_OR_MISSING_CELLS", corrupt, F.col(corrupt).isNotNull()))
    return checks


def check_contract_rows(table: DataFrame, key: str, require_ip: bool = True, corrupt: str | None = None) -> DataFrame:
    return check(table, key, contract_row_rules(require_ip, corrupt))


def utc_rules(column: str = "timestamp_utc") -> Rules:
    """Times without a zone or with an offset other than zero (epochs are not accepted here)."""
    t = F.col(column)
    return [
        ("NOT_ISO8601", column, t.isNull() | ~is_iso(F.trim(t))),
        ("NAIVE_TIME", column, is_iso(F.trim(t)) & ~has_zone(F.trim(t))),
        ("NOT_UTC", column, has_zone(F.trim(t)) & ~is_utc(F.trim(t))),
    ]


def check_utc(table: DataFrame, key: str, column: str = "timestamp_utc") -> DataFrame:
    return check(table, key, utc_rules(column))


# --- values -------------------------------------------------------------------------------------------------------

def is_unknown_op(op: Column) -> Column:
    return F.lower(F.trim(op)).isin(*UNKNOWN_OPS)


def known_op_rules(column: str = "op") -> Rules:
    return [("UNKNOWN_OP", column, is_unknown_op(F.col(column)))]


def check_known_ops(table: DataFrame, key: str, column: str = "op") -> DataFrame:
    return check(table, key, known_op_rules(column))


def _number(column: str) -> Column:
    return F.trim(F.col(column).cast("string")).try_cast("double")


def _infinite(x: Column) -> Column:
    return F.abs(x) == float("inf")


def positive_delta_rules(column: str) -> Rules:
    """Waiting times that are not numbers, not finite, or not above zero."""
    x = _number(column)
    finite = x.isNotNull() & ~F.isnan(x) & ~_infinite(x)
    return [
        ("DELTA_NOT_NUMERIC", column, x.isNull()),
        ("DELTA_NOT_FINITE", column, x.isNotNull() & ~finite),
        ("DELTA_NOT_POSITIVE", column, finite & (x <= 0)),
    ]


def check_positive_delta(table: DataFrame, key: str, column: str) -> DataFrame:
    return check(table, key, positive_delta_rules(column))


def finite_signal_rules(columns: Sequence[str] = ("S", "s_time", "flag_dt")) -> Rules:
    checks = []
    for c in columns:
        x, text = _number(c), F.trim(F.col(c).cast("string"))
        present = text.isNotNull() & (text != "")
        checks += [
            ("SIGNAL_MISSING", c, ~present | text.isNull()),
            ("SIGNAL_NOT_NUMERIC", c, present & x.isNull()),
            ("SIGNAL_NAN", c, F.isnan(x)),
            ("SIGNAL_INFINITE", c, _infinite(x)),
        ]
    return checks


def check_finite_signal(table: DataFrame, key: str, columns: Sequence[str] = ("S", "s_time", "flag_dt")) -> DataFrame:
    return check(table, key, finite_signal_rules(columns))


def check_increasing_time(table: DataFrame, keys: Sequence[str], order: str, ts_us: str = "ts_us") -> DataFrame:
    """Rows whose time is not after that of the row before, in the order of arrival ``order``."""
    line = timeline(table, keys, [order]).previous(_before=ts_us)
    return _violations(line.rows, order, [("TIME_NOT_INCREASING", ts_us, F.col("_before").isNotNull() & (F.col(ts_us) <= F.col("_before")))])


def check_known_vocab(table: DataFrame, key: str, vocab: DataFrame, column: str = "op", *rules: Rules) -> DataFrame:
    """Operations outside the (stored) fitted vocabulary; further rule lists are checked in the same scan."""
    known = vocab.select(F.col("op").alias(column)).distinct().withColumn("_known", F.lit(True))
    return check(lookup(table, known, [column]), key, [("UNKNOWN_CATEGORY", column, F.col("_known").isNull())], *rules)
