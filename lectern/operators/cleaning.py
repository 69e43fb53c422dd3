"""Cleaning and typing of raw tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import pseudonym


def add_audit_columns(df: DataFrame, dataset: str, source: Column | str | None = None) -> DataFrame:
    """_ingest_at, _ingest_date, _source_file, _source_dataset (P01); without a source the file that each row came from."""
    where = F.col("_metadata.file_path") if source is None else F.lit(source) if isinstance(source, str) else source
    return df.withColumns({"_ingest_at": F.current_timestamp(), "_ingest_date": F.current_date(), "_source_file": where, "_source_dataset": F.lit(dataset)})


def ensure_columns(df: DataFrame, columns: Iterable[str], kind: str = "string") -> DataFrame:
    """Columns that are missing, as typed NULLs."""
    return df.withColumns({c: F.lit(None).cast(kind) for c in columns if c not in df.columns})


def derive_date(df: DataFrame, source: str, target: str = "event_date", pattern: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """The date of a text timestamp; NULL where it doesn't parse."""
    return df.withColumn(target, F.to_date(F.try_to_timestamp(F.col(source), F.lit(pattern))))


def trim_strings(df: DataFrame) -> DataFrame:
    """Every string column trimmed, in one projection."""
    return df.select(*[F.trim(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def cast_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Named columns cast, text that doesn't parse becoming NULL."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast(k) for c, k in kinds.items() if c in df.columns})


def pseudonymise(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, pseudonym(F.col(column)))


def add_lineage(df: DataFrame, source_table: str) -> DataFrame:
    """_silver_at and _silver_source_table."""
    return df.withColumns({"_silver_at": F.current_timestamp(), "_silver_source_table": F.lit(source_table)})


def deduplicate(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One of each set of rows alike in keys, all columns but those starting with _ by default."""
    return df.dropDuplicates(keys or [c for c in df.columns if not c.startswith("_")])


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order (P09), as an aggregate that combines on the map side."""
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def until(df: DataFrame, column: str, cut: int) -> DataFrame:
    """Rows with a date not after the cut-off."""
    return df.where(F.col(column).isNotNull() & (F.col(column) <= cut))


def recent(df: DataFrame, column: str, cut: int, days: int = 7) -> DataFrame:
    """Rows of the half-open range (cut - days, cut]."""
    return df.where((F.col(column) > cut - days) & (F.col(column) <= cut))


def open_until(df: DataFrame, column: str, cut: int) -> DataFrame:
    """Rows without a date, or with one not after the cut-off."""
    return df.where(F.col(column).isNull() | (F.col(column) <= cut))


def fill_defaults(df: DataFrame, numbers: Iterable[str], labels: Iterable[str], unknown: str = "Unknown") -> DataFrame:
    """Numbers default to 0, labels to 'Unknown' (P17)."""
    return df.fillna({c: 0 for c in numbers if c in df.columns} | {c: unknown for c in labels if c in df.columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes NULL."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def pruned(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The named columns that exist, each once, in order."""
    return df.select(*[c for c in dict.fromkeys(columns) if c in df.columns])


INTEGERS = (
    "module_presentation_length", "id_assessment", "date", "num_of_prev_attempts", "studied_credits", "date_registration",
    "date_unregistration", "date_submitted", "is_banked", "id_site", "sum_click", "week_from", "week_to",
)
DOUBLES = ("weight", "score")


def to_silver(df: DataFrame, source_table: str, student: str = "id_student") -> DataFrame:
    """Trimmed, typed by column name, pseudonymised, deduplicated on its own columns, with lineage."""
    kinds = {c: "int" for c in INTEGERS} | {c: "double" for c in DOUBLES}
    typed = cast_columns(trim_strings(df), kinds)
    if student in typed.columns:
        typed = pseudonymise(typed, student)
    return add_lineage(deduplicate(typed), source_table)
