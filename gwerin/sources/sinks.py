"""Sinks: partitioned tables, quoted CSV, exports of present columns and small JSON state."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT = ["video_title", "video_url", "source", "channel_register", "timestamp_span", "trigger_word", "rule", "following_word", "lemma", "expected_mutation", "mutation_found", "status", "is_erosion", "is_high_confidence_erosion", "is_code_switch", "tagger_agreement", "confidence_score", "detection_source", "register_class", "collision_flag", "manual_reviewed", "review_count"]


def utterance_export(df: DataFrame) -> DataFrame:
    """The export's columns, as far as there are any, all rows."""
    return df.select([c for c in EXPORT if c in df.columns])


def write_runs(df: DataFrame, path: str, stamp: str = "stamp", slug: str = "slug") -> None:
    """Append a run's rows by stamp and slug; writing a run again replaces only its own partitions."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(stamp, slug).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """All fields quoted, header in each part; never onto an input."""
    df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def ensure_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The frame with typed null columns for those that it lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in schema.items() if c not in df.columns}) if set(schema) - set(df.columns) else df


def missing_columns(df: DataFrame, expected: list[str]) -> list[str]:
    return [c for c in expected if c not in df.columns]


def write_state(path: str, state: object) -> None:
    """Small JSON state, whole or not at all: written beside and renamed."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(state, f, ensure_ascii=False, indent=1)
    os.replace(part, path)


def read_state(path: str, empty: object) -> object:
    """The state, or ``empty`` if the file is missing, broken or of another type."""
    try:
        with open(path, encoding="utf-8") as f:
            state = json.load(f)
    except (OSError, ValueError):
        return empty
    return state if isinstance(state, type(empty)) else empty


def write_outputs(frames: dict[str, DataFrame], path: str) -> list[str]:
    """Each frame that has rows as CSV below the folder; the names written."""
    done = []
    for name, df in frames.items():
        if not df.isEmpty():
            write_csv(df, f"{path}/{name}")
            done.append(name)
    return done


def write_version(df: DataFrame, path: str) -> int:
    """The frame as the next version of a table, v=1, v=2, ...; earlier ones stay as they are, the first being the backup. Its number is returned."""
    spark = df.sparkSession
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = files.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    number = max([int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()], default=0) + 1
    df.write.parquet(f"{path}/v={number}")
    return number
