"""Files as panels: CSV with declared types, folders of CSVs, JSON observations, audio; and the sinks."""

from __future__ import annotations

import csv
import io
import wave
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.clean import canonical

#: Names under which a value column is found, first match first.
VALUE_NAMES = ("y", "value", "values", "Value", "sales", "Close", "SUM TELEM DSR LOAD")
TIME_NAMES = ("ts", "ds", "date", "Date", "timestamp", "SCED Time Stamp")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; without a schema every column is text (types are never guessed)."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_series(spark: SparkSession, path: str, series_id: str = "series") -> DataFrame:
    """A CSV of one series as (series_id, ts, y), by the usual names of its columns."""
    df = read_csv(spark, path)
    pick = lambda names: next(c for n in names for c in df.columns if c.strip() == n)
    return canonical(df, f"`{pick(TIME_NAMES)}`", f"`{pick(VALUE_NAMES)}`").withColumn("series_id", F.lit(series_id))


def read_folder(spark: SparkSession, paths: list[str], source: str = "source_file") -> DataFrame:
    """CSVs, whose headers may differ, by name in one frame with the file each row comes from.

    All headers come from one scan of the files' first lines; files with one header are one scan, so a plan grows with the
    headers, not the files. Headers are single lines; a file without one has no rows.
    """
    first = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value").where("at = 0 and value <> ''")
    heads = first.groupBy("path").agg(F.first("value").alias("line")).groupBy("line").agg(F.collect_list("path").alias("paths")).collect()
    alike: dict[tuple[str, ...], list[str]] = {}
    for head in sorted(heads, key=lambda r: min(r["paths"])):
        alike.setdefault(tuple(next(csv.reader([head["line"].removeprefix("\ufeff")]))), []).extend(head["paths"])
    reader = spark.read.option("header", True)
    frames = [reader.schema(", ".join(f"`{c}` string" for c in cols)).csv(same).withColumn(source, F.col("_metadata.file_name")) for cols, same in alike.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Stored answers of an observations service ({"observations": [{"date", "value"}]}) as (series_id, ts, y); "." is missing."""
    schema = "series_id string, observations array<struct<date string, value string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.coalesce("series_id", F.lit("series")).alias("series_id"), F.inline("observations"))
    return canonical(rows, "date", "value", "series_id")


def read_wave(spark: SparkSession, path: str) -> DataFrame:
    """WAV files (8, 16, 24 or 32 bit) as (path, rate, samples) with samples from -1 to 1; several channels are averaged."""

    @F.pandas_udf("rate long, samples array<float>")
    def decode(content: pd.Series) -> pd.DataFrame:
        out = []
        for raw in content:
            with wave.open(io.BytesIO(raw)) as w:
                width, data = w.getsampwidth(), np.frombuffer(w.readframes(w.getnframes()), np.uint8)
                if width == 1:  # these have no sign
                    x = data.astype(np.float64) / 128 - 1
                else:  # little-endian numbers, moved to the top of 32 bits
                    wide = np.zeros((len(data) // width, 4), np.uint8)
                    wide[:, 4 - width :] = data.reshape(-1, width)
                    x = wide.view("<i4")[:, 0] / 2.0**31
                x = x.reshape(-1, w.getnchannels()).mean(axis=1)
                out.append((w.getframerate(), x.astype(np.float32)))
        return pd.DataFrame(out, columns=["rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", decode("content").alias("d")).select("path", "d.*")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, in folders by column where by is given, so that readers skip those they don't need."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def write_text(df: DataFrame, col: str, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(col).cast("string").alias("value")).write.mode(mode).text(path)


def save_model(model, path: str) -> None:
    """A fitted Spark ML model as a folder; as a pipeline of one stage where it is not one already."""
    from pyspark.ml import PipelineModel

    (model if isinstance(model, PipelineModel) else PipelineModel([model])).write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
