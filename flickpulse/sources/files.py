"""Readers for delimited files, JSON documents and stored HTML pages, and publishing sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flickpulse.operators import scale


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return scale.shared_root(spark) + "/run-" + uuid.uuid4().hex


def read_csv_mapped(spark: SparkSession, path: str, columns: dict[str, str], sep: str = ",") -> DataFrame:
    """CSV/TSV (also .gz) with a header: ``{source column: target column}``; other columns are not read."""
    df = spark.read.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return df.select(*[F.col(f"`{s}`").alias(t) for s, t in columns.items() if s in df.columns])


def json_fields(df: DataFrame, json_column: str, paths: dict[str, str]) -> DataFrame:
    """Columns by dot path out of a JSON text column; list positions as ``a[0].b``."""
    return df.select("*", *[F.get_json_object(json_column, "$." + p).alias(n) for n, p in paths.items()])


def read_json_mapped(spark: SparkSession, path: str, paths: dict[str, str], whole: bool = False) -> DataFrame:
    """JSON lines (or one document per file with ``whole``) to columns by dot path."""
    return json_fields(spark.read.text(path, wholetext=whole), "value", paths).select(*paths)


def html_fields(pages: DataFrame, selectors: dict[str, str], html: str = "html") -> DataFrame:
    """``{field: selector}`` with selectors ``tag``, ``tag.class`` or ``.class``: text of the first match."""
    out = pages
    for field, selector in selectors.items():
        tag, _, cls = selector.partition(".")
        tag = tag or r"[a-zA-Z][a-zA-Z0-9]*"
        attr = rf'[^>]*\bclass="(?:[^"]*\s)?{cls}(?:\s[^"]*)?"' if cls else ""
        inner = F.regexp_extract(html, rf"(?is)<({tag})\b{attr}[^>]*>(.*?)</\1\s*>", 2)
        text = F.trim(F.regexp_replace(F.regexp_replace(inner, r"(?s)<[^>]*>", " "), r"\s+", " "))
        out = out.withColumn(field, F.when(text != "", text))
    return out


# ---- sinks ---------------------------------------------------------------------------------------------------------
def append_checked(df: DataFrame, path: str) -> None:
    """Append rows after checking that the stored columns and types are the same."""
    if _exists(df.sparkSession, path):
        have = [(f.name, f.dataType) for f in df.sparkSession.read.parquet(path).schema]
        if have != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError(f"schema of {path} differs: {have}")
    df.write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key; running it twice gives the same rows. ``new`` must be unique by key."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def fill_nulls(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Fill only the cells of ``columns`` that are null in the target."""
    s = source.select(*keys, *[F.col(c).alias("new_" + c) for c in columns])
    return target.join(s, keys, "left").select(
        *[F.coalesce(F.col(c), F.col("new_" + c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _versions(spark: SparkSession, path: str, done: bool) -> list[int]:
    fs, p = _fs(spark, path + ("/v=*/_SUCCESS" if done else "/v=*"))
    found = fs.globStatus(p) or []
    names = [(s.getPath().getParent() if done else s.getPath()).getName() for s in found]
    return sorted(int(n[2:]) for n in names)


def publish(df: DataFrame, path: str) -> None:
    """Replace a table as a whole: a new numbered version that readers see only once it is complete."""
    taken = _versions(df.sparkSession, path, done=False)
    df.write.parquet(f"{path}/v={(taken[-1] + 1 if taken else 1):08d}")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v={_versions(spark, path, done=True)[-1]:08d}")


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """One row of metrics per run."""
    df.withColumn("run_id", F.lit(run_id)).withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)


def log_fetches(rows: DataFrame, path: str) -> None:
    """Append fetch results (source, status, payload) with the time."""
    rows.withColumn("fetched_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path + "/csv")
    df.write.mode("overwrite").json(path + "/json")
