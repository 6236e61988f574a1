"""Sources and sinks."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.dims import ScoringConfig


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """A1: the named Parquet tables; late columns are merged in."""
    return {n: spark.read.option("mergeSchema", "true").parquet(f"{path}/{n}") for n in names}


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A1: tables with a scan_id are partitioned by it, one shuffle by the partition key before."""
    for name, df in tables.items():
        if "scan_id" in df.columns:
            df.repartition("scan_id").write.mode("overwrite").partitionBy("scan_id").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumn("_file", F.input_file_name())


def read_html_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A2: files <scan>/<page>/dom.html as scan_id, page_id, html."""
    parts = F.split("_file", "/")
    return _whole(spark, f"{path}/*/*/dom.html").select(F.element_at(parts, -3).alias("scan_id"), F.element_at(parts, -2).alias("page_id"), F.col("value").alias("html"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A3, A4: one JSON file a page, <page>.json, as page_id and body, to be parsed with a schema."""
    return _whole(spark, f"{path}/*.json").select(F.regexp_extract("_file", r"([^/]+)\.json$", 1).alias("page_id"), F.col("value").alias("body"))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Fetched sitemaps or robots files, <site>/<name>, as site, url and body."""
    parts = F.split("_file", "/")
    return _whole(spark, f"{path}/*/*").select(F.element_at(parts, -2).alias("site"), F.element_at(parts, -1).alias("url"), F.col("value").alias("body"))


def read_scoring_config(path: str) -> ScoringConfig:
    """Knobs of a YAML file over the defaults: impact_weights, level_weights, check_overrides, quality_checks, bands, categories."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    cfg = ScoringConfig()
    known = dict(cfg.knobs)
    for section in ("check_overrides", "quality_checks"):
        for rule, x in (raw.get(section) or {}).items():
            worst, most = known.get(rule, (6.0, 12.0))
            known[rule] = (float(x.get("worst_value", worst)), float(x.get("max_impact", most)))
    levels = {k: float(v) for k, v in (raw.get("level_weights") or cfg.level_weights).items() if k != "best-practice"}
    bands = [(int(b["max"]), b["label"]) for b in raw["bands"]] if raw.get("bands") else cfg.bands
    active = [k for k, v in raw["categories"].items() if v.get("active")] if raw.get("categories") else cfg.active
    return replace(cfg, impact_weights=raw.get("impact_weights") or cfg.impact_weights, level_weights=levels, knobs=known, bands=bands, active=active)


def read_policy_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON file (id, label, patterns), one row for each pattern that is not blank."""
    rows = spark.read.schema("id string, label string, patterns array<string>").json(path, multiLine=True)
    return rows.where("id IS NOT NULL").select(F.col("id").alias("rule"), "label", F.explode("patterns").alias("pattern")).where("trim(pattern) <> ''")


def read_calibration_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and a stated schema."""
    return spark.read.csv(path, header=True, schema=schema)


def write_report_json(findings: DataFrame, path: str, category: str) -> None:
    """A10: the findings of a category as JSON lines, a folder for each run."""
    findings.where(F.col("category") == category).write.mode("overwrite").partitionBy("scan_id").json(path)


def replace_run(df: DataFrame, path: str) -> None:
    """The runs that ``df`` holds replace their own partitions and no other."""
    df.repartition("scan_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(path)


def upsert_page(pages: DataFrame, issues: DataFrame, new_pages: DataFrame, new_issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages and findings with those of the new pages replaced, by (scan_id, url) and (scan_id, page_id)."""
    old = pages.join(new_pages.select("scan_id", "url"), ["scan_id", "url"], "left_semi").select("scan_id", "page_id")
    keep = pages.join(new_pages.select("scan_id", "url"), ["scan_id", "url"], "left_anti").unionByName(new_pages)
    return keep, issues.join(old, ["scan_id", "page_id"], "left_anti").unionByName(new_issues)
