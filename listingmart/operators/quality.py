"""Quality metrics, the gate, and the run log."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.location import blank_to_null
from ..functions.text import strip
from ..schemas import RUN_LOG
from ..sources.tables import Warehouse


class QualityGateError(ValueError):
    """Metrics beyond the thresholds."""


@dataclass(frozen=True)
class Thresholds:
    """The defaults."""

    max_null_price_ratio: float = 0.10
    max_invalid_price_ratio: float = 0.02
    max_null_area_ratio: float = 0.35
    max_invalid_area_ratio: float = 0.01
    max_duplicate_detail_url_ratio: float = 0.01
    min_fact_row_ratio: float = 0.60


def duplicate_url_rows(staging: DataFrame) -> DataFrame:
    """Rows in groups of equal non-blank URLs, all members counted."""
    urls = staging.select(blank_to_null(strip(F.col("detail_url"))).alias("u")).filter("u is not null")
    return urls.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_non_empty_detail_url_rows")
    )


def metrics_frame(staging: DataFrame, fact: DataFrame) -> DataFrame:
    """One row of counts and ratios."""
    price, area = F.col("price_million_vnd"), F.col("area_m2")
    counts = staging.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(price.isNull()).alias("null_price_count"),
        F.count_if(price <= 0).alias("invalid_price_count"),
        F.count_if(area.isNull()).alias("null_area_count"), F.count_if(area <= 0).alias("invalid_area_count"))
    out = counts.crossJoin(duplicate_url_rows(staging)).crossJoin(fact.agg(F.count(F.lit(1)).alias("fact_rows")))
    ratio = lambda n: F.when(F.col("total_rows") > 0, F.col(n) / F.col("total_rows")).otherwise(0.0)
    names = {
        "null_price": "null_price_count", "invalid_price": "invalid_price_count", "null_area": "null_area_count",
        "invalid_area": "invalid_area_count", "duplicate_non_empty_detail_url": "duplicate_non_empty_detail_url_rows", "fact_row": "fact_rows"
    }
    return out.withColumns({f"{k}_ratio": ratio(v) for k, v in names.items()})


def metrics(staging: DataFrame, fact: DataFrame) -> dict:
    return metrics_frame(staging, fact).first().asDict()


def violations(found: dict, limits: Thresholds) -> list[str]:
    """Strict comparisons: a ratio at its threshold passes."""
    upper = {
        "null_price_ratio": limits.max_null_price_ratio, "invalid_price_ratio": limits.max_invalid_price_ratio,
        "null_area_ratio": limits.max_null_area_ratio, "invalid_area_ratio": limits.max_invalid_area_ratio,
        "duplicate_non_empty_detail_url_ratio": limits.max_duplicate_detail_url_ratio
    }
    out = [f"{k}={found[k]:.4f} > {most:.4f}" for k, most in upper.items() if found[k] > most]
    if found["fact_row_ratio"] < limits.min_fact_row_ratio:
        out.append(f"fact_row_ratio={found['fact_row_ratio']:.4f} < {limits.min_fact_row_ratio:.4f}")
    return out


def enforce(found: dict, limits: Thresholds | None = None) -> None:
    if bad := violations(found, limits or Thresholds()):
        raise QualityGateError("quality gate failed: " + "; ".join(bad))


class RunLog:
    """Append-only: a `running` row, then a closing row; latest() shows each run's last state."""

    TABLE = "etl_run_log"

    def __init__(self, warehouse: Warehouse):
        self.warehouse = warehouse

    def _add(self, **row) -> None:
        spark = self.warehouse.spark
        full = {f.name: None for f in RUN_LOG} | row
        self.warehouse.append(spark.createDataFrame([tuple(full[f.name] for f in RUN_LOG)], RUN_LOG), self.TABLE)

    def start(self, pipeline: str, limits: Thresholds) -> dict:
        run = {
            "run_id": time.time_ns() // 1000 * 1000 + uuid.uuid4().int % 1000, "pipeline_name": pipeline,
            "started_at": datetime.now(UTC).replace(tzinfo=None), "thresholds": json.dumps(asdict(limits), sort_keys=True)
        }
        self._add(**run, status="running", sequence=0)
        return run

    def finish(self, run: dict, status: str, counts: dict | None = None, found: dict | None = None, error: str | None = None) -> None:
        self._add(
            **run, status=status, finished_at=datetime.now(UTC).replace(tzinfo=None), error_message=error,
            quality_metrics=json.dumps(found, sort_keys=True) if found else None, sequence=1, **(counts or {})
        )

    def latest(self) -> DataFrame:
        return latest_runs(self.warehouse.read(self.TABLE))


def latest_runs(log: DataFrame) -> DataFrame:
    last = Window.partitionBy("run_id").orderBy(F.desc("sequence"))
    return log.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "sequence")
