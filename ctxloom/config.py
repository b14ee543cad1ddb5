"""Planner parameters as data: one frozen object for scalars, small frames for tables."""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ctxloom.functions import patterns as P


@dataclass(frozen=True)
class Pressure:
    soft_gc: float = 0.55
    cold_compact: float = 0.68
    warm_compact: float = 0.78
    aggressive: float = 0.88
    emergency: float = 0.94
    safety_ratio: float = 0.04


@dataclass(frozen=True)
class Recent:
    ratio: float = 0.06
    min_tokens: int = 2048
    max_tokens: int = 12288
    bypass_x: float = 0.80


@dataclass(frozen=True)
class Scoring:
    x_penalty: float = 0.22
    duplicate_penalty: float = 0.18
    hot_enter: float = 0.82
    hot_leave: float = 0.70
    warm_enter: float = 0.58
    warm_leave: float = 0.48
    trash_enter: float = 0.28


@dataclass(frozen=True)
class Compaction:
    min_ratio: float = 0.03
    min_tokens: int = 2048
    max_tokens: int = 65536


@dataclass(frozen=True)
class Config:
    pressure: Pressure = Pressure()
    recent: Recent = Recent()
    scoring: Scoring = Scoring()
    compaction: Compaction = Compaction()
    units_shown: int = 400
    strict_parity: bool = False


def merged(config: Config, patch: dict) -> Config:
    """``config`` with a nested patch over it; unknown keys are refused."""
    known = {f.name for f in fields(config)}
    if unknown := set(patch) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(config, **{k: merged(getattr(config, k), v) if is_dataclass(getattr(config, k)) else v for k, v in patch.items()})


def content_types(spark: SparkSession) -> DataFrame:
    """23 rows: content_type, intrinsic, tau (null: never decays), x."""
    rows = [(k, a, None if t is None else float(t), x) for k, (a, t, x) in P.CONTENT_TYPES.items()]
    return spark.createDataFrame(rows, "content_type string, intrinsic double, tau double, x double")


def zone_tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(z, t) for z, tiers in P.ZONE_TIERS.items() for t in tiers], "zone string, tier string")
