"""Retention: an age limit and budgets by class."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.operators.items import is_secondary

DAYS, PRIMARY, SECONDARY, VIDEOS = 90, 4000, 700, 500


def bounded(name: str, usual: int, least: int, most: int) -> int:
    """A whole number from the environment, within bounds."""
    raw = os.environ.get(name, "").strip()
    if not raw:
        return usual
    if not raw.isdigit() or not least <= int(raw) <= most:
        raise ValueError(f"{name} must be a whole number from {least} to {most}")
    return int(raw)


@dataclass(frozen=True)
class Budgets:
    days: int = DAYS
    primary: int = PRIMARY
    secondary: int = SECONDARY
    videos: int = VIDEOS


def within(published: Column | str, now: Column, days: int) -> Column:
    """Published no more than `days` before now, to the day's last moment; no date, no."""
    p = F.try_to_timestamp((F.col(published) if isinstance(published, str) else published).cast("string"))
    return F.coalesce(p >= now - F.make_dt_interval(F.lit(days)), F.lit(False))


def is_primary_editorial() -> Column:
    return (F.col("sourceType") == "official") | ~is_secondary()


def item_class() -> Column:
    return F.when(F.col("sourceType") == "youtube", "video").when(is_primary_editorial(), "primary").otherwise("secondary")


def retain(items: DataFrame, now: Column, budgets: Budgets, order: list[Column]) -> DataFrame:
    """Items within the age limit, the first of each class in `order` up to its budget.

    The rank is over three classes; Spark cuts each task's rows to the largest budget
    before they meet, so a class's window is bounded by budgets and not by the input.
    """
    most = max(budgets.primary, budgets.secondary, budgets.videos)
    aged = items.where(within("publishedAt", now, budgets.days)).withColumn("_class", item_class())
    ranked = aged.withColumn("_rank", F.row_number().over(Window.partitionBy("_class").orderBy(*order))).where(F.col("_rank") <= most)
    budget = F.when(F.col("_class") == "video", budgets.videos).when(F.col("_class") == "primary", budgets.primary).otherwise(budgets.secondary)
    return ranked.where(F.col("_rank") <= budget).drop("_class", "_rank")
