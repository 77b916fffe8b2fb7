"""Choosing the acquisition date of a city and year from a scene catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from greenspark.functions import geometry as G
from greenspark.operators.coverage import box_union_area

MAX_CLOUD = 15.0


def season_scenes(items: DataFrame, target: tuple, max_cloud: float = MAX_CLOUD) -> DataFrame:
    """Summer scenes under the cloud limit whose footprint meets the target box, clipped to it."""
    t = G.box(*[F.lit(float(v)) for v in target])
    clipped = G.box(F.greatest(F.col("box.xmin"), t["xmin"]), F.greatest(F.col("box.ymin"), t["ymin"]),
                    F.least(F.col("box.xmax"), t["xmax"]), F.least(F.col("box.ymax"), t["ymax"]))
    return (items.where((F.col("cloud") < max_cloud) & F.month("datetime").between(6, 8) & G.boxes_meet(F.col("box"), t))
            .select("id", F.to_date("datetime").alias("date"), F.year("datetime").alias("year"), "cloud", clipped.alias("box")))


def date_scores(items: DataFrame, target: tuple, max_cloud: float = MAX_CLOUD) -> DataFrame:
    """Per date: share of the target box covered by its scenes, mean cloud, and their score."""
    scenes = season_scenes(items, target, max_cloud)
    xmin, ymin, xmax, ymax = target
    covered = box_union_area(scenes.select("date", "box"), ["date"], "box", "m2")
    clouds = scenes.groupBy("date", "year").agg(F.avg("cloud").alias("avg_cloud"), F.count(F.lit(1)).alias("n_scenes"))
    return (clouds.join(covered, "date", "left")
            .withColumn("coverage", F.coalesce("m2", F.lit(0.0)) / float((xmax - xmin) * (ymax - ymin))).drop("m2")
            .withColumn("score", F.col("coverage") - F.col("avg_cloud") / 100))


def best_date(scores: DataFrame, year: int) -> DataFrame:
    """Best date of the year, else of the year before, else of the year after; ties go to the earlier date."""
    order = F.when(F.col("year") == year, 0).when(F.col("year") == year - 1, 1).when(F.col("year") == year + 1, 2)
    return (scores.withColumn("choice", order).where("choice is not null")
            .orderBy("choice", F.desc("score"), "date").limit(1))
