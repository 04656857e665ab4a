"""Re-ranking by profiles, explanations, search and captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions.rounding import go_round
from ..functions.scalars import PROFILES, caption_verdict, clamp01, softmax


def signals(motion: Column, objects: Column, proximity: Column, observability: Column) -> dict[str, Column]:
    """The signals that profiles weigh, each cut to 0..1."""
    q = clamp01(observability)
    return {"motion_score": clamp01(motion), "object_score": clamp01(objects), "person_proximity": clamp01(proximity), "camera_quality": q, "inverse_q_observability": 1 - q}


def profile_scores(events: DataFrame, named: dict[str, Column], profiles: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """One row per event and profile, with the weighted sum of the profile's signals."""
    scores = [F.struct(F.lit(p).alias("profile"), go_round(sum((named[s] * w for s, w in weights.items()), F.lit(0.0)), 4).alias("score")) for p, weights in (profiles or PROFILES).items()]
    return events.select("*", F.inline(F.array(*scores)))


def ranked(scored: DataFrame, keys: list[str], index: str) -> DataFrame:
    """The place of each row by falling score within its keys; ties keep their order."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), index)))


def explanations(claims: DataFrame, kind: Column) -> DataFrame:
    """Claims with how they are grounded; those that point at nothing are dropped."""
    return claims.withColumn("grounding", kind).where(F.col("grounding").isNotNull()).fillna({"uncertainty": "unavailable"})


def found(findings: DataFrame, columns: list[str], text: str, **facets: str) -> DataFrame:
    """Findings with the text in any of the columns, upper and lower case alike, and the given facets."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower()))
    for k, v in facets.items():
        hit = hit & (F.col(k) == v)
    return findings.where(hit)


#: Captions that go to every row; a longer list is refused.
MOST_CAPTIONS = 1000


def zero_shot(images: DataFrame, captions: DataFrame, scale: float = 10.0, innocent: list[str] | None = None) -> DataFrame:
    """(image_id, top_label, top_score, margin, verdict): cosine with each caption, softmax, best two.

    ``captions`` (label, vector) has ``MOST_CAPTIONS`` rows at most; they are read by the driver and become
    a literal of the plan, so each image is judged in its own row and nothing is shuffled.
    """
    few = captions.select("label", F.col("vector").cast("array<double>").alias("vector")).limit(MOST_CAPTIONS + 1).collect()
    if len(few) > MOST_CAPTIONS:
        raise ValueError(f"more than {MOST_CAPTIONS} captions")
    label = captions.schema["label"].dataType
    spark = images.sparkSession
    bag = spark.createDataFrame([(sorted((r["label"], r["vector"]) for r in few),)], StructType().add("bag", ArrayType(StructType().add("label", label).add("caption", ArrayType(DoubleType())))))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    own = F.transform(F.col("vector"), lambda x: x.cast("double"))
    cos = lambda c: F.coalesce(F.try_divide(dot(own, c), F.sqrt(dot(own, own) * dot(c, c))), F.lit(0.0))
    scored = images.join(F.broadcast(bag)).select("image_id", "bag", F.transform("bag", lambda c: cos(c["caption"]) * scale).alias("scores"))
    p = softmax(F.col("scores"))
    both = F.slice(F.reverse(F.array_sort(F.zip_with(p, F.col("bag"), lambda s, c: F.struct(s.alias("p"), c["label"].alias("label"))))), 1, 2)
    out = scored.select("image_id", both.alias("b")).select("image_id", F.col("b")[0]["label"].alias("top_label"), F.col("b")[0]["p"].alias("top_score"), (F.col("b")[0]["p"] - F.coalesce(F.get("b", F.lit(1))["p"], F.lit(0.0))).alias("margin"))
    return out.withColumn("verdict", caption_verdict(F.col("top_label").cast("string"), F.col("top_score"), F.col("margin"), innocent or []))


def visible_to(children: DataFrame, parents: DataFrame, owner: Column, keys: list[str]) -> DataFrame:
    """Rows whose parent the owner may see: a semi-join, so nothing of the parent leaks."""
    return children.join(parents.where(owner).select(*keys), keys, "left_semi")
