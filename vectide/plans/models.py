"""The models a deployment may name. Their weights are not part of this repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Model names; image sizes of those that take images, dimensions of the text models.
CLIP = (
    ("RN50_OPENAI", 224),
    ("RN50_YFCC15M", 224),
    ("RN50_CC12M", 224),
    ("RN101_OPENAI", 224),
    ("RN101_YFCC15M", 224),
    ("RN50X4_OPENAI", 288),
    ("RN50X16_OPENAI", 384),
    ("RN50X64_OPENAI", 448),
    ("VIT_B_32_OPENAI", 224),
    ("VIT_B_32_LAION2B_E16", 224),
    ("VIT_B_32_LAION400M_E31", 224),
    ("VIT_B_32_LAION400m_E32", 224),
    ("VIT_B_32_LAION2B_S34B_B79K", 224),
    ("VIT_B_16_OPENAI", 224),
    ("VIT_B_16_LAION400M_E31", 224),
    ("VIT_B_16_LAION400M_E32", 224),
    ("VIT_B_16_PLUS_240_LAION400M_E31", 240),
    ("VIT_B_16_PLUS_240_LAION400M_E32", 240),
    ("VIT_L_14_OPENAI", 224),
    ("VIT_L_14_LAION400M_E31", 224),
    ("VIT_L_14_LAION2B_S32B_B82K", 224),
    ("VIT_L_14_336_OPENAI", 336),
    ("VIT_H_14_LAION2B_S32B_B79K", 224),
    ("VIT_G_14_LAION2B_S12B_B42K", 224),
)
INSTRUCTOR = (("INSTRUCTOR_LARGE", 768), ("INSTRUCTOR_BASE", 768), ("INSTRUCTOR_XL", 768))
E5 = (("E5_LARGE", 1024), ("E5_BASE", 768), ("E5_SMALL", 384))
HASHING = (("md5-64", 64),)


def rows() -> list[tuple[str, str, int | None, int | None]]:
    """model_class, model_name, and image_size or dims."""
    out: list[tuple[str, str, int | None, int | None]] = [("clip", n, s, None) for n, s in CLIP]
    for kind, models in (("instructor", INSTRUCTOR), ("e5", E5), ("hashing", HASHING)):
        out += [(kind, n, None, d) for n, d in models]
    return out


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "model_class string, model_name string, image_size int, dims int")
