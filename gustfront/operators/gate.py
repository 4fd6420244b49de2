"""Model gate: manifest completeness, transform version and content fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustfront.constants import TRANSFORM_VERSION


def model_gate(models: DataFrame, manifests: DataFrame, key: str, version: str = TRANSFORM_VERSION) -> DataFrame:
    """First failed check per model, or 'ok'.

    ``models(key, content)`` as read by the binary-file source; ``manifests`` carry the required keys
    and an optional ``override`` digest that wins over the manifest's own.
    """
    joined = models.select(key, F.sha2("content", 256).alias("actual")).join(manifests, key, "left")
    missing = F.col("model_sha256").isNull() | F.col("preprocess_version").isNull() | F.col("threshold_recommended").isNull()
    expected = F.coalesce(F.nullif(F.trim("override"), F.lit("")), F.col("model_sha256"))
    gate = (
        F.when(missing, "missing key").when(F.col("preprocess_version") != version, "version mismatch").when(F.col("actual") != expected, "fingerprint mismatch").otherwise("ok")
    )
    return joined.withColumn("gate", gate)
