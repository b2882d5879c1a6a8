"""A registry of named stages, DataFrame to DataFrame, and their composition.

A stage that needs a model outside this engine (page segmentation, lead
identification) is registered by its user under its name; until then a plan
that enables it is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import content_key
from pulsegrid.tables import materialise

Stage = Callable[..., DataFrame]
_KNOWN: dict[str, Stage] = {}


@dataclass
class Step:
    name: str
    enabled: bool = True
    params: dict = field(default_factory=dict)


def register(name: str, stage: Stage) -> None:
    _KNOWN[name] = stage


def identity(df: DataFrame) -> DataFrame:
    return df


register("reconstruct", identity)


def run(df: DataFrame, steps: list[Step], write: bool = True) -> DataFrame:
    """df through the enabled steps in order, each step's rows written before the next reads them."""
    for step in steps:
        if not step.enabled:
            continue
        if step.name not in _KNOWN:
            raise KeyError(f"stage {step.name} is not registered; known: {sorted(_KNOWN)}")
        df = df.transform(_KNOWN[step.name], **step.params)
        df = materialise(df, step.name) if write else df
    return df


def cached(images: DataFrame, cache: DataFrame, model: str, stage: Stage) -> DataFrame:
    """(key, ...) of an expensive stage for images (content): what the cache has, and the stage's rows for the rest.

    Equal contents are computed once; the key is a hash of content and model.
    """
    keyed = images.withColumn("key", content_key(F.col("content"), model)).dropDuplicates(["key"])
    fresh = stage(keyed.join(cache.select("key").distinct(), "key", "left_anti"))
    return cache.join(keyed.select("key"), "key", "left_semi").unionByName(fresh.select(cache.columns))
