"""Several configured sources as one raw log."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.containers import container_source
from faultline.sources.journal import journal_source
from faultline.sources.otlp import otlp_source
from faultline.sources.pods import DEFAULT_ROOT, pod_source
from faultline.sources.text import file_source, raw_log
from faultline.streaming.containers import CHUNK_SCHEMA, container_stream

LOG = logging.getLogger(__name__)
Reader = Callable[[SparkSession, Mapping[str, Any]], DataFrame]



def _containers(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    excluded = config.get("exclude_containers", ())
    if not config.get("streaming", False):
        return container_source(spark.read.parquet(*config["paths"]), excluded)
    chunks = reduce(
        DataFrame.unionByName,
        (spark.readStream.schema(CHUNK_SCHEMA).parquet(path) for path in config["paths"]),
    )
    return container_stream(chunks, excluded)


READERS: dict[str, Reader] = {
    "file": lambda spark, c: file_source(spark, list(c["paths"]), c.get("streaming", False)),
    "kubernetes": lambda spark, c: pod_source(
        spark,
        c.get("root", DEFAULT_ROOT),
        c.get("exclude_namespaces", ()),
        c.get("strip_runtime_prefix", False),
        c.get("streaming", False),
    ),
    "journald": lambda spark, c: journal_source(
        spark, list(c["paths"]), c.get("units", ()), c.get("streaming", False)
    ),
    "otel": lambda spark, c: otlp_source(spark, list(c["paths"]), c.get("streaming", False)),
    "docker": _containers,
}


def union_sources(
    spark: SparkSession,
    configs: Sequence[Mapping[str, Any]],
    readers: Mapping[str, Reader] | None = None,
) -> DataFrame:
    """RAW_LOG of all enabled sources; unknown types are skipped with a warning.

    ``origin`` begins with the number of the config, so ``seq`` is unique in an origin whatever
    the sources share.

    Sources are read once, or as streams where every config says ``streaming``.
    """
    known = {**READERS, **(readers or {})}
    logs = []
    for number, config in enumerate(configs):
        if not config.get("enabled", True):
            continue
        reader = known.get(config["type"])
        if reader is None:
            LOG.warning("unknown source type %s, skipped", config["type"])
            continue
        # Two configs may name the same file, or number their rows alike.
        origin = F.concat(F.lit(f"{number}:"), F.coalesce("origin", F.lit("")))
        logs.append(raw_log(reader(spark, config)).withColumn("origin", origin))
    if not logs:
        raise ValueError("no sources configured")
    return reduce(DataFrame.unionByName, logs)
