"""Pod log layout: ``<root>/<namespace>_<pod>_<uid>/<container>/0.log``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.text import raw_log, read_text_files

DEFAULT_ROOT = "/var/log/pods"
# Namespaces never read.
SYSTEM_NAMESPACES = ("kube-system", "kube-public", "kube-node-lease")
# Fixed value: a name ending in a replica set hash and a pod hash.
DEPLOYMENT_POD = r"(?s)^(.*)-[a-z0-9]{4,10}-[a-z0-9]{4,10}\z"
# Runtime prefix of a container log line: time, stream, full or partial flag.
RUNTIME_PREFIX = r"^\d{4}-\d{2}-\d{2}T\S+ (?:stdout|stderr) [FP] "


def deployment_name(pod: Column) -> Column:
    """Pod name without its two generated endings, or as it is."""
    return F.regexp_replace(pod, DEPLOYMENT_POD, "$1")


def pod_meta(dirname: Column) -> Column:
    """Namespace, pod, uid and deployment of a pod directory; NULL for others.

    The namespace ends at the first underscore, the uid starts after the last.
    """
    parts = F.split(dirname, "_", -1)
    pod = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "_")
    return F.when(
        F.size(parts) >= 3,
        F.struct(
            F.get(parts, F.lit(0)).alias("namespace"),
            pod.alias("pod"),
            F.element_at(parts, -1).alias("uid"),
            deployment_name(pod).alias("deployment"),
        ),
    )


def keeps_namespace(namespace: Column, excluded: Sequence[str] = ()) -> Column:
    """Neither a system namespace nor one of ``excluded``."""
    return ~namespace.isin(*SYSTEM_NAMESPACES, *excluded)


def decode_pod_lines(
    lines: DataFrame, excluded: Sequence[str] = (), strip_runtime_prefix: bool = False
) -> DataFrame:
    """RAW_LOG of lines given as ``file_path, seq, ts, line``.

    Lines of files that are not in a pod's directory are left out.
    """
    parts = F.split("file_path", "/")
    found = lines.select(
        "*",
        pod_meta(F.try_element_at(parts, F.lit(-3))).alias("meta"),
        F.try_element_at(parts, F.lit(-2)).alias("container"),
    ).where(F.col("meta").isNotNull() & keeps_namespace(F.col("meta.namespace"), excluded))
    line = F.col("line")
    if strip_runtime_prefix:
        line = F.regexp_replace(line, RUNTIME_PREFIX, "")
    return raw_log(
        found.select(
            F.lit("kubernetes").alias("source"),
            F.col("file_path").alias("origin"),
            "seq",
            "ts",
            line.alias("line"),
            F.create_map(
                F.lit("k8s_namespace"),
                F.col("meta.namespace"),
                F.lit("k8s_pod"),
                F.col("meta.pod"),
                F.lit("k8s_pod_uid"),
                F.col("meta.uid"),
                F.lit("k8s_deployment"),
                F.col("meta.deployment"),
                F.lit("container_name"),
                F.col("container"),
            ).alias("tags"),
        )
    )


def pod_source(
    spark: SparkSession,
    root: str = DEFAULT_ROOT,
    excluded: Sequence[str] = (),
    strip_runtime_prefix: bool = False,
    streaming: bool = False,
) -> DataFrame:
    """RAW_LOG of the active log of every container under ``root``."""
    lines = read_text_files(spark, f"{root.rstrip('/')}/*/*/0.log", streaming)
    return decode_pod_lines(lines, excluded, strip_runtime_prefix)
