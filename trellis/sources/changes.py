"""Paths that differ in a git work tree."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def _names(folder: str, *args: str) -> list[str] | None:
    try:
        done = subprocess.run(["git", "-C", folder, "diff", "--name-only", "-z", *args], capture_output=True, check=True)
    except (OSError, subprocess.CalledProcessError):
        return None
    return [p for p in done.stdout.decode("utf-8", "replace").split("\0") if p]


def changed_paths(folder: str, staged: bool = False, between: tuple[str, str] | None = None) -> list[str]:
    """Changed against HEAD, in the index (``staged``) or between two commits.

    A repository without a commit is compared with its index; no repository has no changes.
    """
    if between:
        return _names(folder, *between) or []
    found = _names(folder, "--cached") if staged else _names(folder, "HEAD")
    return found if found is not None else _names(folder) or []


def read_changes(spark: SparkSession, folder: str, **options) -> DataFrame:
    return spark.createDataFrame([(p,) for p in changed_paths(folder, **options)], "path string")
