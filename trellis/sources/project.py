"""Source files of a project folder, and files of JSON lines."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trellis.operators.build import is_dense, language_of

# ---- fixed values: folders and files that are never read
EXCLUDES = [
    "node_modules", "dist", "build", "out", ".git", ".next", ".nuxt", ".turbo", "coverage", "__pycache__", ".venv", "venv", "env", "vendor", "target", "tmp", "log", "cdk.out", "deployment_packages",
    "public/packs", "public/assets", ".terraform", ".serverless", "*.min.js", "*.min.css", "*.bundle.js", "*.chunk.js",
]


def glob_pattern(rule: str) -> str:
    """Regular expression for a relative path under a rule in the manner of an ignore file."""
    folder, rule = rule.endswith("/"), rule.strip("/") if rule.strip("/") else rule
    anchored = "/" in rule
    out, i = "", 0
    while i < len(rule):
        if rule[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif rule[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def excluded(path: str, rules: list[str] | None = None) -> Column:
    rules = EXCLUDES if rules is None else rules
    return F.col(path).rlike("|".join(glob_pattern(r) for r in rules)) if rules else F.lit(False)


class _Ignore:
    """Rules of one ignore file; later ones win, ``!`` takes back, a leading or inner slash ties a rule to the folder."""

    def __init__(self, lines: list[str]):
        self.rules = []
        for rule in (s.strip() for s in lines):
            if not rule or rule.startswith("#"):
                continue
            back, rule = rule.startswith("!"), rule.removeprefix("!")
            tied, only_dir, rule = rule.startswith("/"), rule.endswith("/"), rule.strip("/")
            pattern = glob_pattern(rule)
            self.rules.append((back, only_dir, re.compile("^" + pattern.removeprefix("(?:^|/)") if tied and not pattern.startswith("^") else pattern)))

    def says(self, path: str, is_dir: bool) -> bool | None:
        said = None
        for back, only_dir, pattern in self.rules:
            if (is_dir or not only_dir) and pattern.search(path):
                said = not back
        return said


def list_files(root: str, excludes: list[str] | None = None, unreadable: list[str] | None = None) -> list[str]:
    """Relative paths below ``root`` in the order of names: no hidden ones, none that an ignore file or rule leaves out.

    A link counts only if it leads to a plain file inside the root that would be listed itself.  A folder that cannot be
    read is passed over and added to ``unreadable``; a root that cannot be read is an error.
    """
    real = os.path.realpath(root)
    rules = re.compile("|".join(glob_pattern(r) for r in (EXCLUDES if excludes is None else excludes)) or r"(?!)")
    out: list[str] = []
    links: list[str] = []

    def walk(folder: str, ignores: list[tuple[str, _Ignore]]) -> None:
        for name in (".ignore", ".gitignore"):
            file = os.path.join(real, folder, name)
            if os.path.isfile(file):
                with open(file, encoding="utf-8", errors="replace") as f:
                    ignores = [*ignores, (folder, _Ignore(f.readlines()))]
        try:
            with os.scandir(os.path.join(real, folder)) as it:
                entries = sorted(it, key=lambda x: x.name)
        except OSError:
            if not folder:
                raise
            if unreadable is not None:
                unreadable.append(folder)
            return
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            if e.name.startswith(".") or rules.search(path + "/" if is_dir else path):
                continue
            said = None
            for base, ignore in ignores:
                own = ignore.says(path[len(base) + 1 :] if base else path, is_dir)
                said = said if own is None else own
            if said:
                continue
            if is_dir:
                walk(path, ignores)
            elif e.is_symlink():
                links.append(path)
            elif e.is_file(follow_symlinks=False):
                out.append(path)

    walk("", [])
    there = set(out)
    for path in links:
        target = os.path.realpath(os.path.join(real, path))
        if target.startswith(real + os.sep) and os.path.relpath(target, real) in there:
            out.append(path)
    return sorted(out)


def read_project(spark: SparkSession, root: str, excludes: list[str] | None = None, unreadable: list[str] | None = None) -> DataFrame:
    """``path, language, body`` of the readable files of a folder that all executors see.  Only names pass the driver."""
    paths = spark.createDataFrame([(p,) for p in list_files(root, excludes, unreadable)], "path string").withColumn("language", language_of("path")).filter("language is not null")
    real = os.path.realpath(root)

    def load(batches):
        for batch in batches:
            bodies = []
            for p in batch["path"]:
                try:
                    with open(os.path.join(real, p), encoding="utf-8", errors="replace", newline="") as f:
                        bodies.append(f.read())
                except OSError:
                    bodies.append(None)
            batch["body"] = bodies
            yield batch

    rows = paths.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(load, "path string, language string, body string")
    return rows.filter(F.col("body").isNotNull() & ~is_dense("body"))


def read_indexed(files: DataFrame, root: str, path: str) -> str | None:
    """Text of one file if it is indexed, inside the root and a plain file."""
    if os.path.isabs(path) or ".." in path.split("/") or files.filter(F.col("path") == path).isEmpty():
        return None
    real = os.path.realpath(root)
    target = os.path.realpath(os.path.join(real, path))
    if not target.startswith(real + os.sep) or not os.path.isfile(target):
        return None
    with open(target, encoding="utf-8", errors="replace", newline="") as f:
        return f.read()


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of the lines that hold one; blank and broken lines are passed over."""
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("_ok"))
    return rows.filter("_ok is not null and r is not null").select("r.*")

