"""Tables from a git repository on the driver's disk: its tracked files, commits and the contents of versions.

git runs on the driver and only there; what it lists becomes tables. File contents are read in batches by one
`git cat-file`, so a version costs one process, not one for each file.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from lodestrand.sources.tables import SKIPPED, SUFFIXES

BLOBS, COMMITS = "version string, path string, text string", "version string, parent string, message string"


def git(repo: str, *args: str, given: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], input=given, capture_output=True, check=True).stdout


def clone(url: str, folder: str, version: str | None = None) -> str:
    """A clone of url in folder, at a version if one is given."""
    subprocess.run(["git", "clone", "--quiet", url, folder], check=True, capture_output=True)
    if version:
        git(folder, "checkout", "--quiet", version)
    return folder


def is_source(path: str) -> bool:
    parts = path.split("/")
    return path.rsplit(".", 1)[-1] in SUFFIXES and not set(parts[:-1]) & set(SKIPPED)


def tracked_files(spark: SparkSession, repo: str) -> DataFrame:
    """(path) of the tracked source files."""
    names = git(repo, "ls-files", "-z").decode().split("\0")
    return spark.createDataFrame([(p,) for p in names if p and is_source(p)], "path string")


def commits(spark: SparkSession, repo: str, versions: list[str]) -> DataFrame:
    """(version, parent, message) of the named commits or tags; the parent is the first one, null for a root."""
    rows = []
    for version in versions:
        parents, message = git(repo, "log", "-1", "--format=%P%x00%B", version).decode().split("\0", 1)
        rows.append((version, parents.split()[0] if parents.split() else None, message))
    return spark.createDataFrame(rows, COMMITS)


def contents(repo: str, version: str) -> Iterator[tuple[str, str, str]]:
    """(version, path, text) of the source files at a version."""
    listed = [line.split("\t", 1) for line in git(repo, "ls-tree", "-r", "-z", version).decode().split("\0") if line]
    wanted = [(path, head.split()[2]) for head, path in listed if head.split()[1] == "blob" and is_source(path)]
    data, at = git(repo, "cat-file", "--batch", given="".join(f"{sha}\n" for _, sha in wanted).encode()), 0
    for path, _ in wanted:
        end = data.index(b"\n", at)
        size = int(data[at:end].split()[2])
        yield version, path, data[end + 1 : end + 1 + size].decode(errors="replace")
        at = end + 2 + size


def blobs(spark: SparkSession, repo: str, versions: list[str]) -> DataFrame:
    """(version, path, text) of the source files at each version, as operators.versions reads them."""
    return spark.createDataFrame([row for version in versions for row in contents(repo, version)], BLOBS)
