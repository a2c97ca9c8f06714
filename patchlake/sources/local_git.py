"""A data source over local git repositories: ``format("local_git")`` with option ``paths``, one partition a repository.

Rows: path, repository (owner/name of the remote), base, diff.  A clean worktree falls back to the change of the last
commit.  A repository in which git fails gives an empty diff.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, repository string, base string, diff string"


def _git(path: str, *args: str) -> str:
    try:
        return subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, errors="replace", timeout=60).stdout
    except (OSError, subprocess.SubprocessError):
        return ""


class _Repository(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.base = options.get("paths", "").split(","), options.get("base", "")

    def partitions(self) -> list[_Repository]:
        return [_Repository(p.strip()) for p in self.paths if p.strip()]

    def read(self, partition: _Repository) -> Iterator[tuple]:
        path, base = partition.path, self.base or "HEAD"
        diff = _git(path, "diff", base)
        if not diff and not self.base:
            base = "HEAD~1"
            diff = _git(path, "diff", base)
        found = re.search(r"[/:]([^/:]+/[^/]+?)(?:\.git)?/?$", _git(path, "remote", "get-url", "origin").strip())
        yield path, found.group(1) if found else path.rstrip("/").rpartition("/")[2], base, diff


class LocalGit(DataSource):
    @classmethod
    def name(cls) -> str:
        return "local_git"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
