"""What a run ran on, where it is, and what it is called."""

from __future__ import annotations

import platform
import re
import shutil
import subprocess
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")


def root_of(start: str | Path, markers: tuple[str, ...] = (".git", "pyproject.toml")) -> Path:
    """The nearest folder from ``start`` up that has one of the markers."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if any((folder / m).exists() for m in markers):
            return folder
    raise FileNotFoundError(f"none of {markers} above {start}")


def git_state(folder: str | Path) -> dict[str, Any]:
    """Commit and whether files differ from it; nulls where there is no repository."""
    ask = lambda *words: subprocess.run(["git", "-C", str(folder), *words], capture_output=True, text=True, timeout=60)
    commit = ask("rev-parse", "HEAD")
    return {"commit": commit.stdout.strip(), "dirty": bool(ask("status", "--porcelain").stdout.strip())} if commit.returncode == 0 else {"commit": None, "dirty": None}


def snapshot(spark: SparkSession, folder: str | Path) -> dict[str, Any]:
    """Versions, settings that decide a plan, git state and free disk of the driver."""
    wanted = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.checkpoint.dir")
    return {
        "created_at": datetime.now(UTC).isoformat(), "python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "master": spark.sparkContext.master,
        "settings": {k: spark.conf.get(k, None) for k in wanted}, "git": git_state(folder), "free_disk_gb": round(shutil.disk_usage(folder).free / 1e9, 3),
    }


def require(taken: dict[str, Any], *, clean_git: bool = True, free_disk_gb: float = 0.0) -> None:
    """Raise unless a snapshot meets a run's gates."""
    if clean_git and taken["git"]["dirty"] is not False:
        raise ValueError("files differ from the commit, or there is no repository")
    if taken["free_disk_gb"] < free_disk_gb:
        raise ValueError(f"{taken['free_disk_gb']} GB of disk are free, {free_disk_gb} are needed")


def run_id(name: str, when: datetime | None = None) -> str:
    """A run's name with its time, fit for a folder."""
    return valid_run_id(f"{name}-{(when or datetime.now(UTC)).strftime('%Y%m%dT%H%M%SZ')}")


def valid_run_id(value: str) -> str:
    if not _NAME.fullmatch(value) or ".." in value:
        raise ValueError(f"{value!r} is no name of a run")
    return value
