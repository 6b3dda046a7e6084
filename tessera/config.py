"""Settings and where they come from: arguments, then the environment, then ``.env``, then the session, then the project's
``tessera.toml``, then the user's, then the defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.sources.files import DEFAULT_LANGUAGES

PREFIX = "tessera"


@dataclass(frozen=True)
class Settings:
    languages: tuple[str, ...] = DEFAULT_LANGUAGES
    ignore: tuple[str, ...] = ()
    max_tokens: int = 512
    overlap: int = 64
    min_tokens: int = 8
    top_k_dense: int = 20
    top_k_words: int = 20
    top_k_rerank: int = 8
    hops: int = 1
    most_chunks: int = 12
    max_retries: int = 2
    ci: bool = False


def _env_file(path: Path) -> dict[str, str]:
    if not path.is_file():
        return {}
    pairs = (line.split("=", 1) for line in path.read_text().splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip().removeprefix("export ").strip(): v.strip().strip("\"'") for k, v in pairs}


def _toml(path: Path) -> dict[str, object]:
    """The settings of a file: its table ``tessera``, or all of it."""
    if not path.is_file():
        return {}
    held = tomllib.loads(path.read_text())
    return held.get(PREFIX, held)


def _typed(raw: object, default: object) -> object:
    if isinstance(default, bool):
        return raw if isinstance(raw, bool) else str(raw).lower() in ("1", "true", "yes")
    if isinstance(default, int):
        return int(raw)
    return tuple(raw) if isinstance(raw, list | tuple) else tuple(x.strip() for x in str(raw).split(",") if x.strip())


def resolve(spark: SparkSession | None = None, project: str | Path = ".", user: str | Path | None = None, **given: object) -> Settings:
    """Each setting from the first place that has it; ``project`` and ``user`` are the folders of the files."""
    here, home = Path(project), Path(user) if user else Path.home() / ".config" / PREFIX
    env = _env_file(here / ".env") | {k: v for k, v in os.environ.items() if v}
    files = _toml(home / f"{PREFIX}.toml") | _toml(here / f"{PREFIX}.toml")
    out: dict[str, object] = {}
    for f in fields(Settings):
        raw = given.get(f.name)
        if raw is None:
            raw = env.get(f"{PREFIX}_{f.name}".upper())
        if raw is None and spark:
            raw = spark.conf.get(f"{PREFIX}.{f.name}", None)
        if raw is None:
            raw = files.get(f.name)
        if raw is not None:
            out[f.name] = _typed(raw, f.default)
    return Settings(**out)
