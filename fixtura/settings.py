"""Settings from the environment, read once, and the log."""

from __future__ import annotations

import logging
import os
import sys
from dataclasses import dataclass, fields
from functools import lru_cache
from importlib import import_module
from pathlib import Path

PREFIX = "FIXTURA_"


@dataclass(frozen=True)
class Settings:
    """Where the layers lie and what is ingested; each field can be set as FIXTURA_<FIELD>."""

    environment: str = "development"
    log_level: str = "INFO"
    competition_code: str = "PL"
    api_base: str = "https://api.football-data.org/v4"
    api_token: str = ""
    bronze: str = "data/bronze"
    silver: str = "data/silver"
    gold: str = "data/gold"
    artifacts: str = "artifacts"
    validation_season: str = "2023/24"
    test_season: str = "2024/25"

    def make_folders(self) -> Settings:
        for folder in (self.bronze, self.silver, self.gold, self.artifacts):
            Path(folder).mkdir(parents=True, exist_ok=True)
        return self


def read_settings(environment: dict[str, str]) -> Settings:
    return Settings(**{f.name: environment[PREFIX + f.name.upper()] for f in fields(Settings) if PREFIX + f.name.upper() in environment})


@lru_cache
def settings() -> Settings:
    """The settings of this process; layer folders exist afterwards."""
    return read_settings(dict(os.environ)).make_folders()


def health(settings: Settings, modules: tuple[str, ...] = ("pyspark", "pyarrow", "pandas", "numpy", "duckdb")) -> dict[str, bool]:
    """Can the engine run here: its libraries be imported, and its folders be written to?"""
    found = {}
    for name in modules:
        try:
            import_module(name)
        except ImportError:
            found[name] = False
        else:
            found[name] = True
    for folder in (settings.bronze, settings.silver, settings.gold, settings.artifacts):
        probe = Path(folder, ".probe")
        try:
            probe.write_text("x")
            probe.unlink()
        except OSError:
            found[folder] = False
        else:
            found[folder] = True
    return found


def configure_logging(level: str = "INFO", log_file: str | None = None) -> logging.Logger:
    """One handler to the standard output and, if named, one to a file; calling again replaces them."""
    log = logging.getLogger("fixtura")
    log.setLevel(level.upper())
    for handler in list(log.handlers):
        log.removeHandler(handler)
        handler.close()
    wanted: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    if log_file:
        Path(log_file).parent.mkdir(parents=True, exist_ok=True)
        wanted.append(logging.FileHandler(log_file, encoding="utf-8"))
    for handler in wanted:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(handler)
    return log
