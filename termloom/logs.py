"""A log of one JSON object per line, rotated daily, and the model's reasoning beside the terms."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Mapping
from logging.handlers import TimedRotatingFileHandler
from pathlib import Path

ENV_PATH, ENV_DIR = "TERMLOOM_LOG_PATH", "TERMLOOM_LOG_DIR"


def log_file(config_dir: str | None = None, env: Mapping[str, str] = os.environ, service: str = "termloom", system_dir: str = "/var/log") -> Path:
    """Where the log goes: a path or folder from the environment, the settings' folder, else the first of the
    system's folder, the user's data folder and the current one that can be written. What is asked for but
    can't be written is an error."""
    name = f"{service}.jsonl"
    if path := env.get(ENV_PATH):
        return _writable(Path(path))
    if folder := env.get(ENV_DIR) or config_dir:
        return _writable(Path(folder) / name)
    data = Path(env.get("XDG_DATA_HOME") or Path.home() / ".local" / "share")
    for folder in (Path(system_dir), data / service / "logs", Path.cwd()):
        try:
            return _writable(folder / name)
        except OSError:
            continue
    raise OSError("no folder for the log can be written")


def _writable(path: Path) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a"):
        return path


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"timestamp": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname.lower(), "target": record.name, "message": record.getMessage()}, ensure_ascii=False)


def start(level: str = "info", quiet: bool = False, verbose: int = 0, config_dir: str | None = None) -> logging.Logger:
    """Log to the file; quiet shows errors only, each verbose step shows more."""
    chosen = logging.ERROR if quiet else (logging.DEBUG if verbose else getattr(logging, level.upper(), logging.INFO))
    log = logging.getLogger("termloom")
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    handler = TimedRotatingFileHandler(log_file(config_dir), when="midnight", utc=True, delay=True, encoding="utf-8")
    handler.setFormatter(JsonLines())
    log.addHandler(handler)
    log.setLevel(chosen)
    return log


def write_reasoning(path: str | Path, thinking: str, generated: str, incremental: bool) -> None:
    """A model's reasoning: a full run starts the file afresh, an incremental one adds a section. None, no file."""
    if thinking:
        with open(path, "a" if incremental else "w", encoding="utf-8") as out:
            out.write(f"\n---\n## Incremental update {generated}\n\n{thinking}\n" if incremental else thinking)
