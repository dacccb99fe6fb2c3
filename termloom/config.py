"""Settings, and the layered files they come from: defaults, user file, nearest project file, explicit file."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path

#: Words that carry no meaning as index terms, used where no other list is given.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "her", "his", "in", "is", "it", "its", "not",
    "of", "on", "or", "she", "that", "the", "their", "them", "they", "this", "to", "was", "we", "were", "which", "will", "with", "you",
)


@dataclass
class SourceConfig:
    dir: str = "."
    extensions: list[str] = field(default_factory=lambda: ["md", "typ"])
    exclude: list[str] = field(default_factory=list)


@dataclass
class StopWordsConfig:
    """``path`` names a file of words, one a line, that takes the place of the source's own list."""

    source: str = "iso"
    language: str = "en"
    path: str | None = None


@dataclass
class ExcludeConfig:
    terms: list[str] = field(default_factory=list)
    match: str = "contains"
    case: str = "sensitive"


@dataclass
class KnownTerm:
    term: str
    variants: list[str] = field(default_factory=list)


@dataclass
class ExtractConfig:
    ngram_range: list[int] = field(default_factory=lambda: [1, 3])
    min_score: float = 0.1
    max_candidates: int = 500
    max_doc_pct: float = 0.7
    stop_words: StopWordsConfig = field(default_factory=StopWordsConfig)
    exclude: ExcludeConfig = field(default_factory=ExcludeConfig)
    known_terms: list[KnownTerm] = field(default_factory=list)


@dataclass
class CurateConfig:
    model: str = "sonnet"
    max_terms: int = 200
    full_candidates: bool = True
    effort: str = "high"
    max_output_tokens: int = 64_000
    max_budget_usd: float | None = None
    system_prompt: str | None = None
    user_prompt: str | None = None


@dataclass
class Config:
    log_level: str = "info"
    log_dir: str | None = None
    source: SourceConfig = field(default_factory=SourceConfig)
    extract: ExtractConfig = field(default_factory=ExtractConfig)
    curate: CurateConfig = field(default_factory=CurateConfig)


def read_settings(path: str | Path) -> dict:
    """A settings file as nested dictionaries, by its extension."""
    text = Path(path).read_text(encoding="utf-8")
    kind = Path(path).suffix.lstrip(".").lower()
    if kind == "toml":
        return tomllib.loads(text)
    if kind in ("yaml", "yml"):
        import yaml

        return yaml.safe_load(text) or {}
    if kind == "json":
        return json.loads(text)
    raise ValueError(f"settings of kind {kind!r} aren't known: {path}")


def merge(base: dict, over: dict) -> dict:
    """Nested dictionaries, the second's values first."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


#: Extensions and places of a project file, in the order they are tried within a folder.
EXTENSIONS = ("toml", "yaml", "yml", "json")


def project_file(start: str | Path, app: str = "termloom", boundary: str | None = ".git") -> Path | None:
    """The nearest settings file from ``start`` upwards. A folder with ``boundary`` is the last, unless it is the first."""
    start = Path(start).resolve()
    for folder in (start, *start.parents):
        if boundary and folder != start and (folder / boundary).exists():
            inside = _in_folder(folder, app)
            return inside
        if found := _in_folder(folder, app):
            return found
    return None


def _in_folder(folder: Path, app: str) -> Path | None:
    for ext in EXTENSIONS:
        for name in (f".config/{app}.{ext}", f".{app}.{ext}", f"{app}.{ext}"):
            if (folder / name).is_file():
                return folder / name
    return None


def user_file(app: str = "termloom") -> Path | None:
    home = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config")
    return next((p for ext in EXTENSIONS if (p := home / app / f"config.{ext}").is_file()), None)


def build(kind, values: dict):
    """A settings object from nested dictionaries; unknown keys are left out."""
    made = {}
    for f in fields(kind):
        if f.name not in values:
            continue
        value, default = values[f.name], f.default_factory() if callable(f.default_factory) else f.default
        if is_dataclass(default) and isinstance(value, dict):
            value = build(type(default), value)
        if f.name == "known_terms":
            value = [x if isinstance(x, KnownTerm) else build(KnownTerm, x) for x in value]
            if any(not form.strip() for x in value for form in (x.term, *x.variants)):
                raise ValueError("a known term or variant is empty; it would match everything")
        made[f.name] = value
    return kind(**made)


def load(start: str | Path = ".", explicit: str | Path | None = None, app: str = "termloom", user: bool = True) -> Config:
    """Settings from all layers; an explicit file that isn't there is an error."""
    values: dict = asdict(Config())
    for path in (user_file(app) if user else None, project_file(start, app), explicit):
        if path is not None:
            values = merge(values, read_settings(path))
    return build(Config, values)
