"""Configuration: TOML values, then environment, then defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

CONFIG_PATH = Path.home() / ".config" / "shelfmark" / "config.toml"

# Keys that may come from the environment.
ENV_KEYS = {"openrouter": "OPENROUTER_API_KEY", "gemini": "GEMINI_API_KEY",
            "mistral": "MISTRAL_API_KEY", "resend_api_key": "RESEND_API_KEY"}


@dataclass(frozen=True)
class Paths:
    inbox: str = "~/inbox/books"
    done: str = "~/inbox/done"
    quarantine: str = "~/inbox/quarantine"
    staging: str = "~/staging"
    obsidian_vault: str = "~/obsidian/vault"
    repo_root: str = "~/library"

    def __post_init__(self) -> None:
        for f in fields(self):
            value = str(getattr(self, f.name))
            # URIs of shared storage pass through, local paths are expanded.
            if "://" not in value:
                object.__setattr__(self, f.name, str(Path(value).expanduser().resolve()))

    @property
    def staging_local(self) -> str:
        return f"{self.staging}/local"

    @property
    def staging_epub(self) -> str:
        return f"{self.staging}/epub"

    @property
    def staging_cloud(self) -> str:
        return f"{self.staging}/cloud"

    @property
    def batches(self) -> str:
        return f"{self.staging}/cloud/.batches"

    @property
    def markdown(self) -> str:
        return f"{self.repo_root}/markdown"

    @property
    def maps(self) -> str:
        return f"{self.repo_root}/maps"

    @property
    def index(self) -> str:
        return f"{self.repo_root}/index"


@dataclass(frozen=True)
class Workers:
    local_workers: int = 3
    cleanup_concurrency: int = 4


@dataclass(frozen=True)
class Conversion:
    pdf_engine: str = "cloud"


@dataclass(frozen=True)
class Cleanup:
    fuzzy_threshold: float = 0.7
    strip_images: bool = True
    strip_tables: bool = True


@dataclass(frozen=True)
class Kindle:
    enabled: bool = False
    kindle_email: str = ""
    sender_email: str = ""
    resend_api_key: str = ""


@dataclass(frozen=True)
class Batch:
    poll_interval_minutes: int = 60


@dataclass(frozen=True)
class ApiKeys:
    openrouter: str = ""
    gemini: str = ""
    mistral: str = ""


@dataclass(frozen=True)
class Config:
    paths: Paths = field(default_factory=Paths)
    workers: Workers = field(default_factory=Workers)
    conversion: Conversion = field(default_factory=Conversion)
    cleanup: Cleanup = field(default_factory=Cleanup)
    kindle: Kindle = field(default_factory=Kindle)
    batch: Batch = field(default_factory=Batch)
    api_keys: ApiKeys = field(default_factory=ApiKeys)


def _section(kind: type, raw: dict):
    """Build one section; unknown keys are ignored and values take the default's type."""
    values = {}
    for f in fields(kind):
        if f.name in ENV_KEYS:
            values[f.name] = raw.get(f.name) or os.getenv(ENV_KEYS[f.name], "")
        elif f.name in raw:
            values[f.name] = type(f.default)(raw[f.name])
    return kind(**values)


def load_config(path: str | Path | None = None) -> Config:
    source = Path(path or CONFIG_PATH)
    raw = tomllib.loads(source.read_text(encoding="utf-8")) if source.exists() else {}
    return Config(**{f.name: _section(f.default_factory, raw.get(f.name, {})) for f in fields(Config)})


def template() -> str:
    """A commented-out-free starting file written from the defaults themselves."""
    parts = []
    for section in fields(Config):
        parts.append(f"[{section.name}]")
        for f in fields(section.default_factory):
            if f.name in ENV_KEYS:
                parts.append(f"# {f.name} is read from {ENV_KEYS[f.name]} when absent")
            else:
                value = f.default
                parts.append(f"{f.name} = {str(value).lower() if isinstance(value, bool) else repr(value)}"
                             .replace("'", '"'))
        parts.append("")
    return "\n".join(parts)


def ensure_config(path: str | Path | None = None) -> Config:
    target = Path(path or CONFIG_PATH)
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(template(), encoding="utf-8")
    return load_config(target)


def ensure_directories(cfg: Config) -> None:
    p = cfg.paths
    for folder in (p.inbox, p.done, p.quarantine, p.staging_local, p.staging_epub, p.staging_cloud,
                   p.batches, p.markdown, p.maps):
        if "://" not in folder:
            Path(folder).mkdir(parents=True, exist_ok=True)
