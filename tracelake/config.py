"""Configuration: where the store is and which projects have names."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

NAME = "tracelake"


#: Folders below the home folder that hold transcripts where none are configured (fixed values).
DEFAULT_ROOTS = (".claude/projects", ".claude_agents/projects")


class BadConfig(ValueError):
    """The file can't be read, or a change to it makes no sense."""


def _base(variable: str, fallback: str) -> Path:
    return Path(os.environ.get(variable) or Path.home() / fallback) / NAME


def store_path(flag: str | None = None) -> str:
    """Flag, then environment, then the user's data folder."""
    return flag or os.environ.get("TRACELAKE_STORE") or str(_base("XDG_DATA_HOME", ".local/share") / "store")


def config_path(flag: str | None = None) -> Path:
    return Path(flag or os.environ.get("TRACELAKE_CONFIG") or _base("XDG_CONFIG_HOME", ".config") / "config.toml")


@dataclass
class Config:
    path: Path
    projects: dict[str, str] = field(default_factory=dict)
    roots: list[str] = field(default_factory=list)

    @classmethod
    def read(cls, path: Path) -> Config:
        """What the file says; without a file, nothing is configured."""
        if not path.exists():
            return cls(path)
        try:
            said = tomllib.loads(path.read_text())
            return cls(path, {p["alias"]: p["path"] for p in said.get("projects", [])}, [r + "" for r in said.get("transcript_roots", [])])
        except (tomllib.TOMLDecodeError, KeyError, TypeError, AttributeError) as e:
            raise BadConfig(f"{path}: {e}") from e

    def write(self) -> None:
        quoted = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
        self.path.parent.mkdir(parents=True, exist_ok=True)
        roots = f"transcript_roots = [{', '.join(map(quoted, self.roots))}]\n\n" if self.roots else ""
        self.path.write_text(roots + "\n".join(f"[[projects]]\nalias = {quoted(a)}\npath = {quoted(p)}\n" for a, p in sorted(self.projects.items())))

    def transcript_roots(self) -> list[str]:
        """Configured folders of transcripts, or those of the default ones that are there."""
        return self.roots or [str(p) for p in (Path.home() / name for name in DEFAULT_ROOTS) if p.exists()]

    def add(self, alias: str, path: str) -> None:
        self.projects[alias] = path

    def remove(self, alias: str) -> None:
        if self.projects.pop(alias, None) is None:
            raise BadConfig(f"no project {alias}")

    def rename(self, old: str, new: str) -> None:
        if old not in self.projects:
            raise BadConfig(f"no project {old}")
        if new in self.projects:
            raise BadConfig(f"project {new} exists")
        self.projects[new] = self.projects.pop(old)

    def frame(self, spark):
        return spark.createDataFrame(sorted(self.projects.items()), "alias string, path string") if self.projects else None
