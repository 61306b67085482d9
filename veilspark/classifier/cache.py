"""Model files on disk: where they are kept, whether they are there, how large they are, and removing them."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from ..functions.text import env_flag
from ..schema import LABELS, EngineError, ErrorCode

#: Environment variables: another folder; whether fetching is forbidden.
ROOT_VARIABLE, OFFLINE_VARIABLE = "VEILSPARK_CACHE_DIR", "VEILSPARK_OFFLINE"


@dataclass(frozen=True)
class CachedFile:
    path: str
    size: int


def root(explicit: str | None = None) -> Path:
    """The folder given, else the variable's, else below the user's cache folder."""
    if found := explicit or os.environ.get(ROOT_VARIABLE):
        return Path(found)
    return Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "veilspark"


def folder_of(source: str, explicit: str | None = None) -> Path:
    """One folder per model source."""
    return root(explicit) / hashlib.sha256(source.encode()).hexdigest()[:16]


def fetch(source: str, name: str, get: Callable[[str, Path], None], explicit: str | None = None, offline: bool | None = None, tell: Callable[[str, str], None] | None = None) -> Path:
    """The path of a model file: a kept one that is not empty, else got by ``get(url, to)`` and then renamed."""
    say = tell or (lambda event, file: None)
    path = folder_of(source, explicit) / name
    if path.exists() and path.stat().st_size > 0:
        say("cache-hit", name)
        return path
    if env_flag(OFFLINE_VARIABLE) if offline is None else offline:
        raise EngineError(f"{name} of {source} is not cached and fetching is off", ErrorCode.MODEL_DOWNLOAD_FAILED)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(path.suffix + ".part")
    say("download", name)
    try:
        get(f"{source.rstrip('/')}/{name}", part)
        part.replace(path)
    except OSError as e:
        raise EngineError(f"{name}: {e}", ErrorCode.MODEL_DOWNLOAD_FAILED) from e
    say("ready", name)
    return path


def info(explicit: str | None = None) -> list[CachedFile]:
    top = root(explicit)
    return sorted((CachedFile(str(p), p.stat().st_size) for p in top.rglob("*") if p.is_file()), key=lambda f: f.path) if top.exists() else []


def clear(explicit: str | None = None) -> int:
    """Removes everything kept; returns the bytes freed."""
    freed = sum(f.size for f in info(explicit))
    shutil.rmtree(root(explicit), ignore_errors=True)
    return freed


def head_labels(id2label: dict[str | int, str]) -> tuple[str, ...]:
    """The label names of a model's classification head, whose ids must be contiguous: O, then B, I, E, S of each."""
    names = {int(k): v for k, v in id2label.items()}
    if sorted(names) != list(range(len(names))) or names.get(0) != "O" or (len(names) - 1) % 4:
        raise EngineError("the head's classes are not O and blocks of B, I, E, S")
    labels = []
    for k in range(1, len(names), 4):
        block = [names[k + j].partition("-") for j in range(4)]
        if [b[0] for b in block] != ["B", "I", "E", "S"] or len({b[2] for b in block}) != 1:
            raise EngineError(f"classes {k} to {k + 3} are not one label's B, I, E, S")
        labels.append(block[0][2])
    if len(names) == 1 + 4 * len(LABELS) and set(labels) != set(LABELS):
        raise EngineError("the head's labels are not the known ones")
    return tuple(labels)
