"""Profiles and hooks: plain driver-side Python, nothing relational."""

from __future__ import annotations

import logging
import os
import re
import subprocess
import tomllib
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path


def substitute(text: str, env: Mapping[str, str] | None = None) -> str:
    """${NAME} by the environment; unknown names stay."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], m[0]), text)


def merge(first: Mapping, second: Mapping) -> dict:
    """Field by field, the first wins where it says anything; tables merge, hook lists append."""
    out = dict(first)
    for k, v in second.items():
        if k not in out or out[k] in (None, "", [], {}, False):
            out[k] = v
        elif isinstance(out[k], Mapping) and isinstance(v, Mapping):
            out[k] = merge(out[k], v)
        elif k.startswith("run-") and isinstance(v, list):
            out[k] = [*out[k], *v]
    return out


def load_profile(name: str, folders: list[Path], env: Mapping[str, str] | None = None, seen: tuple[str, ...] = ()) -> dict:
    """name.toml of the first folder that has it, merged with the profiles it uses, in order."""
    if name in seen:
        raise ValueError(f"profiles use each other: {' -> '.join((*seen, name))}")
    path = next((p for f in folders if (p := Path(f) / f"{name}.toml").exists()), None)
    if path is None:
        raise FileNotFoundError(f"no profile {name!r}")
    out = tomllib.loads(substitute(path.read_text(), env))
    for other in out.get("global", {}).get("use-profiles", []):
        out = merge(out, load_profile(other, folders, env, (*seen, name)))
    return out


@dataclass
class Hooks:
    before: list[str] = field(default_factory=list)
    after: list[str] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)
    final: list[str] = field(default_factory=list)


def shell(command: str) -> None:
    subprocess.run(command, shell=True, check=True)


@contextmanager
def hooked(hooks: Hooks, run: Callable[[str], None] = shell) -> Iterator[None]:
    """before - work - after - finally; a failure anywhere runs failed and finally and is raised again.  Levels nest as contexts do."""
    try:
        for c in hooks.before:
            run(c)
        yield
        for c in hooks.after:
            run(c)
    except BaseException:
        for c in hooks.failed:
            run(c)
        raise
    finally:
        for c in hooks.final:
            run(c)


def set_up_logging(level: str = "info", file: str | None = None, levels: Mapping[str, str] | None = None, dry_run: bool = False) -> logging.Logger:
    """The library's logger: to the console, or to a file; levels by target; a dry run says so in every line."""
    log = logging.getLogger("stratum")
    for h in list(log.handlers):
        log.removeHandler(h)
    handler = logging.FileHandler(file) if file else logging.StreamHandler()
    handler.setFormatter(logging.Formatter(("[dry run] " if dry_run else "") + "%(asctime)s [%(levelname)s] %(message)s"))
    log.addHandler(handler)
    log.setLevel(level.upper())
    for target, own in (levels or {}).items():
        logging.getLogger(f"stratum.{target}").setLevel(own.upper())
    return log
