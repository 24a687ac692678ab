"""Settings, .env files and baseline files: read on the driver, never in a task."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import tempfile
import time
import tomllib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

from gritstone.operators.baseline import envelope

SECTION = "gritstone"
LOCK_SECONDS = 60


@dataclass(frozen=True)
class Config:
    root: Path
    paths: list[str] = field(default_factory=lambda: ["src"])
    mode: str = "ratchet"
    baseline_dir: str = "tests/baselines"
    cache_dir: str = "tests/.cache"
    include_notebooks: bool = False
    cached_only: bool = True
    wrapper_max_call_sites: int = 1
    wrapper_exclude: list[str] = field(default_factory=list)
    wrapper_exempt_decorators: list[str] = field(default_factory=list)

    @property
    def baseline_path(self) -> Path:
        return self.root / self.baseline_dir

    def resolved(self) -> list[Path]:
        """Configured directories that exist, else src, scripts and lib where they do."""
        have = [self.root / p for p in self.paths if (self.root / p).is_dir()]
        return have or [self.root / p for p in ("src", "scripts", "lib") if (self.root / p).is_dir()]


def _strings(x: object, key: str, lenient: bool = False) -> list[str]:
    if lenient and isinstance(x, str):
        return [x]
    if lenient and not isinstance(x, list):
        return []
    if not isinstance(x, list) or not all(isinstance(s, str) for s in x):
        raise TypeError(f"{key} has to be a list of strings")
    return list(x)


def from_section(section: Mapping[str, object], root: Path) -> Config:
    """A typed reading of one TOML table: a wrong mode is the default, any other wrong type a TypeError."""
    get = section.get
    mode = get("mode", "ratchet")
    flag = get("cached_only", True)
    if not isinstance(flag, bool):
        raise TypeError("cached_only has to be true or false")
    sites = get("wrapper_max_call_sites", 1)
    if isinstance(sites, bool) or not isinstance(sites, int) or sites < 0:
        raise TypeError("wrapper_max_call_sites has to be a whole number from 0 on")
    return Config(
        root=root,
        paths=_strings(get("paths", ["src"]), "paths", lenient=True) or ["src"],
        mode=mode if mode in ("ratchet", "strict") else "ratchet",
        baseline_dir=str(get("baseline_dir", "tests/baselines")),
        cache_dir=str(get("cache_dir", "tests/.cache")),
        include_notebooks=bool(get("include_notebooks", False)),
        cached_only=flag,
        wrapper_max_call_sites=sites,
        wrapper_exclude=_strings(get("wrapper_exclude", []), "wrapper_exclude"),
        wrapper_exempt_decorators=_strings(get("wrapper_exempt_decorators", []), "wrapper_exempt_decorators"),
    )


def load(start: Path | str | None = None, section: str = SECTION) -> Config:
    """The nearest pyproject.toml upwards; without one the layout of ``start`` decides."""
    here = Path(start or Path.cwd()).resolve()
    for folder in (here, *here.parents):
        if (folder / "pyproject.toml").is_file():
            tool = tomllib.loads((folder / "pyproject.toml").read_text(encoding="utf-8")).get("tool")
            found = tool.get(section) if isinstance(tool, dict) else None
            return from_section(found if isinstance(found, dict) else {}, folder)
    guess = next((p for p in ("src", "scripts") if (here / p).is_dir()), "." if any(here.glob("*.py")) else "src")
    return Config(root=here, paths=[guess])


cached = lru_cache(maxsize=None)(load)


def parse_dotenv(text: str) -> dict[str, str]:
    """KEY=value lines, with or without export and quotes; comments and other lines are skipped."""
    out = {}
    for line in text.splitlines():
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        key, value = key.strip(), value.strip()
        if eq and key and not key.startswith("#"):
            out[key] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def load_dotenv(start: Path | str | None = None, environ: dict[str, str] | None = None) -> Path | None:
    """The nearest .env upwards into ``environ``; what is set already stays."""
    env = os.environ if environ is None else environ
    here = Path(start or Path.cwd()).resolve()
    for folder in (here, *here.parents):
        if (folder / ".env").is_file():
            for k, v in parse_dotenv((folder / ".env").read_text(encoding="utf-8")).items():
                env.setdefault(k, v)
            return folder / ".env"
    return None


def api_key(provider: str, environ: Mapping[str, str] | None = None) -> str:
    """The key in <PROVIDER>_API_KEY; KeyError, which names the variable, where that is missing or blank."""
    name = f"{provider.split('_')[0].upper()}_API_KEY"
    value = (os.environ if environ is None else environ).get(name, "").strip()
    if not value:
        raise KeyError(f"{name} isn't set")
    return value


def write_json(path: Path, data: object) -> None:
    """Written beside and renamed, so that readers see the old file or the new one."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, encoding="utf-8") as f:
        json.dump(data, f, indent=2, sort_keys=True)
        f.write("\n")
    os.replace(f.name, path)


def load_envelope(path: Path, kind: str) -> dict:
    """The baseline file as an envelope; one of the older form is rewritten."""
    raw = json.loads(path.read_text(encoding="utf-8")) if path.exists() else None
    out = envelope(raw, kind)
    if raw is not None and out is not raw:
        write_json(path, out)
    return out


def save_envelope(path: Path, data: dict, kind: str) -> None:
    write_json(path, envelope(data, kind))


@contextlib.contextmanager
def locked_envelope(path: Path, kind: str, seconds: float = LOCK_SECONDS, rewrite: bool = True) -> Iterator[dict]:
    """The envelope while no other process has it; what the block leaves in it is saved, unless ``rewrite`` is false."""
    lock = path.with_suffix(path.suffix + ".lock")
    lock.parent.mkdir(parents=True, exist_ok=True)
    end = time.monotonic() + seconds
    with lock.open("w") as held:  # the system lets go of it when the process ends, however that may be
        while True:
            try:
                fcntl.flock(held, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() > end:
                    raise TimeoutError(f"{lock} is held") from None
                time.sleep(0.05)
        data = load_envelope(path, kind)
        yield data
        if rewrite:
            save_envelope(path, data, kind)
