"""Data sets by a registry: download, verify, lock. A file is at its place only if its checksum was right."""

from __future__ import annotations

import hashlib
import json
import shutil
import urllib.request
from dataclasses import dataclass
from pathlib import Path

from tidewatch.sources.files import ConfigError, closed, load_yaml, write_atomic


@dataclass(frozen=True)
class Remote:
    file: str
    url: str
    checksum: str

    @property
    def expected(self) -> tuple[str, str]:
        """(algorithm, value); a bare checksum is an MD5."""
        algorithm, colon, value = self.checksum.partition(":")
        return (algorithm, value.lower()) if colon else ("md5", algorithm.lower())


def registry(path: str | Path) -> dict[str, list[Remote]]:
    """``{data set: {files: [{file, url, checksum}]}}``. Names must stay inside their folder, algorithms be known."""
    raw = load_yaml(path)
    if not isinstance(raw, dict):
        raise ConfigError(f"{path} is not a registry")
    out = {str(name): [Remote(**closed(f, ("file", "url", "checksum"), str(name))) for f in closed(body, ("files",), str(name))["files"]] for name, body in raw.items()}
    for name, files in out.items():
        for f in files:
            if Path(f.file).name != f.file or Path(name).name != name:
                raise ConfigError(f"{name}/{f.file}: a name must not be a path")
            if f.expected[0] not in hashlib.algorithms_available:
                raise ConfigError(f"{name}/{f.file}: unknown checksum {f.expected[0]}")
    return out


def verified(path: Path, of: Remote) -> bool:
    if not path.is_file():
        return False
    with path.open("rb") as f:
        return hashlib.file_digest(f, of.expected[0]).hexdigest() == of.expected[1]


def fetch(name: str, files: list[Remote], folder: str | Path, force: bool = False) -> list[str]:
    """Bring a data set's files below ``folder``, and write the lock that says what they are. The names of those downloaded."""
    place, got = Path(folder) / name, []
    place.mkdir(parents=True, exist_ok=True)
    for f in files:
        target = place / f.file
        if not force and verified(target, f):
            continue
        part = target.with_name(f.file + ".part")
        with urllib.request.urlopen(f.url) as source, part.open("wb") as sink:  # noqa: S310 - the registry names its sources
            shutil.copyfileobj(source, sink, 1 << 20)
        if not verified(part, f):
            part.unlink()
            raise ConfigError(f"{f.url} is not what the registry says: its {f.expected[0]} differs")
        part.replace(target)
        got.append(f.file)
    lock(Path(folder) / "lock.json", name, files)
    return got


def lock(path: Path, name: str, files: list[Remote]) -> None:
    """Put a data set into the lock; the others stay."""
    known = json.loads(path.read_text(encoding="utf-8")) if path.is_file() else {}
    known[name] = {"files": [{"file": f.file, "checksum": ":".join(f.expected)} for f in files]}
    write_atomic(path, json.dumps(known, indent=1, sort_keys=True) + "\n")
