"""Models by name from folders, with a cache of compiled models.

No network: ``roots`` are folders (a mirror, a shared mount) that hold
``name/tokenizer.json``, ``name.json`` or a saved model ``name/``.
"""

from __future__ import annotations

import hashlib
import os
import shutil
from pathlib import Path

from ..spec import ModelSpec
from .tokenizer_json import from_json


def cache_folder() -> Path:
    return Path(os.environ.get("WEFTLINE_CACHE") or Path.home() / ".cache" / "weftline")


def clear_cache(folder: Path | None = None) -> int:
    """Deletes compiled models; how many there were."""
    folder = folder or cache_folder()
    own = [p for p in folder.glob("*-*") if (p / "model.json").exists()] if folder.exists() else []
    for p in own:
        shutil.rmtree(p)
    return len(own)


def compiled(path: str | Path, folder: Path | None = None) -> ModelSpec:
    """The model of a JSON file, from the cache if it was read before; a damaged entry is made anew."""
    path, folder = Path(path), folder or cache_folder()
    own = folder / f"{path.stem}-{hashlib.sha256(path.read_bytes()).hexdigest()[:24]}"
    if own.exists():
        try:
            return ModelSpec.load(own)
        except (ValueError, KeyError, OSError):
            pass
    spec = from_json(path)
    spec.save(own)
    return spec


def from_pretrained(name: str, roots: tuple[str | Path, ...] = (), revision: str | None = None, cache_dir: str | Path | None = None) -> ModelSpec:
    folder = Path(cache_dir) if cache_dir else None
    for root in map(Path, roots or (Path.cwd(),)):
        for base in ([root / name / revision, root / revision / name] if revision else [root / name]):
            if (base / "model.json").exists():
                return ModelSpec.load(base)
            for p in (base / "tokenizer.json", base if base.suffix == ".json" else base.with_name(base.name + ".json")):
                if p.is_file():
                    return compiled(p, folder)
    raise FileNotFoundError(f"no model {name!r} in {', '.join(map(str, roots or ('.',)))}")
