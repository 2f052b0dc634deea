"""Project configuration: validation, discovery and version requirements."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath

from factloom.plans.verdict import Refusal

KINDS = ("evidence", "concept", "code")


@dataclass(frozen=True)
class Collection:
    path: str
    kind: str
    extensions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    requires: str
    collections: tuple[Collection, ...]
    towers: str | None = None
    tags: tuple[str, ...] = ()
    image_tag: str = ""
    sha256: str = field(default="", compare=False)


def refuse(subject: str, reason: str) -> Refusal:
    return Refusal("Malformed", "load configuration", subject, reason, "correct the configuration file")


def relative(path: object) -> str:
    """A normalised path below the root."""
    if not isinstance(path, str) or not path or path.startswith("/") or "\\" in path:
        raise refuse(str(path), "a path must be relative")
    out: list[str] = []
    for part in PurePosixPath(path).parts:
        if part == "..":
            if not out:
                raise refuse(path, "a path leaves the root")
            out.pop()
        else:
            out.append(part)
    return "/".join(out) or "."


def known(obj: object, allowed: set[str], where: str) -> dict:
    if not isinstance(obj, dict):
        raise refuse(where, "an object is expected")
    if extra := sorted(set(obj) - allowed):
        raise refuse(where, f"unknown key {extra[0]!r}")
    return obj


def parse(data: bytes, requires_key: str = "requires") -> Config:
    """A validated configuration from the bytes of its file."""
    try:
        top = json.loads(data)
    except ValueError as e:
        raise refuse("file", f"not JSON: {e}") from None
    top = known(top, {"schema", requires_key, "towers", "collections", "seals"}, "file")
    if top.get("schema") != 1 or isinstance(top.get("schema"), bool):
        raise refuse("schema", "must be 1")
    if not isinstance(top.get(requires_key), str) or version(top[requires_key], True) is None:
        raise refuse(requires_key, "must be MAJOR.MINOR or MAJOR.MINOR.PATCH")
    if not isinstance(top.get("collections"), list) or not top["collections"]:
        raise refuse("collections", "must be a list that is not empty")
    collections = []
    for c in top["collections"]:
        c = known(c, {"path", "kind", "extensions"}, "collection")
        if c.get("kind") not in KINDS:
            raise refuse("kind", f"must be one of {', '.join(KINDS)}")
        endings = c.get("extensions")
        if (c["kind"] == "code") != bool(endings) or endings is not None and not (isinstance(endings, list) and all(isinstance(e, str) and e.startswith(".") for e in endings)):
            raise refuse("extensions", "required for code, and only there, as a list of endings")
        collections.append(Collection(relative(c.get("path")), c["kind"], tuple(endings or ())))
    tags, image = (), ""
    if "seals" in top:
        seals = known(top["seals"], {"tags", "imageTag"}, "seals")
        tags = seals.get("tags")
        if not isinstance(tags, list) or not tags or not all(isinstance(t, str) and re.fullmatch("[A-Z][A-Z0-9_]*", t) for t in tags):
            raise refuse("tags", "must be capital names")
        image = seals.get("imageTag", "")
        if image and image not in tags:
            raise refuse("imageTag", "must be one of the tags")
    towers = relative(top["towers"]) if "towers" in top else None
    return Config(top[requires_key], tuple(collections), towers, tuple(tags), image, hashlib.sha256(data).hexdigest())


def discover(start: str, name: str = "factloom.json") -> Path:
    """The configuration file of the nearest folder upwards."""
    for folder in (at := Path(start).resolve(), *at.parents):
        if (folder / name).is_file():
            return folder / name
    raise Refusal("NotFound", "find configuration", start, f"no {name} here or above")


def version(text: str, patch_optional: bool) -> tuple[int, int, int] | None:
    if not re.fullmatch(r"\d+\.\d+(\.\d+)?" if patch_optional else r"\d+\.\d+\.\d+", text, re.ASCII):
        return None
    numbers = [int(x) for x in text.split(".")]
    return tuple(numbers + [0] * (3 - len(numbers)))


def accepts(required: str, running: str) -> bool:
    """Does a running version satisfy a requirement? 0.x: equal minor, patch at least; from 1 on: equal major, (minor, patch) at least."""
    want, have = version(required, True), version(running, False)
    if want is None or have is None:
        raise refuse(required, "not a version")
    return want[0] == have[0] and (want[1] == have[1] and have[2] >= want[2] if want[0] == 0 else have[1:] >= want[1:])
