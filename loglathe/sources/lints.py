"""What is wrong with schema files and their references, told before contracts are made of them.

They are a few small files of configuration, read on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from .config import PLURALS, read_words

#: What the shared definitions call the words of a field, where it isn't the field's name (fixed values).
SINGULARS = {"safety_flags": "safety_flag"}
#: Fields that the shared definitions have to have.
SHARED = ("level", "category", "sub_category", "outcome", "safety_flags")


def _walk(node: Any, pointer: str = "") -> Iterator[tuple[str, Any]]:
    """(pointer, node) of all objects and lists of a JSON document."""
    if isinstance(node, (dict, list)):
        yield pointer, node
        for k, v in node.items() if isinstance(node, dict) else enumerate(node):
            yield from _walk(v, f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}")


class _Schemas:
    """Documents of a folder, and those outside it that they name, by path; ``$id`` names stand for theirs."""

    def __init__(self, folder: str):
        self.docs: dict[str, Any] = {}
        self.ids: dict[str, str] = {}
        self.root = Path(folder).resolve()
        for p in sorted(self.root.rglob("*.json")):
            self.load(p)

    def load(self, path: Path) -> str | None:
        name = path.resolve().as_posix()
        if name not in self.docs:
            try:
                self.docs[name] = json.loads(Path(name).read_text(encoding="utf-8"))
            except (OSError, ValueError):
                return None
            made = self.docs[name]
            if isinstance(made, dict) and isinstance(made.get("$id"), str):
                self.ids[made["$id"]] = name
        return name

    def short(self, name: str) -> str:
        path = Path(name)
        return path.relative_to(self.root).as_posix() if path.is_relative_to(self.root) else name

    def target(self, base: str, ref: str) -> tuple[str, str] | None:
        """(file, pointer) that a reference names, or None if it isn't there."""
        name, _, pointer = ref.partition("#")
        found = base if not name else self.ids.get(name) or self.load(Path(base).parent / name)
        if found is None:
            return None
        node = self.docs[found]
        for part in filter(None, pointer.split("/")):
            part = part.replace("~1", "/").replace("~0", "~")
            if isinstance(node, dict) and part in node:
                node = node[part]
            elif isinstance(node, list) and part.isdigit() and int(part) < len(node):
                node = node[int(part)]
            else:
                return None
        return found, pointer.rstrip("/")


def reference_edges(folder: str) -> list[tuple[str, str, str | None]]:
    """(where, reference, what it names) for each ``$ref`` of the schemas in a folder: ``file#/pointer``
    both, None for one that names nothing."""
    schemas, out, done = _Schemas(folder), [], set()
    while todo := [x for x in schemas.docs if x not in done]:  # references may bring in files from outside
        for name in todo:
            done.add(name)
            for pointer, node in _walk(schemas.docs[name]):
                if isinstance(node, dict) and isinstance(node.get("$ref"), str):
                    found = schemas.target(name, node["$ref"])
                    out.append((f"{schemas.short(name)}#{pointer}", node["$ref"], found and f"{schemas.short(found[0])}#{found[1]}"))
    return sorted(out, key=lambda x: x[:2])


def _within(where: str, target: str) -> bool:
    """Whether a place is in what a reference names."""
    return where == target or where.startswith(f"{target}/") or (target.endswith("#") and where.startswith(target))


def reference_problems(folder: str) -> list[str]:
    """References that name nothing, and rings of references, each by its path."""
    edges = reference_edges(folder)
    found = [f"{where}: {ref!r} names nothing" for where, ref, target in edges if target is None]
    after = {where: [w for w, _, t in edges if t is not None and _within(w, target)] for where, _, target in edges if target is not None}
    told: set[frozenset[str]] = set()
    finished: set[str] = set()

    def follow(where: str, path: list[str]) -> None:
        if where in path:
            ring = path[path.index(where) :]
            if frozenset(ring) not in told:
                told.add(frozenset(ring))
                found.append("ring: " + " -> ".join([*ring, where]))
            return
        if where in finished:
            return
        for x in after.get(where, ()):
            follow(x, [*path, where])
        finished.add(where)

    for where in after:
        follow(where, [])
    return found


def shared_problems(shared: str, vocabulary: str) -> list[str]:
    """What is wrong with the shared definitions of schemas, whose words have to be references to the
    vocabulary's and nothing else."""
    given = json.loads(Path(shared).read_text(encoding="utf-8"))
    found = [f"#{pointer}: words of its own" for pointer, node in _walk(given) if isinstance(node, dict) and "enum" in node]
    words, defs = read_words(vocabulary), given.get("$defs") or {}
    for name in (*SHARED, "error_code"):
        own, plural = SINGULARS.get(name, name), PLURALS[name]
        node = defs.get(own)
        if node is None:
            found += [f"#/$defs/{own}: missing"] if name in SHARED else []
            continue
        refs = [x["$ref"] for x in [node, *(node.get("allOf") or [])] if isinstance(x, dict) and isinstance(x.get("$ref"), str)]
        if len(refs) != 1:
            found.append(f"#/$defs/{own}: {len(refs)} references")
            continue
        path, _, pointer = refs[0].partition("#")
        if (Path(shared).parent / path).resolve() != Path(vocabulary).resolve() or pointer != f"/$defs/{plural}":
            found.append(f"#/$defs/{own}: {refs[0]!r} isn't the vocabulary's {plural}")
        elif not words.get(name) or not all(isinstance(x, str) for x in words[name]):
            found.append(f"#/$defs/{own}: the vocabulary has no {plural}")
    return found
