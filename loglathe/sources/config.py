"""Rules, contracts and vocabularies of one's own, read from JSON files on the driver.

They are small and become literals of the plan; what is wrong with them is told before any row is read.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path
from typing import Any

from ..functions.vocabulary import ERROR_CODE, Vocabulary
from ..operators.rules import problems


def read_rules(path: str) -> dict[str, Any]:
    """{rules, aliases, default_action} of a file; arguments for rules.classify()."""
    given = json.loads(Path(path).read_text(encoding="utf-8"))
    found = {"rules": given.get("rules", []), "aliases": given.get("aliases", {}), "default_action": given.get("default_action", {})}
    if wrong := problems(found["rules"]):
        raise ValueError("; ".join(wrong))
    return found


class _Files:
    """Schemas of a folder by the names that references use."""

    def __init__(self, folder: Path):
        self.known: dict[str, Any] = {}
        for p in sorted(folder.rglob("*.json")):
            try:
                made = json.loads(p.read_text(encoding="utf-8"))
            except ValueError:
                continue
            self.known[p.resolve().as_posix()] = made
            if isinstance(made, dict) and isinstance(made.get("$id"), str):
                self.known[made["$id"]] = made

    def at(self, base: str, ref: str) -> tuple[str, Any]:
        name, _, pointer = ref.partition("#")
        if name and name not in self.known:
            name = (Path(base).parent / name).resolve().as_posix()
        name = name or base
        if name not in self.known:
            raise ValueError(f"{base}: no schema {ref!r}")
        spec = self.known[name]
        for part in filter(None, pointer.split("/")):
            spec = spec[part.replace("~1", "/").replace("~0", "~")]
        return name, spec

    def resolved(self, base: str, spec: Any, above: tuple[str, ...] = ()) -> Any:
        if isinstance(spec, list):
            return [self.resolved(base, x, above) for x in spec]
        if not isinstance(spec, dict):
            return spec
        if isinstance(spec.get("$ref"), str):
            name, target = self.at(base, spec["$ref"])
            if (mark := f"{name}#{spec['$ref']}") in above:
                raise ValueError(f"{base}: {spec['$ref']!r} refers to itself")
            rest = {k: v for k, v in spec.items() if k != "$ref"}
            return self.resolved(name, target, (*above, mark)) | self.resolved(base, rest, above)
        return {k: self.resolved(base, v, above) for k, v in spec.items()}


def _conditions(spec: dict) -> list[tuple[dict, tuple]]:
    """What fields' values require besides, of if/then at the top and under allOf."""
    found = []
    for x in [spec, *spec.get("allOf", [])]:
        asked = {k: v.get("enum", [v["const"]] if "const" in v else []) for k, v in x.get("if", {}).get("properties", {}).items()}
        if asked and x.get("then", {}).get("required"):
            found.append((asked, tuple(x["then"]["required"])))
    return found


def read_contracts(folder: str, names: dict[str, str]) -> dict[str, dict]:
    """Contracts by domain, of the schema files in a folder (names: a file for each domain) with their
    references resolved; an argument for contracts.check()."""
    root, files = Path(folder), _Files(Path(folder))
    found = {}
    for domain, name in names.items():
        base = (root / name).resolve().as_posix()
        spec = files.resolved(base, files.at(base, "#")[1])
        found[domain] = spec | {"type": "object", "when": _conditions(spec)}
    return found


#: What a vocabulary file calls the words of a field, besides the field's own name (fixed values).
PLURALS = {"level": "levels", "category": "categories", "sub_category": "sub_categories", "outcome": "outcomes", "safety_flags": "safety_flags", "error_code": "error_codes"}
#: Where a vocabulary is looked for, in a folder or one above it (fixed value), and the variable that names one.
VOCABULARY_FILE, VOCABULARY_VARIABLE = "vocab/controlled_vocabulary.json", "LOGLATHE_VOCAB_PATH"


def read_words(path: str) -> dict[str, list[str]]:
    """The words of each field of a vocabulary file: lists or ``enum`` of its ``$defs``, else the names or
    lists of its ``vocabulary``, under the field's name or its plural."""
    given = json.loads(Path(path).read_text(encoding="utf-8"))
    found = {}
    for part in (given.get("$defs") or {}, given.get("vocabulary") or {}):
        for name, plural in PLURALS.items():
            v = part.get(plural, part.get(name))
            words = v.get("enum", sorted(v)) if isinstance(v, dict) else v
            if words:
                found[name] = list(words)
        if found:
            break
    return found


def find_words(path: str | None = None, start: str | None = None) -> str | None:
    """The vocabulary file: the one given, the one that VOCABULARY_VARIABLE names, or VOCABULARY_FILE in the
    folder ``start`` or the first one above it; None where there is none.  A file given has to be there."""
    if path:
        if not Path(path).is_file():
            raise FileNotFoundError(path)
        return path
    named = os.environ.get(VOCABULARY_VARIABLE)
    if named and Path(named).expanduser().is_file():
        return str(Path(named).expanduser())
    here = Path(start or ".").resolve()
    return next((str(x / VOCABULARY_FILE) for x in (here, *here.parents) if (x / VOCABULARY_FILE).is_file()), None)


def load_vocabulary(path: str | None = None, start: str | None = None) -> Vocabulary:
    """The vocabulary of the file found, for Options.words; fields that it doesn't name keep the built-in
    words, and so do all where there is no file.  Raises ValueError for one in which words are doubled."""
    found = find_words(path, start)
    words = read_words(found) if found else {}
    if wrong := [x for x in word_problems(words, ()) if x.endswith("doubled")]:
        raise ValueError(f"{found}: {'; '.join(wrong)}")
    return Vocabulary.of(words)


def word_problems(words: dict[str, list[str]], needed: tuple[str, ...] = ("level", "category", "sub_category", "outcome")) -> list[str]:
    """What is wrong with a vocabulary: missing fields, words that are doubled or not in their form."""
    found = [f"{k}: missing" for k in needed if not words.get(k)]
    for name, values in words.items():
        folded = [x.strip().lower() for x in values]
        found += [f"{name}: {x!r} is doubled" for x in sorted({x for x in folded if folded.count(x) > 1})]
        form = ERROR_CODE if name == "error_code" else r"^[a-z][a-z0-9_]*$"
        found += [f"{name}: {x!r}" for x in values if not re.fullmatch(form, x)]
    return found
