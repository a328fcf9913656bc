"""Module files: module path, language version, requirements, replacements."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class ManifestError(ValueError):
    """A module file that can't be read, with the line of the first fault."""


@dataclass
class Manifest:
    """requires: (path, version, indirect). replaces: (old path, old version, new path, new version)."""

    path: str = ""
    go_version: str = ""
    requires: list[tuple[str, str, bool]] = field(default_factory=list)
    replaces: list[tuple[str, str, str, str]] = field(default_factory=list)


def _words(line: str) -> list[str]:
    return [w.strip('"`') for w in re.findall(r'"[^"]*"|`[^`]*`|=>|[^\s"`]+', line)]


def parse(text: str) -> Manifest:
    """The manifest of a module file; exclude, retract, toolchain and the like are passed over."""
    out, block = Manifest(), ""
    for n, raw in enumerate(text.splitlines(), 1):
        line, _, note = raw.partition("//")
        words = _words(line)
        if not words:
            continue
        if block and words == [")"]:
            block = ""
            continue
        if not block and len(words) == 2 and words[1] == "(":
            block = words[0]
            continue
        verb, rest = (block, words) if block else (words[0], words[1:])
        if verb == "module" and len(rest) == 1:
            out.path = rest[0]
        elif verb == "go" and len(rest) == 1:
            out.go_version = rest[0]
        elif verb == "require":
            if len(rest) != 2:
                raise ManifestError(f"line {n}: require wants a path and a version")
            out.requires.append((rest[0], rest[1], note.strip().split(";")[0].strip() == "indirect"))
        elif verb == "replace":
            if "=>" not in rest or not 1 <= rest.index("=>") <= 2 or not 1 <= len(rest) - rest.index("=>") - 1 <= 2:
                raise ManifestError(f"line {n}: replace wants old => new")
            k = rest.index("=>")
            old, new = [*rest[:k], ""], [*rest[k + 1 :], ""]
            out.replaces.append((old[0], old[1], new[0], new[1]))
        elif verb in ("module", "go"):
            raise ManifestError(f"line {n}: {verb} wants one word")
        elif verb not in ("exclude", "retract", "toolchain", "tool", "godebug", "ignore"):
            raise ManifestError(f"line {n}: unknown directive {verb!r}")
    if not out.path:
        raise ManifestError("no module line")
    return out
