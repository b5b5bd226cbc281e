"""Ignore rules: the built-in exclusions, and files of glob rules where the last match decides."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import paths


@dataclass(frozen=True)
class Rule:
    pattern: str  # a regular expression for a whole path
    keep: bool
    only_directories: bool


def glob_regex(glob: str, anchored: bool) -> str:
    """`*` and `?` stay within a component, `**` spans components, `[...]` is a class."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return ("" if anchored else "(?:.*/)?") + out


def parse_rules(text: str) -> list[Rule]:
    """The rules of an ignore file; lines that make no pattern are warned about and left out."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[keep:]
        only_directories = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        try:
            pattern = glob_regex(line.lstrip("/"), anchored)
            re.compile(pattern)
        except re.error as e:
            warnings.warn(f"ignore rule {line!r}: {e}", stacklevel=2)
            continue
        rules.append(Rule(pattern, keep, only_directories))
    return rules


def matches(rules: list[Rule], path: str, is_dir: bool, include_deps: bool = False) -> bool:
    """Whether a path is ignored: by a built-in component, or by the last rule that matches it or a directory above it."""
    parts = path.split("/")
    names = paths.EXCLUDED if include_deps else paths.EXCLUDED + paths.DEPENDENCIES
    if any(p in names for p in parts):
        return True
    for k in range(1, len(parts) + 1):
        prefix, directory = "/".join(parts[:k]), is_dir or k < len(parts)
        verdict = None
        for r in rules:
            if (directory or not r.only_directories) and re.fullmatch(r.pattern, prefix):
                verdict = r.keep
        if verdict is False:
            return True
    return False


def is_ignored(path: Column, rules: list[Rule], include_deps: bool = False) -> Column:
    """matches() of files as a column expression."""

    def last_verdict(prefix: Column, directory: bool) -> Column:
        verdict = F.lit(None).cast("boolean")
        for r in rules:
            if directory or not r.only_directories:
                verdict = F.when(prefix.rlike(f"^{r.pattern}$"), F.lit(r.keep)).otherwise(verdict)
        return F.coalesce(~verdict, F.lit(False))

    above = F.exists(paths.ancestors(path), lambda d: last_verdict(d, True))
    return paths.is_excluded(path, include_deps) | above | last_verdict(path, False)
