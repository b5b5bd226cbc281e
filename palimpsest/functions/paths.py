"""Path strings with `/` as separator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components never part of a snapshot (a store's own folder among them), and those of installed dependencies.
STORE_FOLDER = ".palimpsest"
EXCLUDED = (".git", STORE_FOLDER, "target")
DEPENDENCIES = ("node_modules", ".venv", "venv", "__pypackages__", ".tox", ".nox", ".gradle", ".m2")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column) -> Column:
    """Components; the root (empty) has none."""
    return F.when(path == "", F.lit(0)).otherwise(F.regexp_count(path, F.lit("/")) + 1)


def ancestors(path: Column) -> Column:
    """The directories above a path, without the root."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def joined(prefix: Column, name: Column) -> Column:
    return F.when(prefix == "", name).otherwise(F.concat_ws("/", prefix, name))


def with_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def has_component(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def is_excluded(path: Column, include_deps: bool = False) -> Column:
    return has_component(path, EXCLUDED if include_deps else EXCLUDED + DEPENDENCIES)


#: Fixed value: how the parts of a pack are named.
PART_NAME = "pack-%s.dat.part-%06d"


def part_name(pack: Column, number: Column) -> Column:
    return F.format_string(PART_NAME, pack.cast("string"), number)


def pack_of_part(name: Column) -> Column:
    """The pack that a part's or a whole pack's file name tells; null for other names."""
    return F.nullif(F.regexp_extract(name, r"^pack-(.+)\.dat(?:\.part-[0-9]{6,})?$", 1), F.lit(""))
