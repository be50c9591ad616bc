"""Path expressions. Paths are relative and have `/` between their parts; a null path gives null."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories and file suffixes that a scan leaves out.
IGNORED_PARTS = [
    ".cache", ".claude", ".eclipse", ".eggs", ".env", ".git", ".gradle", ".hg", ".idea", ".maven", ".mypy_cache", ".nox", ".npm", ".nyc_output", ".pnpm-store", ".pytest_cache", ".qdrant_code_embeddings", ".ruff_cache", ".svn", ".tmp", ".tox", ".venv", ".vs", ".vscode", ".yarn",
    "__pycache__", "bin", "bower_components", "build", "coverage", "dist", "env", "htmlcov", "node_modules", "obj", "out", "Pods", "site-packages", "target", "temp", "tmp", "vendor", "venv",
]
IGNORED_SUFFIXES = [".tmp", "~", ".pyc", ".pyo", ".o", ".a", ".so", ".dll", ".class"]


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The directory of a path; `.` for a path of one part."""
    return F.when(F.instr(path, "/") == 0, F.when(path.isNotNull(), ".")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def suffix(path: Column) -> Column:
    """The last extension with its dot; empty for names such as `.bashrc` or `a.`."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def _strings(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def is_below(path: Column, roots: Iterable[str]) -> Column:
    """Whether the path is one of the roots or below one."""
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | path.startswith(r + "/")
    return out


def should_skip(path: Column, is_file: Column | bool = True, exclude: Iterable[str] = (), unignore: Iterable[str] = ()) -> Column:
    """Whether a scan leaves the path out. The first rule that applies decides.

    A file with an ignored suffix goes; then what is excluded by a directory's name, as a path or below one; then what is
    below an unignored path stays; then what is in an ignored directory goes.
    """
    is_file = F.lit(is_file) if isinstance(is_file, bool) else is_file
    parts = F.split(path, "/")
    directories = F.when(is_file, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    out = F.when(path.isNull(), F.lit(None).cast("boolean")).when(is_file & suffix(path).isin(IGNORED_SUFFIXES), True)
    if exclude := list(exclude):
        out = out.when(F.arrays_overlap(directories, _strings(exclude)) | is_below(path, exclude), True)
    if unignore := list(unignore):
        out = out.when(is_below(path, unignore), False)
    return out.otherwise(F.arrays_overlap(directories, _strings(IGNORED_PARTS)))


def module_name(project: Column, path: Column) -> Column:
    """Dotted module name: project and the path without its suffix; `__init__.py` and `mod.rs` give their directory's name."""
    bare = F.regexp_replace(F.regexp_replace(path, r"(^|/)(__init__\.py|mod\.rs)$", ""), r"(?<=[^/])\.[^./]+$", "")
    return F.concat_ws(".", project, F.when(bare != "", F.translate(bare, "/", ".")))


def ignore_file(text: str) -> tuple[list[str], list[str]]:
    """Excluded and unignored paths of an ignore file: `#` begins a comment, `!` unignores."""
    lines = [x.strip() for x in text.splitlines()]
    lines = [x for x in lines if x and not x.startswith("#")]
    return [x for x in lines if not x.startswith("!")], [x[1:].strip() for x in lines if x.startswith("!")]
