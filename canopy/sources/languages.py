"""Languages by extension, and what is known of their packages and definitions."""

from __future__ import annotations

# File extensions and files that make a directory a package.
EXTENSIONS = {
    "python": [".py"], "javascript": [".js", ".jsx"], "typescript": [".ts", ".tsx"], "rust": [".rs"], "go": [".go"], "scala": [".scala", ".sc"], "java": [".java"],
    "cpp": [".cpp", ".h", ".hpp", ".cc", ".cxx", ".hxx", ".hh", ".ixx", ".cppm", ".ccm"], "c_sharp": [".cs"], "php": [".php"], "lua": [".lua"], "c": [".c"],
}
PACKAGE_FILES = ["__init__.py", "Cargo.toml", "CMakeLists.txt", "Makefile", "conanfile.txt", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "package.json", "go.mod"]
BY_EXTENSION = {e: name for name, es in EXTENSIONS.items() for e in es}


def language_of(path: str | None) -> str | None:
    base = (path or "").rsplit("/", 1)[-1]
    return BY_EXTENSION.get("." + base.rsplit(".", 1)[1]) if "." in base[1:] else None
