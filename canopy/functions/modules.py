"""Which module an imported name belongs to, by its spelling alone. Null names and languages give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of standard libraries that are spelt like modules and still are no modules.
CPP_ENTITIES = ["vector", "string", "map", "set", "list", "deque", "unique_ptr", "shared_ptr", "weak_ptr", "thread", "mutex", "condition_variable", "future", "promise", "sort", "find", "copy", "transform", "accumulate"]
LUA_MODULES = ["string", "math", "table", "os", "io", "debug", "package", "coroutine", "utf8", "bit32"]
JAVA_ENDINGS = ["Exception", "Error", "Interface", "Builder"]

#: What stands between the parts of a name.
SEPARATORS = {"go": "/", "rust": "::", "cpp": "::"}


def _ends(full: Column, mark: str) -> tuple[Column, Column]:
    """What stands before and behind the last mark."""
    parts = F.split(full, mark.replace(".", r"\."))
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), mark), F.element_at(parts, -1)


def entity_module(full: Column, language: Column, known: Column | None = None) -> Column:
    """The module of an imported full name: the name itself, or what stands before its last part if that is an entity.

    `known` says that a definition of the files has the name, which makes it one. Otherwise spelling decides, by language:
    JavaScript and TypeScript always name an entity last; Rust does unless the part has an underscore and is not all in
    capitals; C++ only below `std`; Go, Java, Lua and the others if the part begins with a capital, with the lists above.
    A name of one part stays.
    """
    out = None
    for name in ("javascript", "typescript", "rust", "cpp", "go", "java", "lua", "other"):
        mark = SEPARATORS.get(name, ".")
        before, last = _ends(full, mark)
        capital = last.rlike(r"^\p{Lu}")
        spelt = {
            "javascript": F.lit(True),
            "typescript": F.lit(True),
            "rust": capital | (F.upper(last) == last) & last.rlike(r"\p{L}") | ((F.lower(last) == last) & last.rlike(r"\p{L}") & ~last.contains("_")),
            "cpp": full.startswith("std::") & (capital | last.rlike("^(is_|has_)") | last.isin(CPP_ENTITIES)),
            "java": capital | last.rlike(f"({'|'.join(JAVA_ENDINGS)})$"),
            "lua": capital | last.isin(LUA_MODULES),
        }.get(name, capital)
        entity = spelt if known is None else spelt | F.coalesce(known, F.lit(False))
        value = F.when(full.contains(mark) & entity, before).otherwise(full)
        test = language == name if name != "other" else language.isNotNull()
        out = F.when(test, value) if out is None else out.when(test, value)
    return out
