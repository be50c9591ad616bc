"""Labels, keys and edge types of the property graph, and the column layout of its two tables."""

from __future__ import annotations

# Unique key of each label; edge types.
KEYS = {
    "Project": "name", "Package": "qualified_name", "Folder": "path", "File": "path", "Module": "qualified_name", "Class": "qualified_name", "Function": "qualified_name", "Method": "qualified_name", "Interface": "qualified_name",
    "Enum": "qualified_name", "Type": "qualified_name", "Union": "qualified_name", "ModuleInterface": "qualified_name", "ModuleImplementation": "qualified_name", "ExternalPackage": "name",
}
EDGE_TYPES = ["CONTAINS_PACKAGE", "CONTAINS_FOLDER", "CONTAINS_FILE", "CONTAINS_MODULE", "DEFINES", "DEFINES_METHOD", "IMPORTS", "EXPORTS", "EXPORTS_MODULE", "IMPLEMENTS_MODULE", "INHERITS", "IMPLEMENTS", "OVERRIDES", "CALLS", "DEPENDS_ON_EXTERNAL"]

NODES = "node_id bigint, labels array<string>, properties map<string,string>, project string"
EDGES = "rel_id bigint, from_id bigint, to_id bigint, type string, properties map<string,string>"


def key_of(label: str) -> str:
    if label not in KEYS:
        raise ValueError(f"unknown label {label}")
    return KEYS[label]
