"""Generated, minified, vendored files and data blobs, by belief propagation over directory trees.

Files are told apart by (`project`, `file_path`); of repeated rows the longest text counts. A file without the text of a
Module row is judged by its parts (rows of other labels), whose evidence is averaged by length. Rows that weren't found, or
whose path is null or empty, are no files; a null or empty text has only its path as evidence; a null project is a project
of its own. Extra columns are dropped; an empty table gives an empty result.

Every file and every directory on its path has a hidden label. A file's text and name give log evidence for each label; a
directory's name shifts the compatibility with its parent, so it says what is below it and nothing of what it stands in. On
the tree of directories the messages go once up and once down, which is exact: a file without any evidence of its own is
labelled by its siblings, its directory, and what stands beside and above that. A directory without a telling name that
holds nothing but one directory is one with that: how deep a path is says nothing.

Trees can be deep, so messages don't go level by level. Each directory goes on in its largest subdirectory; the paths this
makes are chains of no more directories than a file's path has, and from a file to the root there are at most log2(n) of
them. Each round passes the messages along whole paths, one row each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.arrow import map_rows
from canopy.session import cut

LABELS = ["handwritten", "generated", "minified", "vendored", "blob"]
#: Of the root of a project: that all of it is somebody else's or made by a tool is next to impossible.
PRIOR = [0.999996, 1e-6, 1e-6, 1e-6, 1e-6]
#: Probability of a child's label (column) under its directory's (row), for directories and for files.
TO_DIRECTORY = [[0.996, 0.001, 0.001, 0.001, 0.001], [0.004, 0.98, 0.005, 0.006, 0.005], [0.3, 0.03, 0.65, 0.01, 0.01], [0.002, 0.004, 0.01, 0.98, 0.004], [0.3, 0.02, 0.01, 0.01, 0.66]]
TO_FILE = [[0.93, 0.025, 0.015, 0.02, 0.01], [0.04, 0.93, 0.01, 0.01, 0.01], [0.45, 0.04, 0.48, 0.02, 0.01], [0.02, 0.01, 0.02, 0.94, 0.01], [0.45, 0.02, 0.01, 0.01, 0.51]]

# Directory names with the log evidence they give for (generated, minified, vendored).
DIRECTORIES = {
    **dict.fromkeys(["node_modules", "bower_components", "jspm_packages", "third_party", "third-party", "thirdparty", "_vendored", "_vendor", "vendored", "vendor", "vendors", "site-packages", "dist-packages", "godeps"], (0.0, 0.0, 13.0)),
    **dict.fromkeys(["external", "externals", "deps", "extern", "3rdparty", "contrib"], (0.0, 0.0, 11.0)),
    **dict.fromkeys(["__generated__", "generated", "_generated", "autogen", "generated-src", "generated_sources", "codegen", "gen", "gensrc", "pb", "proto_gen"], (11.0, 0.0, 0.0)),
    **dict.fromkeys(["dist", "bundles", "min", "public", "static", "assets"], (0.0, 3.0, 0.0)),
    "build": (1.0, 2.0, 0.0),
}
# File names.
_GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.\w+)?\.\w+|_pb\.\w+|\.g\.\w+|\.gen\.\w+|_gen\.\w+|\.generated\.\w+|_generated\.\w+|\.designer\.\w+|_autogen\.\w+|zz_generated\w*\.\w+|\.gr\.\w+)$", re.I)
_MINIFIED_NAME = re.compile(r"(?:[.-]min\.\w+|\.bundle\.\w+|\.chunk\.\w+|-[0-9a-f]{8,}\.\w+)$", re.I)
# What the comment at the head of a generated file or a copy says.
_GENERATED = re.compile(
    r"^\W*(?:<auto-generated>|@generated\b|auto-?generated\b|automatically (?:generated|produced|created)|(?:code |file |source )?generated (?:by|from|with|using|on|automatically)\b|(?:this|the) (?:file|code|module|source|class) (?:is|was|has been) (?:auto-?|automatically |machine-?)?(?:generated|produced|created|emitted|written by)\b(?: automatically| by| from)?"
    r"|do not (?:edit|modify|change|touch)\b|don't (?:edit|modify)\b|(?:emitted|produced|created|written) (?:automatically )?by [\w./-]+ (?:on|from|at|v)|machine[- ]generated|warning:? (?:this file|generated|do not)|edits? to this file will|(?:any |all )?(?:manual )?changes (?:made )?(?:to this file |here )?will be (?:lost|overwritten))|code generated by .{1,60}do not edit|\bdo not edit\W*$",
    re.I,
)
_VENDORED = re.compile(
    r"^\W*(?:third-party (?:source|code|library|module)|bundled (?:copy|version|release) of|vendored (?:copy|from|version|source)|(?:copied|imported|taken|mirrored|vendored|adapted verbatim) from (?:the )?(?:upstream|original|[\w.-]+ ?(?:v|@)?\d)|(?:this is )?(?:an? )?(?:unmodified |verbatim |local )?copy of (?:the )?[\w-]+ (?:v|@)?\d|upstream:|[\w.-]+(?: |@)v?\d+\.\d+(?:\.\d+)?,? (?:distributed|released|licensed|available) under|copyright (?:\(c\) |© )?(?:\d{4}(?:-\d{4})? )?the [\w .-]+ (?:contributors|authors|developers|project)\b|(?:see|from) upstream\b)",
    re.I,
)
_QUOTED = re.compile(r"'[^'\n]*'|\"[^\"\n]*\"|`[^`\n]*`|“[^”\n]*”")
_HEAD = re.compile(r"(?:\s+|#![^\n]*\n|//[^\n\r]*|#(?!\[)[^\n\r]*|--\[\[.*?\]\]|--[^\n\r]*|/\*.*?\*/|\"\"\".*?\"\"\"|'''.*?'''|<!--.*?-->)*", re.S)
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|\[\[.*?\]\]|(?<![\w.])-?(?:0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)(?!\w)", re.S)
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_REMARKS = re.compile(r"^[ \t]*(?://|#(?!\[)|--)[^\n\r]*", re.M)
_STATEMENT = re.compile(r"\b(?:def|return|if|for|while|function|class|func|end|switch|try|throw|import|public|private)\b")


def evidence(path: str, text: str | None) -> list[float]:
    """Log evidence of a file for each label."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    out = [0.0] * len(LABELS)
    if _GENERATED_NAME.search(name):
        out[1] += 5
    if _MINIFIED_NAME.search(name):
        out[2] += 3
    if not text or not text.strip():
        return out
    head = _HEAD.match(text).group()
    lines = [_QUOTED.sub(" ", x).strip(" \t/*#-!;") for x in re.split(r"[\r\n]+", head)]
    if any(_GENERATED.search(x) for x in lines):
        out[1] += 9
    if any(_VENDORED.search(x) for x in lines):
        out[3] += 9
    body = text[len(head) :] if not head.startswith('"""') or len(head) < len(text) else text
    body = _REMARKS.sub("", body)
    solid = len(body) - body.count(" ") - body.count("\n") - body.count("\t") - body.count("\r")
    if solid < 80:
        return out
    if not any(out):
        # Ordinary code: what others wrote by hand looks much the same, but for the notice it often has.
        out[1:] = [-1.0, -2.0, -0.35, -2.0]
    literals = _LITERAL.findall(body)
    share = sum(map(len, literals)) / max(1, len(body))
    bare = _LITERAL.sub("0", body)
    code = len(_STATEMENT.findall(bare))
    longest = sum(len(x) for x in body.splitlines() if len(x) > 400) / len(body)
    if len(literals) >= 12 and code <= 2 + len(literals) // 25 and len(_WORD.findall(bare)) <= 12 + 0.5 * len(literals) and share > 0.45:
        out = [max(x, 0.0) for x in out]
        out[4] += 8
    elif sum(map(len, literals)) > 0.9 * solid and solid > 400 and code <= 3:
        out = [max(x, 0.0) for x in out]
        out[4] += 8
    elif longest > 0.6:
        found = _WORD.findall(bare)
        tight = 1 - solid / len(body)
        short = sum(len(w) <= 2 for w in found) / max(1, len(found))
        if tight < 0.14 and (short > 0.3 or code >= 3):
            out = [max(x, 0.0) for x in out]
            out[2] += 9
    return out


def _id(project: str | None, directory: str) -> int:
    return xxhash.xxh64_intdigest(f"{'' if project is None else 'p' + project}\0{directory}") - (1 << 63)


def chain(project: str | None, path: str) -> list[tuple[int, list[float]]]:
    """The file's directories from its own up to the root: id and the name's log evidence."""
    parts = [p for p in path.replace("\\", "/").split("/")[:-1] if p not in ("", ".")]
    out = []
    for i in range(len(parts), -1, -1):
        g, m, v = DIRECTORIES.get(parts[i - 1].lower(), (0.0, 0.0, 0.0)) if i else (0.0, 0.0, 0.0)
        out.append((_id(project, "/".join(parts[:i])), [0.0, g, m, v, 0.0]))
    return out


def observations(df: DataFrame, text: str = "source_code") -> DataFrame:
    """(`project`, `file_path`, `part`, `weight`, `seen`, `dirs`, `named`) of each row: evidence, and the chain of directories.

    `part` is null for Module rows and the text's hash for others, so that repeated rows count once.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        weight, seen, dirs, named = [], [], [], []
        for p, f, _, t in zip(*(c.to_pylist() for c in batch.columns)):
            up = chain(p, f)
            weight.append(len(t or ""))
            seen.append(evidence(f, t))
            dirs.append([d for d, _ in up])
            named.append([x for _, e in up for x in e])
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64()), pa.array(seen, pa.list_(pa.float64())), pa.array(dirs, pa.list_(pa.int64())), pa.array(named, pa.list_(pa.float64()))], ["project", "file_path", "part", "weight", "seen", "dirs", "named"])

    rows = df.where("found and file_path is not null and trim(file_path) <> ''").select(
        "project", "file_path", F.when(F.col("label").eqNullSafe("Module"), None).otherwise(F.coalesce(F.md5(text), F.lit(""))).alias("part"), text
    )
    return map_rows(rows, run, "project string, file_path string, part string, weight bigint, seen array<double>, dirs array<bigint>, named array<double>", 256)


def _message(vector: list[Column], table: list[list[float]], down: bool = False) -> list[Column]:
    """Log message through a compatibility table; `down` from the directory to the child."""
    top = F.greatest(*vector)
    share = [F.exp(v - top) for v in vector]
    n = range(len(LABELS))
    return [top + F.log(sum((share[j] * F.lit(table[j][i] if down else table[i][j]) for j in n), F.lit(0.0))) for i in n]


def _columns(name: str) -> list[Column]:
    return [F.col(f"{name}{i}") for i in range(len(LABELS))]


def _through(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log of exp(x) @ table for the rows of `x`."""
    top = x.max(1, keepdims=True)
    return top + np.log(np.exp(x - top) @ table)


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A list column as rows of equal length, and the lengths in items of `width` numbers."""
    n = np.asarray(column.value_lengths()) // width
    out = np.zeros((len(n), n.max(initial=0), width))
    out[np.arange(out.shape[1]) < n[:, None]] = np.asarray(column.flatten()).reshape(-1, width)
    return out, n


def _lists(x: np.ndarray, n: np.ndarray) -> pa.Array:
    flat = x[np.arange(x.shape[1]) < n[:, None]].ravel()
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n * x.shape[2])]), pa.int32()), pa.array(flat))


def _upwards(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(`up`, `dirs`, `e`, `u`) of paths from their top: what each directory hears from below is added to `u`; and what the top sends."""
    k, to = len(LABELS), np.array(TO_DIRECTORY).T
    e, n = _padded(batch.column("e"), k)
    u, _ = _padded(batch.column("u"), k)
    sent = np.zeros((len(n), k))
    for i in range(u.shape[1] - 1, -1, -1):
        on = n > i
        u[on, i] += np.where((n == i + 1)[on, None], 0.0, sent[on])
        # The name's shift is divided by what it sums to, which leaves the parent's belief alone.
        sent[on] = _through(u[on, i] + e[on, i], to) - _through(e[on, i], to)
    return pa.RecordBatch.from_arrays([batch.column("up"), batch.column("dirs"), batch.column("e"), _lists(u, n), _lists(sent[:, None], np.ones(len(n), int))], ["up", "dirs", "e", "u", "sent"])


def _downwards(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(`dirs`, `b`): belief of each directory on the paths, whose top hears `heard` from above (without its own word)."""
    k, table = len(LABELS), np.array(TO_DIRECTORY)
    e, n = _padded(batch.column("e"), k)
    u, _ = _padded(batch.column("u"), k)
    heard, _ = _padded(batch.column("heard"), k)
    root = np.asarray(batch.column("up").is_null())
    b = np.zeros_like(u)
    for i in range(u.shape[1]):
        on = n > i
        own = _through(u[on, i] + e[on, i], table.T) - _through(e[on, i], table.T)
        above = heard[on, 0] if i == 0 else b[on, i - 1] - own
        down = _through(above - _through(e[on, i], table.T), table) + e[on, i]
        b[on, i] = u[on, i] + (np.where(root[on, None], np.log(PRIOR), down) if i == 0 else down)
    return pa.RecordBatch.from_arrays([batch.column("dirs"), _lists(b, n)], ["dirs", "b"])


def _tree(files: DataFrame) -> tuple[DataFrame, int]:
    """(`dir`, `up`, `head`, `turns`, `level`, `e`) of each directory: its path by the top one, and the turns from the root to it."""
    size = F.size("dirs")
    cells = files.select("dirs", "named").distinct().select(F.col("dirs")[0].alias("own"), "dirs", "named", F.explode(F.sequence(F.lit(0), size - 1)).alias("k"))
    cells = cut(cells.select("own", (size - 1 - F.col("k")).alias("level"), F.col("dirs")[F.col("k")].alias("dir"), F.try_element_at("dirs", F.col("k") + 2).alias("up"), F.slice("named", F.col("k") * len(LABELS) + 1, len(LABELS)).alias("e")))
    sizes = cells.where("up is not null").groupBy("up", "dir").agg(F.count("*").alias("n"))
    heavy = sizes.groupBy("up").agg(F.max_by("dir", F.struct("n", "dir")).alias("heavy"))
    turn = F.col("up").isNotNull() & (F.col("heavy") != F.col("dir"))
    below = Window.partitionBy("own").orderBy("level")
    tree = cells.join(heavy, "up", "left").select("own", "dir", "up", "level", "e", turn.alias("turn"))
    tree = tree.select("dir", "up", "level", "e", F.sum(F.col("turn").cast("int")).over(below).alias("turns"), F.last(F.when(F.col("turn") | F.col("up").isNull(), F.col("dir")), True).over(below).alias("head"))
    tree = cut(tree.distinct())
    return tree, tree.agg(F.max("turns")).first()[0] or 0


def _contracted(files: DataFrame) -> DataFrame:
    """`files` with `dirs` and `named` without the directories that only lead to one other."""
    paths = cut(files.select("dirs", "named").distinct())
    own = F.col("dirs")[0]
    steps = paths.select(own.alias("own"), "dirs", "named", F.posexplode("dirs").alias("k", "dir"))
    telling = F.exists(F.slice("named", F.col("k") * len(LABELS) + 1, len(LABELS)), lambda x: x != 0)
    links = steps.select("dir", F.when(F.col("k") > 0, F.col("dirs")[F.col("k") - 1]).alias("child"), telling.alias("telling"), (F.size("dirs") - 1 == F.col("k")).alias("root")).distinct()
    # A null child is a file. Directories with many children are counted in part before they are shuffled.
    kept = links.groupBy("dir").agg(F.bool_or(F.col("telling") | F.col("root") | F.col("child").isNull()).alias("kept"), F.count("child").alias("n")).where("kept or n > 1").select("dir")
    level = F.struct("k", "dir", F.slice("named", F.col("k") * len(LABELS) + 1, len(LABELS)).alias("e"))
    left = steps.select("own", "dir", level.alias("s")).join(kept, "dir").groupBy("own").agg(F.sort_array(F.collect_list("s")).alias("s"))
    left = left.select("own", F.col("s.dir").alias("dirs"), F.flatten("s.e").alias("named"))
    return files.withColumn("own", own).drop("dirs", "named").join(left, "own").drop("own")


def beliefs(df: DataFrame) -> DataFrame:
    """(`project`, `file_path`, `label`, `probability`): the likeliest label of each file."""
    n = range(len(LABELS))
    rows = observations(df).groupBy("project", "file_path", "part").agg(F.max("weight").alias("weight"), F.max_by("seen", "weight").alias("seen"), F.first("dirs").alias("dirs"), F.first("named").alias("named"))
    # Rows without text have only the path's evidence, which all rows of a file share.
    weight = F.when(F.col("part").isNotNull(), F.col("weight").cast("double"))
    mean = F.array(*(F.coalesce(F.try_divide(F.sum(weight * F.col("seen")[i]), F.sum(weight)), F.max(F.col("seen")[i])) for i in n))
    whole = F.max_by("seen", F.when(F.col("part").isNull() & (F.col("weight") > 0), F.col("weight")))
    files = rows.groupBy("project", "file_path").agg(F.coalesce(whole, mean).alias("seen"), F.first("dirs").alias("dirs"), F.first("named").alias("named"))
    files = cut(_contracted(cut(files)))
    vectors = files.select("project", "file_path", F.col("dirs")[0].alias("dir"), *(F.col("seen")[i].alias(f"s{i}") for i in n))
    lift = _message(_columns("s"), TO_FILE)
    vectors = vectors.select("project", "file_path", "dir", *_columns("s"), *(m.alias(f"m{i}") for i, m in enumerate(lift)))

    below = vectors.groupBy("dir").agg(F.array(*(F.sum(f"m{i}") for i in n)).alias("f"))
    tree, deepest = _tree(files)
    zero = F.array(*(F.lit(0.0) for _ in n))
    add = lambda x, y: F.zip_with(x, F.coalesce(y, zero), lambda p, q: p + q)
    tree = cut(tree.join(below, "dir", "left").withColumn("u", F.coalesce("f", zero)).drop("f"))
    numbers = "array<double>"
    raised: list[DataFrame] = []
    for turns in range(deepest, -1, -1):
        here = tree.where(F.col("turns") == turns)
        if raised:
            sent = raised[-1].groupBy(F.col("up").alias("dir")).agg(F.array(*(F.sum(F.col("sent")[i]) for i in n)).alias("m"))
            here = here.join(sent, "dir", "left").withColumn("u", add(F.col("u"), F.col("m")))
        rows = here.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("level", "dir", "up", "e", "u"))).alias("s"))
        rows = rows.select(F.col("s")[0]["up"].alias("up"), F.col("s.dir").alias("dirs"), F.flatten("s.e").alias("e"), F.flatten("s.u").alias("u"))
        raised.append(cut(map_rows(rows, _upwards, f"up bigint, dirs array<bigint>, e {numbers}, u {numbers}, sent {numbers}", 4096)))
    raised.reverse()

    # Downwards: what the top of a path hears from the directory it hangs on, without what it said itself.
    done = known = None
    for paths in raised:
        if known is None:
            rows = paths.withColumn("heard", zero)
        else:
            rows = paths.join(known.withColumnRenamed("dir", "up"), "up").withColumn("heard", F.zip_with("b", "sent", lambda p, q: p - q))
        beliefs_ = map_rows(rows.select("up", "dirs", "e", "u", "heard"), _downwards, f"dirs array<bigint>, b {numbers}", 4096)
        known = cut(beliefs_.select(F.posexplode("dirs").alias("k", "dir"), "b").select("dir", F.slice("b", F.col("k") * len(LABELS) + 1, len(LABELS)).alias("b")))
        done = known if done is None else done.unionByName(known)
    done = done.select("dir", *(F.col("b")[i].alias(f"b{i}") for i in n))

    joined = vectors.join(done, "dir")
    without = [F.col(f"b{i}") - F.col(f"m{i}") for i in n]
    final = joined.select("project", "file_path", *((F.col(f"s{i}") + d).alias(f"p{i}") for i, d in enumerate(_message(without, TO_FILE, True))))
    top = F.greatest(*_columns("p"))
    total = sum((F.exp(c - top) for c in _columns("p")), F.lit(0.0))
    return final.select("project", "file_path", F.element_at(F.array(*map(F.lit, LABELS)), (F.array_position(F.array(*_columns("p")), top)).cast("int")).alias("label"), (1 / total).alias("probability"))


def not_handwritten(df: DataFrame) -> DataFrame:
    """Distinct (`project`, `file_path`) of the files that aren't handwritten."""
    return beliefs(df).where("label <> 'handwritten'").select("project", "file_path")
