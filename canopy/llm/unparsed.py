"""Source files that do not parse, with position and cause, and their rates.

A file is a (`project`, `file_path`) with a Module row; a null project is a project of its own, rows without a path are no
files. Null, empty and blank texts are valid, texts of unknown languages are not judged. Repeated rows give one file; it is
flagged if any of its rows is. Extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.arrow import map_rows
from canopy.llm.syntax.check import diagnose, language_of

# Messages that say that a source could not be parsed, and those that speak of reading it.
_PARSE = re.compile(
    r"\bpars(?:e|ed|er|ing)\b|syntax|\bunexpected (?:token|end|indent|eof|character|symbol|identifier|keyword)|\bunterminated|\bunbalanced|\bunclosed|\bunmatched|\bmismatched|merge (?:conflict|marker)|conflict marker|\bexpected\b.{0,40}\b(?:but|got|near|before|after|found|at line|indented)|\bindentation|\binvalid (?:token|character in identifier|non-printable)|\bnever closed|\btokeni[sz]e|\bEOF while|\bmissing (?:closing|bracket|brace|paren|semicolon|colon)|\btree-sitter|\bERROR nodes?|\bgrammar",
    re.I,
)
_READ = re.compile(r"codec|decode|permission|\berrno\b|no such file|not found|missing location|past the end|timed? ?out|stale cache|slow read|cannot open|could not (?:open|read|be (?:found|located|opened|read|reached))|connection|unreachable|too large|line range", re.I)


_NAMES = re.compile(r"'[^']*'|[\w.-]+/[\w./-]+")


def says_unparsed(message: str | None) -> bool:
    text = _NAMES.sub(" ", message or "")
    return bool(_PARSE.search(text) and not _READ.search(text))


def judged(df: DataFrame, project: str = "project", path: str = "file_path", source: str = "source_code", message: str = "error_message") -> DataFrame:
    """(`project`, `file_path`, `language`, `flagged`, `line`, `column`, `cause`) of each Module row with a path."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        languages, flags, lines, columns, causes = [], [], [], [], []
        for f, s, m in zip(*(c.to_pylist() for c in batch.columns[1:])):
            language = language_of(f)
            found = diagnose(s, language) if language and s else None
            if not found and says_unparsed(m):
                found = (None, None, "reported")
            languages.append(language)
            flags.append(found is not None)
            for out, x in zip((lines, columns, causes), found or (None, None, None)):
                out.append(x)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(languages, pa.string()), pa.array(flags, pa.bool_()), pa.array(lines, pa.int32()), pa.array(columns, pa.int32()), pa.array(causes, pa.string())], ["project", "file_path", "language", "flagged", "line", "column", "cause"])

    rows = df.where(f"label = 'Module' and `{path}` is not null and trim(`{path}`) <> ''").select(F.col(project).alias("project"), F.col(path).alias("file_path"), source, message)
    return map_rows(rows, run, "project string, file_path string, language string, flagged boolean, line int, column int, cause string", 128)


def files(df: DataFrame) -> DataFrame:
    """One row a file, with the first failure by position where there are several."""
    first = F.min(F.when(F.col("flagged"), F.struct("line", "column", "cause")))
    return judged(df).groupBy("project", "file_path").agg(F.first("language").alias("language"), F.max("flagged").alias("flagged"), first.alias("at")).select("project", "file_path", "language", "flagged", "at.line", "at.column", "at.cause")


def unparsed(df: DataFrame) -> DataFrame:
    return judged(df).where("flagged").select("project", "file_path").distinct()


def rates(df: DataFrame) -> DataFrame:
    """Files, unparsed files and their share per project and language."""
    counts = files(df).groupBy("project", "language").agg(F.count("*").alias("n_files"), F.sum(F.col("flagged").cast("long")).alias("n_unparsed"))
    return counts.withColumn("rate", F.col("n_unparsed") / F.col("n_files"))
