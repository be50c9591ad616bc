"""Queries and SQL of the text, code and vector problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import encode, functions, leaks, neighbours, pieces, provenance, residue, unparsed


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return unparsed.unparsed(table(spark, d, "code_snippet"))


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    return unparsed.files(table(spark, d, "code_snippet")).where("flagged").drop("flagged")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return unparsed.rates(table(spark, d, "code_snippet"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "code_snippet"), with_text=False).where("piece = 0").select("snippet_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "code_snippet"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(table(spark, d, "code_snippet"))


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    return provenance.beliefs(table(spark, d, "code_snippet")).select("project", "file_path", "label")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_pairs(table(spark, d, "embedding_cache"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return functions.documented_names(table(spark, d, "code_snippet"))


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    return functions.pairs(table(spark, d, "code_snippet"), share=0.002)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = encode.decode(encode.encode(documents)).withColumnRenamed("text", "decoded")
    return documents.join(back, "doc_id").select("doc_id", (F.col("text") == F.col("decoded")).alias("same"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_files, p2_rates, p3_found, p3_pieces, p5_found, p5_labels, p6_found, p7_found, p7_pairs, p8_ids, p8_round_trip, p9_found, p10_found)}

SQL = {
    "p3_found": "select snippet_id from code_snippet where length(source_code) > 6000",
    "p6_found": """with raw as (select cache_id, embedding::double[768] as v from embedding_cache where cache_id is not null and len(embedding) = 768
  and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
near as (select a.cache_id as a, b.cache_id as b, array_cosine_similarity(a.v, b.v) as c from raw a join raw b on a.cache_id <> b.cache_id),
best as (select a, b from (select *, row_number() over (partition by a order by round(c, 12) desc, b) as place from near where c >= 0.8) where place <= 10)
select distinct least(a, b) as cache_id_a, greatest(a, b) as cache_id_b from best""",
    "p8_round_trip": "select doc_id, true as same from documents",
}
