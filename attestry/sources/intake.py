"""Reading semi-structured responses and uploaded documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import rules

_SOURCE = "struct<id:string,source_id:string,context_id:string,title:string,app_provider:string>"
_CHUNK = "struct<id:string,source_id:string,chunk_id:string,chunk_content:string,relevancy_score:double>"
_ROOT = f"sources:array<{_SOURCE}>,chunks:array<{_CHUNK}>"
RESPONSE_SCHEMA = f"struct<data:struct<{_ROOT}>,{_ROOT}>"


def _root(df: DataFrame, payload: str) -> DataFrame:
    parsed = df.withColumn("_p", F.from_json(payload, RESPONSE_SCHEMA))
    wrapped = F.get_json_object(payload, "$.data").isNotNull()
    pick = lambda f: F.when(wrapped, F.col(f"_p.data.{f}")).otherwise(F.col(f"_p.{f}"))
    return parsed.withColumns({"_sources": pick("sources"), "_chunks": pick("chunks")}).drop("_p")


def response_sources(df: DataFrame, payload: str, key: str) -> DataFrame:
    """One row per source; a response without sources keeps one row of NULLs."""
    rows = _root(df, payload).select(key, F.posexplode_outer("_sources").alias("pos", "s"))
    ident = F.coalesce("s.id", "s.source_id", "s.context_id")
    return rows.select(key, "pos", ident.alias("source_id"), "s.title", F.lower("s.app_provider").alias("provider"))


def response_chunks(df: DataFrame, payload: str, key: str) -> DataFrame:
    """One row per chunk, in relevance order of the response."""
    rows = _root(df, payload).select(key, F.posexplode("_chunks").alias("pos", "c"))
    return rows.select(
        key, "pos", F.coalesce("c.id", "c.source_id").alias("source_id"), "c.chunk_id", "c.chunk_content",
        "c.relevancy_score",
    )


def classify_document(body: Column, mime: Column, filename: Column, limit: int = rules.MAX_DOCUMENT_BYTES) -> Column:
    """Kind of an uploaded file (BINARY ``body``) or the reason it is refused."""
    size = F.octet_length(body)
    name = F.lower(filename)
    extension = F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(name)
    declared = F.trim(F.substring_index(F.lower(mime), ";", 1))
    is_pdf = F.hex(F.substring(body, 1, 5)) == "255044462D"
    is_text = F.is_valid_utf8(body.cast("string")) & (F.instr(body.cast("string"), "\u0000") == 0)

    def outcome(kind: str | None, reason: Column | str | None) -> Column:
        why = reason if isinstance(reason, Column) else F.lit(reason)
        return F.struct(F.lit(kind).alias("kind"), why.alias("reason"))

    return (
        F.when(size == 0, outcome(None, "The uploaded file is empty."))
        .when(size > limit, outcome(None, f"File exceeds the {limit // (1024 * 1024)} MB limit."))
        .when(
            is_pdf & (declared != "") & ~declared.isin("application/pdf", "application/octet-stream"),
            outcome(None, F.concat(F.lit("File content is a PDF but was declared as "), declared, F.lit("."))),
        )
        .when(is_pdf, outcome("pdf", None))
        .when(
            (declared == "application/pdf") | (extension == "pdf"),
            outcome(None, "File claims to be a PDF but does not begin with the PDF signature."),
        )
        .when(is_text & extension.isin("md", "markdown"), outcome("markdown", None))
        .when(is_text, outcome("text", None))
        .otherwise(outcome(None, "Unsupported file. PDF, Markdown and plain text are accepted."))
    )


def read_documents(spark, path: str) -> DataFrame:
    """Files under ``path`` with their bytes; the listing and the reads are distributed."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
