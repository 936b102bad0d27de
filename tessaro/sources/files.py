"""Files as sources: content-addressed binaries and nested transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds of files by their extension.
KINDS = {
    "audio": [".wav", ".mp3", ".m4a", ".flac", ".ogg", ".aac", ".aiff", ".mp4", ".mov"],
    "document": [".pdf", ".docx", ".pptx", ".xlsx", ".html", ".md", ".png", ".jpg", ".jpeg", ".tiff"],
}
#: The schema of one transcript; older files lack speaker and model.
TRANSCRIPT = "model string, language string, duration double, segments array<struct<start: double, end: double, text: string, speaker: int, words: array<struct<start: double, end: double, text: string, speaker: int>>>>"


def content_addressed(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path``, each content once: sha256, name, ext, kind, size_bytes, added_at.

    Of files with equal content the first by path counts; unknown extensions have a null kind.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    kind = F.when(ext.isin(KINDS["audio"]), "audio").when(ext.isin(KINDS["document"]), "document")
    rows = files.select(F.sha2("content", 256).alias("sha256"), "path", name.alias("name"), ext.alias("ext"), kind.alias("kind"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("added_at"))
    first = rows.groupBy("sha256").agg(F.min(F.struct("path", "name", "ext", "kind", "size_bytes", "added_at")).alias("f"))
    return first.select("sha256", "f.name", "f.ext", "f.kind", "f.size_bytes", "f.added_at")


def transcript_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of nested transcript files, one row each: file, seq, start_s, end_s, speaker, text."""
    files = spark.read.schema(TRANSCRIPT).option("multiLine", "true").json(path).select(F.input_file_name().alias("file"), F.posexplode("segments").alias("seq", "s"))
    return files.select(F.element_at(F.split("file", "/"), -1).alias("file"), "seq", F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), "s.speaker", "s.text")
