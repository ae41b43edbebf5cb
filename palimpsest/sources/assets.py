"""Files as rows: size, digest, kind and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Leading bytes, kind and media type, tested in this order.
MAGIC = (
    ("255044462D", "pdf", "application/pdf"),
    ("89504E470D0A1A0A", "png", "image/png"),
    ("FFD8FF", "jpeg", "image/jpeg"),
)
DOCX_MEDIA = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
# Default limits for files and pictures.
MAX_BYTES = 100 * 1024 * 1024
MAX_SIDE, MAX_PIXELS, MAX_FRAMES = 20_000, 40_000_000, 100
SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def scan_assets(spark: SparkSession, path: str, name_glob: str | None = None) -> DataFrame:
    """Whole files below a folder with size and digest. The file source lists no empty files;
    they are rejected where rows come from elsewhere, such as an upload log."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return describe(reader.load(path))


def describe(files: DataFrame) -> DataFrame:
    """Add name, size, digest and kind to binary-file rows; the content itself is dropped."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", name.alias("name"), F.col("length").alias("size_bytes"), "modificationTime",
        F.sha2("content", 256).alias("sha256"), *kind_columns(F.col("content"), name))


def kind_columns(content: Column, name: Column) -> list[Column]:
    """Kind and media type from the leading bytes; a zip needs the docx suffix. Unknown content gives null."""
    def starts(prefix: str) -> Column:
        return F.startswith(content, F.lit(bytes.fromhex(prefix)))

    docx = starts("504B0304") & F.endswith(F.lower(name), F.lit(".docx"))
    webp = starts("52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    rules = [(starts(prefix), kind, media) for prefix, kind, media in MAGIC]
    rules += [(docx, "docx", DOCX_MEDIA), (webp, "webp", "image/webp")]
    kind, media = F.lit(None).cast("string"), F.lit(None).cast("string")
    for cond, k, m in reversed(rules):
        kind, media = F.when(cond, k).otherwise(kind), F.when(cond, m).otherwise(media)
    return [kind.alias("kind"), media.alias("media_type")]


def admission(size: Column, kind: Column, max_bytes: int = MAX_BYTES) -> Column:
    return (F.when(size > max_bytes, "RESOURCE_LIMIT").when(size == 0, "INVALID_FILE")
            .when(kind.isNull(), "UNSUPPORTED_FORMAT").otherwise("OK"))


def admit(assets: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Admitted rows, and rejects with their code."""
    coded = assets.withColumn("code", admission(F.col("size_bytes"), F.col("kind"), max_bytes))
    return coded.filter("code = 'OK'").drop("code"), coded.filter("code <> 'OK'")


def image_limits(declared: Column, sniffed: Column, width: Column, height: Column, frames: Column,
                 side: int = MAX_SIDE, pixels: int = MAX_PIXELS, max_frames: int = MAX_FRAMES) -> Column:
    """First limit a picture breaks."""
    return (F.when(~declared.eqNullSafe(sniffed), "FORMAT_MISMATCH").when((width <= 0) | (height <= 0), "INVALID_IMAGE")
            .when((width > side) | (height > side), "RESOURCE_LIMIT_SIDE")
            .when(width * height > pixels, "RESOURCE_LIMIT_PIXELS").when(frames > max_frames, "RESOURCE_LIMIT_FRAMES")
            .otherwise("OK"))


def artifact_role(path: Column, media_type: Column) -> tuple[Column, Column]:
    """Role and page number from the path: previews lie in a source or result folder, all else is output."""
    side = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    preview = (media_type == "image/png") & side.isin("source", "result")
    page = F.regexp_extract(stem, r"-([^-]*)$", 1).try_cast("int")
    role = F.when(preview & (side == "source"), "source_preview").when(preview, "result_preview").otherwise("output")
    return role, F.when(preview, page)
