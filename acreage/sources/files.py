"""Directories of files: census, upload checks, content manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreage import constants as K
from acreage.functions import text as T

# fixed values: markers of text and image content in a PDF
FONT_MARKS = ["/Font", "/Type /Font", "/BT"]
IMAGE_MARKS = ["/Subtype /Image", "/Filter /DCTDecode"]
IMAGE_SUFFIXES = ["png", "jpg", "jpeg", "tiff", "tif", "bmp", "webp"]
CAD_SUFFIXES = ["dxf", "dwg"]


def read_files(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob)


def census_files(spark: SparkSession, glob: str) -> DataFrame:
    """Format, size, vector and scan flags and the parser to use for each file.

    PDF markers and pages are looked for in the whole file.
    """
    files = read_files(spark, glob)
    body = F.decode("content", "ISO-8859-1")
    any_of = lambda marks: F.greatest(*[F.contains(body, F.lit(m)) for m in marks])
    df = files.withColumn("suffix", T.extension("path")).withColumn("fonts", any_of(FONT_MARKS)).withColumn("images", any_of(IMAGE_MARKS))
    pages = F.greatest(F.lit(1), F.regexp_count(body, F.lit("/Type /Page")))
    pdf, image, cad = F.col("suffix") == "pdf", F.col("suffix").isin(*IMAGE_SUFFIXES), F.col("suffix").isin(*CAD_SUFFIXES)
    parser = (
        F.when(pdf & F.col("fonts"), "DIGITAL_PDF_VECTOR_PARSER").when(pdf & F.col("images"), "RASTER_IMAGE_OPENCV_PARSER")
        .when(pdf, "GENERIC_DOCUMENT_PARSER").when(image, "RASTER_IMAGE_OPENCV_PARSER").when(cad, "CAD_DXF_PARSER").otherwise("UNKNOWN")
    )
    return df.select(
        "path", F.upper("suffix").alias("format"), F.col("length").alias("size_bytes"), F.when(pdf, pages).otherwise(1).alias("pages"),
        ((pdf & F.col("fonts")) | cad).alias("has_vector"), ((pdf & F.col("images") & ~F.col("fonts")) | image).alias("is_scanned"),
        parser.alias("recommended_parser"),
    )


def check_uploads(files: DataFrame, name: str = "file_name", size: str = "size_bytes") -> DataFrame:
    """Safe name and the reason a file may not be uploaded, null when it may."""
    suffix = T.extension(name)
    return files.withColumn("safe_name", T.safe_file_name(name)).withColumn(
        "error",
        F.when(~suffix.isin(*K.UPLOAD_EXTENSIONS), F.concat(F.lit("Unsupported file extension "), suffix))
        .when(F.col(size) > K.UPLOAD_MAX_BYTES, "File exceeds maximum allowed size of 50MB"),
    )


def build_manifest(spark: SparkSession, glob: str) -> DataFrame:
    """SHA-256 of every file."""
    return read_files(spark, glob).select("path", F.sha2("content", 256).alias("sha256"))


def verify_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """OK, MISMATCH or MISSING for every manifest line."""
    have = found.select("path", F.col("sha256").alias("__found"))
    status = F.when(F.col("__found").isNull(), "MISSING").when(F.col("__found") != F.col("sha256"), "MISMATCH").otherwise("OK")
    return manifest.join(have, "path", "left").withColumn("status", status).drop("__found")
