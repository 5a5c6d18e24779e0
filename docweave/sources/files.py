"""File discovery, dispatch by extension, and text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.ids import file_hash
from docweave.functions.text import is_blank

# Extension to loader.
LOADERS = {
    "pdf": "pdf-cascade",
    "txt": "text",
    "md": "text",
    "html": "html",
    "htm": "html",
    "docx": "office-docx",
    "pptx": "office-pptx",
}
PAGES = "array<struct<number:int,text:string,extractor:string>>"


def extension(name: Column) -> Column:
    """Lower-case suffix of a file name; a leading dot starts no suffix."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*\.([^./]+)\z", 1))


def loader_of(name: Column) -> Column:
    """The loader of a file, null for an unsupported type."""
    ext = extension(name)
    return F.coalesce(*[F.when(ext == e, F.lit(loader)) for e, loader in LOADERS.items()])


def name_pattern() -> str:
    """A glob for the supported endings in any mix of cases, which the scan checks before it opens a file."""
    cases = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ending) for ending in LOADERS]
    return "*.{" + ",".join(cases) + "}"


def discover(spark: SparkSession, target: str) -> DataFrame:
    """(path, filename, content, length) of the supported files below a folder, or of one file.

    `filename` is the path below the folder, so that equal base names in different places stay apart.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = system.makeQualified(place)
    base = whole if system.getFileStatus(whole).isDirectory() else whole.getParent()
    start = len(base.toString().rstrip("/")) + 2
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", name_pattern())
        .load(target)
    )
    name = F.expr(f"substring(path, {start})")
    files = found.select("path", name.alias("filename"), "content", "length")
    bare = F.substring_index("filename", "/", -1)
    return files.where(loader_of(F.col("filename")).isNotNull() & ~bare.startswith("."))


def with_file_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", file_hash(F.col("content")))


def decoded(content: Column) -> Column:
    """UTF-8 text; invalid bytes become visible replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def one_page(text: Column, extractor: str) -> Column:
    """A single page, or null for a blank text."""
    page = F.struct(F.lit(1).alias("number"), text.alias("text"), F.lit(extractor).alias("extractor"))
    return F.when(~is_blank(text), F.array(page)).cast(PAGES)


def load_text(files: DataFrame) -> DataFrame:
    """Adds pages and error for text and Markdown files."""
    text = decoded(F.col("content"))
    loaded = files.withColumn("pages", one_page(text, "builtin"))
    message = F.concat(F.lit("extraction failed: "), F.col("filename"), F.lit(" is empty."))
    return loaded.withColumn("error", F.when(F.col("pages").isNull(), message))
