"""The ingestion job: files to vector table, with a state table that makes it incremental."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.config import Settings
from docweave.operators import chunking, cleaning, dedup, embedding, manifest, store
from docweave.operators.skew import keep_only
from docweave.plans.sinks import PlainFiles, Versioned
from docweave.session import ship, stages, written
from docweave.sources import files as fs
from docweave.sources import html, json_state, office

OK, NOTHING_FOUND, UNUSABLE, SOME_FAILED = 0, 1, 2, 3


@dataclass(frozen=True)
class Modes:
    wipe: bool = False
    force: bool = False
    dry_run: bool = False
    limit: int | None = None


def load(files: DataFrame, pdf=None) -> DataFrame:
    """Adds loader, pages and error. Each format is loaded on its own rows only.

    pdf is an optional function that adds pages and error to PDF files, and may add warnings; without it they fail.
    A file that cannot be read is a row with an error, never a failed job.
    """
    known = files.withColumn("loader", fs.loader_of(F.col("filename")))

    def of(*loaders: str) -> DataFrame:
        return known.where(F.col("loader").isin(*loaders))

    no_pages = F.lit(None).cast(fs.PAGES)
    unsupported = known.where(F.col("loader").isNull()).withColumns(
        {"pages": no_pages, "error": F.concat(F.lit("unsupported file type: "), F.col("filename"))}
    )
    no_engine = F.concat(F.lit("extraction failed: no PDF engine for "), F.col("filename"))
    pdfs = pdf(of("pdf-cascade")) if pdf else of("pdf-cascade").withColumns({"pages": no_pages, "error": no_engine})
    parts = [fs.load_text(of("text")), html.load_html(of("html")), office.load_office(of("office-docx", "office-pptx"))]
    loaded = unsupported
    for part in [*parts, pdfs]:
        loaded = loaded.unionByName(part, allowMissingColumns=True)
    return loaded


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The stored state; an empty one if there is none."""
    if store.table_exists(spark, path):
        return spark.read.schema(manifest.SCHEMA).parquet(path)
    return spark.createDataFrame([], manifest.SCHEMA)


def run(
    spark: SparkSession,
    files: DataFrame,
    store_path: str,
    manifest_path: str,
    modes: Modes = Modes(),
    settings: Settings | None = None,
    backend: embedding.Backend = embedding.BUILTIN,
    cache: DataFrame | None = None,
    snapshot_path: str | None = None,
    pdf=None,
) -> tuple[int, DataFrame]:
    """`run_into` with points and state as plain parquet folders, both rewritten by every run."""
    sink = PlainFiles(spark, store_path, manifest_path)
    return run_into(sink, files, modes, settings, backend, cache, snapshot_path, pdf)


def run_into(
    sink: Versioned | PlainFiles,
    files: DataFrame,
    modes: Modes = Modes(),
    settings: Settings | None = None,
    backend: embedding.Backend = embedding.BUILTIN,
    cache: DataFrame | str | None = None,
    snapshot_path: str | None = None,
    pdf=None,
) -> tuple[int, DataFrame]:
    """Ingests (filename, content) rows; returns the exit code and the new state table.

    Stages that several later steps read are written once: the loaded and cleaned documents, the chunks, and their vectors.
    A file that cannot be loaded, chunked or embedded is a record with an error; the others go on, and what the table
    held of it before stays. `cache` holds known vectors by key: a table, or the name of one in a versioned sink, to
    which the new vectors are then committed. Points and state are saved last, by one call of the sink.
    """
    settings = settings or Settings()
    problems = settings.problems("job")
    if problems:
        raise ValueError("; ".join(problems))
    with stages(files.sparkSession, "records"):
        return _run(sink, files, modes, settings, backend, cache, snapshot_path, pdf)


def _run(sink, files, modes, settings, backend, cache, snapshot_path, pdf) -> tuple[int, DataFrame]:
    spark = files.sparkSession
    nothing = spark.createDataFrame([], manifest.SCHEMA)
    if modes.limit:
        first = files.select("filename").orderBy("filename").limit(modes.limit)  # names only: contents stay
        files = files.join(first, "filename", "left_semi")
    hashed = fs.with_file_hash(files)
    names = written(dedup.canonical_names(hashed.select("filename", "file_hash"), "file_hash", "filename"), "names")
    if names.isEmpty():
        return NOTHING_FOUND, nothing
    try:
        sink.open(backend.dim, modes.wipe)
    except store.DimensionMismatch:
        return UNUSABLE, nothing

    # The state is read once and kept, because it is replaced at the end.
    state = written(nothing if modes.wipe else sink.state(), "state")
    decided = manifest.skip_decision(names, state, 0 if modes.dry_run else backend.dim)
    due = ~F.col("is_duplicate") & (F.lit(modes.force) | ~F.col("skip"))
    decided = written(decided.select("filename", due.alias("due")), "decided")
    todo = keep_only(hashed, decided.where("due"), decided.where("not due"), "filename")

    documents = written(_cleaned(load(todo, pdf)), "documents")
    readable = documents.where(F.col("error").isNull())
    # A new document also competes with the contents already indexed under other names.
    indexed = state.where((F.col("status") == "ok") & (F.coalesce("content_hash", F.lit("")) != ""))
    rivals = indexed.join(documents.select("filename"), "filename", "left_anti").select("filename", "content_hash")
    judged = written(
        dedup.content_status(readable.select("filename", "content_hash").unionByName(rivals)), "judged"
    )
    demoted = judged.where(F.col("status") == "duplicate").join(rivals.select("filename"), "filename", "left_semi")
    fresh = keep_only(
        readable, judged.where(F.col("status") == "ok"), judged.where(F.col("status") != "ok"), "filename"
    )

    chunked = written(
        dedup.drop_repeated_chunks(
            chunking.chunk_documents(fresh, settings.chunk_size, settings.chunk_overlap, settings.min_chunk_chars)
        ),
        "chunked",
    )
    if snapshot_path:
        json_state.write_snapshots(chunked.where(F.size("chunks") > 0), snapshot_path)
    if modes.dry_run:
        records = _records(names, documents, judged, chunked, _none_lost(spark), demoted, state, backend, modes)
        new_state = written(manifest.merged(state, records), "records")
        return _code(new_state), new_state

    points, lost = _embedded(chunked, sink, backend, cache if settings.embedding_cache else None)
    twins = judged.where(F.col("status") == "duplicate").select("filename")
    gone = names.where("is_duplicate").select("filename").unionByName(twins)
    # A file that fails to load, gives no chunks or is not embedded keeps the points that it had.
    renewed = chunked.where(F.size("chunks") > 0).join(lost.select("filename"), "filename", "left_anti").select("filename")
    touched = written(renewed.unionByName(gone).distinct().withColumnRenamed("filename", "source"), "touched")
    records = written(_records(names, documents, judged, chunked, lost, demoted, state, backend, modes), "changed")
    new_state = sink.save(points, touched, records, backend.dim, modes.wipe)
    return _code(new_state), new_state


def _code(state: DataFrame) -> int:
    return OK if state.where(F.col("status") == "failed").isEmpty() else SOME_FAILED


def _none_lost(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "filename string, lost long, of long")


def _embedded(chunked, sink, backend, cache) -> tuple[DataFrame, DataFrame]:
    """The points of all files whose chunks all got a vector, and the other files: filename, lost, of.

    With the name of a cache table, its known vectors are read from the sink and the new ones committed to it.
    """
    rows = chunking.explode_chunks(chunked, "filename", "content_hash").withColumnRenamed("filename", "source")
    named = isinstance(cache, str)
    known = sink.tables.read(cache) if named else cache
    fresh = written(embedding.new_entries(rows, known, backend, strict=False), "entries")
    if named:
        entries = embedding.sound_entries(fresh)
        sink.tables.replace_in(cache, entries, entries.select("key"), "key", ["key"], "new vectors")
    embedded = written(embedding.embed_rows(rows, ["source", "chunk_index"], backend, known, fresh=fresh), "embedded")
    counted = embedded.groupBy("source").agg(F.count_if(F.col("vector").isNull()).alias("lost"), F.count("*").alias("of"))
    counted = written(counted.withColumnRenamed("source", "filename"), "vectors")
    lost = counted.where("lost > 0")
    whole = keep_only(embedded.withColumnRenamed("source", "filename"), counted.where("lost = 0"), lost, "filename")
    return store.to_points(whole.withColumnRenamed("filename", "source")).drop("key"), lost


def _cleaned(loaded: DataFrame) -> DataFrame:
    """Clean pages and document columns; a document left without text gets an error."""
    counted = loaded.drop("content").withColumn("raw_pages", F.coalesce(F.size("pages"), F.lit(0)))
    if "warnings" not in counted.columns:
        counted = counted.withColumn("warnings", F.lit(None).cast("array<string>"))
    present = counted.withColumn("pages", F.coalesce("pages", F.array().cast(fs.PAGES)))
    clean = cleaning.profile(cleaning.clean_pages(present))
    lost = F.col("error").isNull() & (F.size("pages") == 0)
    return clean.withColumn("error", F.when(lost, F.lit("no text left after cleaning")).otherwise(F.col("error")))


def _records(names, documents, judged, chunked, lost, demoted, state, backend, modes) -> DataFrame:
    """The state rows of this run; every file name occurs once."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    sizes = chunked.select("filename", "strategy", F.size("chunks").alias("n_chunks"))
    twins = judged.where(F.col("status") == "duplicate").select("filename", "duplicate_of")
    done = documents.join(twins, "filename", "left").join(sizes, "filename", "left").join(lost, "filename", "left")
    empty = F.col("duplicate_of").isNull() & F.col("error").isNull() & (F.coalesce("n_chunks", F.lit(0)) == 0)
    missing = F.format_string("embedding failed: no usable vector for %d of %d chunks", "lost", "of")
    error = F.when(empty, F.lit("chunking produced no chunks")).when(F.col("lost").isNotNull(), missing).otherwise(F.col("error"))
    status = (
        F.when(F.col("loader").isNull(), "skipped")
        .when(error.isNotNull(), "failed")
        .when(F.col("duplicate_of").isNotNull(), "duplicate")
        .otherwise("ok")
    )
    good = status == "ok"
    count = F.when(good, F.col("n_chunks")).otherwise(0)
    processed = done.select(
        "filename",
        "file_hash",
        F.when(F.size("pages") > 0, F.col("content_hash")).otherwise("").alias("content_hash"),
        status.alias("status"),
        "duplicate_of",
        count.alias("chunks"),
        (F.lit(0) if modes.dry_run else count).alias("points"),
        F.col("raw_pages").alias("pages"),
        "loader",
        F.when(good, F.col("strategy")).alias("strategy"),
        *[
            F.when(good, F.lit(value)).alias(name)
            for name, value in (
                ("embedding_provider", backend.provider),
                ("embedding_model", backend.model),
                ("embedding_dim", backend.dim),
            )
        ],
        now.alias("ingested_at"),
        error.alias("error"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
    )
    copies = names.where("is_duplicate").select(
        "filename", "file_hash", F.lit("duplicate").alias("status"), F.col("canonical").alias("duplicate_of"), now.alias("ingested_at")
    )
    old = state.join(demoted.select("filename", F.col("duplicate_of").alias("_twin")), "filename")
    old = old.join(copies.select("filename"), "filename", "left_anti")  # one record each
    demotions = old.withColumns(
        {"status": F.lit("duplicate"), "duplicate_of": F.col("_twin"), "points": F.lit(0)}
    ).drop("_twin")
    columns = [f.name for f in manifest.SCHEMA.fields]
    every = processed.unionByName(copies, allowMissingColumns=True).select(columns)
    return every.unionByName(demotions.select(columns)).fillna(manifest.DEFAULTS)


def main(argv: list[str]) -> int:
    options = argparse.ArgumentParser(prog="ingest", description="Files below a folder, or one file, into a vector table.")
    options.add_argument("target")
    options.add_argument("store", help="folder of the versioned tables; with MANIFEST, of plain points")
    options.add_argument("manifest", nargs="?", help="folder of the plain state table")
    options.add_argument("--keep", type=int, default=10, help="versions to keep")
    for name in ("--wipe", "--force", "--dry-run"):
        options.add_argument(name, action="store_true")
    options.add_argument("--limit", type=int)
    given = options.parse_args(argv)
    spark = SparkSession.builder.appName("ingest").getOrCreate()
    ship(spark)
    place = spark._jvm.org.apache.hadoop.fs.Path(given.target)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        options.error(f"no such file or folder: {given.target}")
    settings = Settings()
    modes = Modes(given.wipe, given.force, given.dry_run, given.limit)
    backend = embedding.select_backend(settings.embedding_provider)
    files = fs.discover(spark, given.target)
    if given.manifest:
        code, state = run(spark, files, given.store, given.manifest, modes, settings, backend)
    else:
        sink = Versioned(spark, given.store)
        code, state = run_into(sink, files, modes, settings, backend, cache="vectors")
        sink.tables.expire(given.keep)
    manifest.summary(state).show()
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
