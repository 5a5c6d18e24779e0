"""Scans, document columns, cleaning, chunking, deduplication, ingestion state."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import ids
from docweave.functions import tables
from docweave.functions import text as tx
from docweave.operators import chunking, cleaning, dedup, manifest, sketches, store
from docweave.operators.unfold import unfold
from docweave.queries.common import (
    PAGE_NUMBER_RE2,
    PAGED_SQL,
    WS,
    damaged,
    paged_documents,
    query,
    sql_damaged,
    sql_line_key,
    sql_repair,
    sql_strip,
    table,
)
from docweave.sources import files, html, json_state, tiers

SIZE, OVERLAP, MIN_CHARS = 1400, 200, 120
STEP = SIZE - OVERLAP

# Sources

ENDINGS = [".txt", ".MD", ".html", ".Htm", ".docx", ".pptx", ".pdf", ".csv", ""]


@query(
    "i02_dispatch",
    f"""
    WITH names AS (
      SELECT 'doc_' || doc_id || {ENDINGS!r}[CAST(doc_id % {len(ENDINGS)} AS INT) + 1] AS name FROM documents
      UNION ALL
      SELECT 'page_' || page_id || '.html' FROM pages)
    SELECT name, CASE lower(regexp_extract(name, '\\.([^./]+)$', 1))
             WHEN 'pdf' THEN 'pdf-cascade' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text'
             WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html'
             WHEN 'docx' THEN 'office-docx' WHEN 'pptx' THEN 'office-pptx' END AS loader
    FROM names""",
)
def i02_dispatch(spark, folder):
    ending = F.get(F.array(*[F.lit(e) for e in ENDINGS]), F.pmod("doc_id", F.lit(len(ENDINGS))).cast("int"))
    docs = table(spark, folder, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ending).alias("name")
    )
    pages = table(spark, folder, "pages").select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("name")
    )
    return docs.union(pages).withColumn("loader", files.loader_of(F.col("name")))


BLANK_FILES = 1_000_000_000  # ids of blank files put in besides the given documents


@query(
    "i03_text_scan",
    f"""
    WITH scanned AS (
      SELECT doc_id, text || chr(65533) || 'tail' AS t FROM documents
      UNION ALL SELECT doc_id + {BLANK_FILES}, '  ' || chr(10) FROM documents WHERE doc_id % 7 = 0)
    SELECT doc_id, CASE WHEN {sql_strip("t")} = '' THEN NULL ELSE md5(t) END AS text_md5,
           CASE WHEN {sql_strip("t")} = '' THEN 'extraction failed: doc_' || doc_id || '.txt is empty.' END AS error
    FROM scanned""",
)
def i03_text_scan(spark, folder):
    """Every document with a byte that is no UTF-8, and besides them some blank files."""
    whole = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.lit("tail"), "UTF-8"))
    own = F.struct(F.lit(0).alias("more"), whole.alias("content"))
    blank = F.struct(F.lit(BLANK_FILES).alias("more"), F.encode(F.lit("  \n"), "UTF-8").alias("content"))
    rows = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.array(own, blank)).otherwise(F.array(own))
    every = unfold(table(spark, folder, "documents"), rows, "f", "doc_id")
    scanned = every.select((F.col("doc_id") + F.col("f.more")).alias("doc_id"), F.col("f.content").alias("content"))
    named = scanned.withColumn("filename", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    loaded = files.load_text(named)
    return loaded.select("doc_id", F.md5(F.get("pages", F.lit(0))["text"]).alias("text_md5"), "error")


def _sql_html_text(x: str) -> str:
    nl = "chr(10)"
    for tag in ("script", "style", "nav", "footer", "header", "form", "noscript", "svg"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', {nl}, 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', {nl}, 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', {nl}, 'g')"
    for entity, char in (("&quot;", "'\"'"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)")):
        x = f"replace({x}, '{entity}', {char})"
    return f"regexp_replace(replace({x}, '&amp;', '&'), '&amp\\b', '&', 'g')"


@query(
    "i04_html_text",
    f"""
    WITH stripped AS (SELECT page_id, {_sql_html_text("html")} AS t FROM pages),
    kept AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda l: {sql_strip("l")}),
                                         lambda l: l <> '') AS ls FROM stripped)
    SELECT page_id, CAST(len(ls) AS BIGINT) AS n_lines, md5(array_to_string(ls, chr(10))) AS text_md5 FROM kept""",
)
def i04_html_text(spark, folder):
    text = table(spark, folder, "pages", "page_id", "html", heavy=True).withColumn("t", html.html_text(F.col("html")))
    return text.select("page_id", F.size(tx.lines(F.col("t"))).cast("bigint").alias("n_lines"), F.md5("t").alias("text_md5"))


TIERS_SQL = """
extracted AS (
  SELECT filename AS doc, number AS page, t AS tier,
         CASE t WHEN 1 THEN CASE WHEN (doc_id + number) % 3 = 0 THEN ' ' ELSE text END
                WHEN 2 THEN CASE WHEN (doc_id + number) % 6 = 0 THEN '' ELSE 'second ' || text END
                ELSE CASE WHEN (doc_id + number) % 12 = 0 THEN NULL ELSE 'third ' || text END END AS text
  FROM paged, (VALUES (1), (2), (3)) v(t))"""


def _tier_rows(spark, folder):
    pages = unfold(paged_documents(spark, folder), "pages", "p", "doc_id", "filename")
    n, text = F.col("doc_id") + F.col("p.number"), F.col("p.text")
    options = F.array(
        F.struct(F.lit(1).alias("tier"), F.when(n % 3 == 0, " ").otherwise(text).alias("text")),
        F.struct(F.lit(2).alias("tier"), F.when(n % 6 == 0, "").otherwise(F.concat(F.lit("second "), text)).alias("text")),
        F.struct(F.lit(3).alias("tier"), F.when(n % 12 != 0, F.concat(F.lit("third "), text)).alias("text")),
    )
    rows = unfold(pages, options, "o", F.col("filename").alias("doc"), F.col("p.number").alias("page"))
    return rows.select("doc", "page", "o.tier", "o.text")


@query(
    "i08_tier_cascade",
    f"""
    WITH {PAGED_SQL}, {TIERS_SQL},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY tier) AS rn
               FROM extracted WHERE {sql_strip("coalesce(text, '')")} <> '')
    SELECT doc, page, md5(text) AS text_md5, ['pypdf', 'pdfplumber', 'pymupdf'][tier] AS extractor
    FROM ranked WHERE rn = 1""",
)
def i08_tier_cascade(spark, folder):
    return tiers.cascade(_tier_rows(spark, folder)).select(
        "doc", F.col("page").cast("bigint").alias("page"), F.md5("text").alias("text_md5"), "extractor"
    )


@query(
    "i08_missing_pages",
    f"""
    WITH {PAGED_SQL}, {TIERS_SQL},
    missing AS (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS rn
                FROM extracted GROUP BY doc, page
                HAVING count(*) FILTER ({sql_strip("coalesce(text, '')")} <> '') = 0),
    totals AS (SELECT filename AS doc, max(total) AS total FROM paged GROUP BY filename)
    SELECT doc, CAST(count(*) AS BIGINT) AS missing, CAST(max(total) AS BIGINT) AS total,
           count(*) || '/' || max(total) || ' pages yielded no text (pages ['
           || string_agg(page::VARCHAR, ', ' ORDER BY page) FILTER (rn <= 12) || ']'
           || CASE WHEN count(*) > 12 THEN '...' ELSE '' END || ')' AS warning
    FROM missing JOIN totals USING (doc) GROUP BY doc""",
)
def i08_missing_pages(spark, folder):
    totals = paged_documents(spark, folder).select(F.col("filename").alias("doc"), F.size("pages").alias("total"))
    return tiers.missing_report(totals, tiers.cascade(_tier_rows(spark, folder)))


@query(
    "i13_manifest_scan",
    """
    SELECT 'doc_' || doc_id || '.txt' AS filename,
           CASE WHEN doc_id % 3 = 0 THEN 'ok' ELSE 'pending' END AS status,
           CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS INT) ELSE 0 END AS points,
           sha256(text) AS file_hash
    FROM documents WHERE doc_id % 5 <> 4""",
)
def i13_manifest_scan(spark, folder):
    """Stored records with unknown keys, missing keys and broken JSON."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    third = F.pmod("doc_id", F.lit(3)) == 0
    record = F.to_json(
        F.struct(
            name.alias("filename"),
            F.sha2("text", 256).alias("file_hash"),
            F.when(third, "ok").alias("status"),
            F.when(third, F.col("n_chars").cast("int")).alias("points"),
            F.lit("x").alias("unknown_key"),
        )
    )
    broken = F.when(F.pmod("doc_id", F.lit(5)) == 4, F.concat(F.lit("{\"filename\": "), record)).otherwise(record)
    raw = table(spark, folder, "documents").select(manifest.parse_records(broken).alias("r"))
    return raw.where("r is not null").select("r.filename", "r.status", "r.points", "r.file_hash")


@query(
    "i14_dataset_scan",
    """
    SELECT item_id AS id, text AS question, 'bench_' || item_id || '.txt' AS source_doc,
           CAST(2 AS INT) AS n_contexts
    FROM benchmark
    UNION ALL
    SELECT item_id + 1000000, 'q ' || text, 'none', 0 FROM benchmark""",
)
def i14_dataset_scan(spark, folder):
    """Nested evaluation files (two samples each) unfolded into sample rows."""
    def sample(offset, question, source, contexts):
        return F.struct(
            (F.col("item_id") + offset).alias("id"),
            question.alias("question"),
            source.alias("source_doc"),
            contexts.cast("array<string>").alias("relevant_contexts"),
        )

    named = F.concat(F.lit("bench_"), F.col("item_id").cast("string"), F.lit(".txt"))
    nested = F.to_json(
        F.struct(
            F.array(
                sample(0, F.col("text"), named, F.array("text", "text")), sample(1000000, F.concat(F.lit("q "), "text"), F.lit("none"), F.array())
            ).alias("rag_samples")
        )
    )
    raw = table(spark, folder, "benchmark").select(nested.alias("raw"))
    return json_state.samples_from_json(raw).select(
        "id", "question", "source_doc", F.size("relevant_contexts").alias("n_contexts")
    )


# Document columns


@query(
    "i21_doc_profile",
    f"""
    WITH {PAGED_SQL}
    SELECT filename, CAST(count(*) AS BIGINT) AS page_count, CAST(sum(length(text)) AS BIGINT) AS char_count,
           'builtin' AS extractors, sha256(string_agg(text, chr(10) || chr(10) ORDER BY number)) AS content_hash
    FROM paged GROUP BY filename""",
)
def i21_doc_profile(spark, folder):
    return cleaning.profile(paged_documents(spark, folder)).select(
        "filename", "page_count", "char_count", F.array_join("extractors", ",").alias("extractors"), "content_hash"
    )


@query(
    "i25_content_hash",
    "SELECT doc_id, sha256(text) AS content_hash, sha256(encode(text)) AS file_hash FROM documents",
)
def i25_content_hash(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        ids.content_hash(F.col("text")).alias("content_hash"),
        ids.file_hash(F.encode("text", "UTF-8")).alias("file_hash"),
    )


# Cleaning


@query("i27_nfkc", "SELECT doc_id, md5(text) AS folded_md5 FROM documents")
def i27_nfkc(spark, folder):
    """Ligatures and full-width letters put in, then folded back to the plain text."""
    odd = F.translate(F.replace(F.col("text"), F.lit("fi"), F.lit("ﬁ")), "ABCxyz", "ＡＢＣｘｙｚ")
    return table(spark, folder, "documents").select("doc_id", F.md5(tx.nfkc(odd)).alias("folded_md5"))


def _clean_steps_sql():
    d = sql_damaged("text")
    hyphen = rf"regexp_replace({d}, '([a-z])-\s*\n\s*([a-z])', '\1\2', 'g')"
    soft = d
    for _ in range(2):
        soft = rf"regexp_replace({soft}, '(^|[^.!?:;)\]])\n([a-z(])', '\1 \2', 'g')"
    return f"""
    SELECT doc_id, md5(regexp_replace({d}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS control,
           md5({hyphen}) AS hyphen, md5({soft}) AS wrapped,
           md5(regexp_replace({d}, '[ \\t\\x{{A0}}]{{2,}}', ' ', 'g')) AS spaces,
           md5(regexp_replace({d}, '\\n{{3,}}', chr(10) || chr(10), 'g')) AS newlines
    FROM documents"""


@query("i28_32_repair_steps", _clean_steps_sql())
def i28_32_repair_steps(spark, folder):
    bad = table(spark, folder, "documents", "doc_id", "text", heavy=True).select("doc_id", damaged(F.col("text")).alias("t"))
    t = F.col("t")
    return bad.select(
        "doc_id",
        F.md5(tx.drop_control(t)).alias("control"),
        F.md5(tx.join_hyphenated(t)).alias("hyphen"),
        F.md5(tx.join_wrapped(t)).alias("wrapped"),
        F.md5(tx.collapse_spaces(t)).alias("spaces"),
        F.md5(tx.collapse_newlines(t)).alias("newlines"),
    )


@query(
    "i34_normalize",
    f"""
    SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5
    FROM (SELECT doc_id, {sql_repair("replace(" + sql_damaged("text") + ", chr(160), ' ')")} AS t FROM documents)""",
)
def i34_normalize(spark, folder):
    """All repairs in order; compatibility folding turns a no-break space into a space."""
    fixed = table(spark, folder, "documents", "doc_id", "text", heavy=True).select("doc_id", tx.normalize(damaged(F.col("text"))).alias("t"))
    return fixed.select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("text_md5"))


@query(
    "i35_line_keys",
    f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
               UNION ALL SELECT doc_id, 'Page ' || doc_id || ' of 12' FROM documents),
    k AS (SELECT doc_id, {sql_line_key("line")} AS key, regexp_matches(line, '{PAGE_NUMBER_RE2}') AS num FROM l)
    SELECT key, count(DISTINCT doc_id) AS n_docs, CAST(count(*) FILTER (num) AS BIGINT) AS n_page_numbers
    FROM k WHERE key IS NOT NULL GROUP BY key""",
)
def i35_line_keys(spark, folder):
    docs = table(spark, folder, "documents")
    extra = F.concat(F.lit("Page "), F.col("doc_id").cast("string"), F.lit(" of 12"))
    rows = unfold(docs, F.concat(tx.lines(F.col("text")), F.array(extra)), "line", "doc_id")
    keyed = rows.select("doc_id", tx.line_key(F.col("line")).alias("key"), tx.is_page_number(F.col("line")).alias("num"))
    per_doc = keyed.where("key is not null").groupBy("key", "doc_id").agg(F.count_if("num").alias("n"))
    return per_doc.groupBy("key").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_page_numbers"))


HEADS_SQL = f"""
page_lines AS (
  SELECT filename, number, total, pos, line, {sql_line_key("line")} AS key
  FROM (SELECT filename, number, total, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM paged)),
heads AS (
  SELECT filename, key FROM page_lines WHERE key IS NOT NULL AND total >= 5
  GROUP BY filename, key HAVING count(DISTINCT number) >= greatest(2, floor(max(total) * CAST(0.6 AS DOUBLE)))),
kept_lines AS (
  SELECT l.* FROM page_lines l
  WHERE l.filename NOT IN (SELECT filename FROM heads)
     OR NOT ((l.filename, l.key) IN (SELECT filename, key FROM heads)
             OR regexp_matches(l.line, '{PAGE_NUMBER_RE2}'))),
headless AS (
  SELECT p.filename, p.number, coalesce(string_agg(k.line, chr(10) ORDER BY k.pos), '') AS text,
         CAST(count(k.pos) AS BIGINT) AS n_lines
  FROM (SELECT DISTINCT filename, number FROM paged) p
  LEFT JOIN kept_lines k ON k.filename = p.filename AND k.number = p.number
  GROUP BY p.filename, p.number)"""


@query(
    "i36_running_heads",
    f"""
    WITH {PAGED_SQL}, {HEADS_SQL.replace("l.filename, l.key) IN (SELECT filename, key FROM heads)",
                                         "l.filename, coalesce(l.key, '')) IN (SELECT filename, key FROM heads)")}
    SELECT filename, number, n_lines, md5(text) AS text_md5 FROM headless""",
)
def i36_running_heads(spark, folder):
    cleaned = cleaning.remove_running_heads(paged_documents(spark, folder))
    pages = unfold(cleaned, "pages", "p", "filename")
    kept = F.when(F.col("p.text") == "", 0).otherwise(F.size(F.split("p.text", "\n")))
    return pages.select(
        "filename", F.col("p.number").cast("bigint").alias("number"), kept.cast("bigint").alias("n_lines"), F.md5("p.text").alias("text_md5")
    )


CLEAN_SQL = f"""{PAGED_SQL}, {HEADS_SQL.replace("l.filename, l.key) IN (SELECT filename, key FROM heads)",
                                                "l.filename, coalesce(l.key, '')) IN (SELECT filename, key FROM heads)")},
clean AS (SELECT filename, number, {sql_repair("text")} AS text FROM headless)"""


@query(
    "i38_clean_pages",
    f"""
    WITH {CLEAN_SQL}
    SELECT filename, number, length(text) AS n_chars, md5(text) AS text_md5 FROM clean WHERE text <> ''""",
)
def i38_clean_pages(spark, folder):
    pages = unfold(cleaning.clean_pages(paged_documents(spark, folder)), "pages", "p", "filename")
    return pages.select(
        "filename",
        F.col("p.number").cast("bigint").alias("number"),
        F.length("p.text").cast("bigint").alias("n_chars"),
        F.md5("p.text").alias("text_md5"),
    )


# Chunking

WINDOWS_SQL = f"""
windows AS (
  SELECT doc_id, text, n, k * {STEP} AS start, {sql_strip(f"substr(text, CAST(k * {STEP} + 1 AS BIGINT), {SIZE})")} AS piece
  FROM (SELECT doc_id, text, length(text) AS n,
               unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - {SIZE}) / {STEP}.0) AS BIGINT)))) AS k
        FROM documents))"""


@query(
    "i39_recursive_chunks",
)
def i39_recursive_chunks(spark, folder):
    text = F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n")
    docs = paged_documents(spark, folder).select("filename", chunking.recursive_chunks(text, SIZE, OVERLAP).alias("c"))
    rows = unfold(docs, "c", "text", "filename", position="idx")
    return rows.select("filename", "idx", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("i40_paragraph_chunks")
def i40_paragraph_chunks(spark, folder):
    joined = paged_documents(spark, folder).select(
        "filename", F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n").alias("t")
    )
    docs = joined.select("filename", chunking.paragraph_chunks(F.col("t"), SIZE, OVERLAP).alias("c"))
    rows = unfold(docs, "c", "text", "filename", position="idx")
    return rows.select("filename", "idx", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(
    "i41_window_chunks",
    f"""
    WITH {WINDOWS_SQL}
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INT) AS idx,
           length(piece) AS n_chars, md5(piece) AS text_md5
    FROM windows WHERE length(piece) >= {MIN_CHARS}""",
)
def i41_window_chunks(spark, folder):
    """Windows over each text, short ones dropped, the rest numbered."""
    docs = table(spark, folder, "documents").select(
        "doc_id", chunking.window_chunks(F.col("text"), SIZE, OVERLAP).alias("c")
    )
    kept = unfold(docs, F.filter("c", lambda p: F.length(p) >= MIN_CHARS), "t", "doc_id", position="idx")
    return kept.select("doc_id", "idx", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("text_md5"))


@query(
    "i41_window_sql",
    f"""
    WITH {WINDOWS_SQL}
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INT) AS idx,
           length(piece) AS n_chars, md5(piece) AS text_md5
    FROM windows WHERE length(piece) >= {MIN_CHARS}""",
)
def i41_window_sql(spark, folder):
    """The windows as Spark SQL: a lateral join with a table function."""
    tables.register(spark)
    return spark.sql(
        f"""SELECT d.doc_id, c.chunk_index AS idx, CAST(c.char_count AS BIGINT) AS n_chars, md5(c.text) AS text_md5
        FROM {{docs}} d, LATERAL window_chunks(d.text, {SIZE}, {OVERLAP}, {MIN_CHARS}) c""",
        docs=table(spark, folder, "documents", "doc_id", "text", heavy=True),
    )


@query(
    "i42_validation",
    f"""
    WITH {WINDOWS_SQL},
    squeezed AS (SELECT doc_id, n, start,
                        CASE doc_id % 5 WHEN 0 THEN left(piece, 300) WHEN 1 THEN piece || piece || piece
                                        WHEN 2 THEN ' ' ELSE piece END AS c
                 FROM windows WHERE doc_id % 5 <> 3),
    facts AS (SELECT d.doc_id, length(d.text) AS n, count(c) AS k, max(length(c)) AS longest, sum(length(c)) AS total,
                     bool_and({sql_strip("c")} = '') AS blank
              FROM documents d LEFT JOIN squeezed s ON s.doc_id = d.doc_id AND c IS NOT NULL GROUP BY d.doc_id, d.text)
    SELECT doc_id, CASE WHEN k = 0 THEN 'produced zero chunks' WHEN blank THEN 'all chunks are blank'
             WHEN longest > {2 * SIZE} THEN 'longest chunk is ' || longest || ' chars (limit {2 * SIZE})'
             WHEN n > 0 AND total < n * 0.5
             THEN 'retained only ' || total || '/' || n || ' chars (' || CAST(round_even(total * 100.0 / n, 0) AS INT) || '%)'
           END AS reason
    FROM facts""",
)
def i42_validation(spark, folder):
    """Candidates spoilt on purpose: cut short, tripled, blank, missing."""
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", chunking.window_chunks(F.col("text"), SIZE, OVERLAP).alias("c")
    )
    kind = F.pmod("doc_id", F.lit(5))
    spoilt = (
        F.when(kind == 0, F.transform("c", lambda p: F.left(p, F.lit(300))))
        .when(kind == 1, F.transform("c", lambda p: F.concat(p, p, p)))
        .when(kind == 2, F.transform("c", lambda p: F.lit(" ")))
        .when(kind == 3, F.array().cast("array<string>"))
        .otherwise(F.col("c"))
    )
    return docs.withColumn("s", spoilt).select(
        "doc_id", chunking.rejection(F.col("s"), F.length("text"), SIZE).alias("reason")
    )


def chunked_documents(spark, folder):
    """Cleaned and chunked paged documents."""
    return chunking.chunk_documents(
        cleaning.clean_pages(paged_documents(spark, folder)), SIZE, OVERLAP, MIN_CHARS
    )


@query("i43_chunk_cascade")
def i43_chunk_cascade(spark, folder):
    """The strategy chosen per document when the first one is unavailable for some."""
    def sometimes(text, size, overlap):
        return None if len(text) % 2 else chunking.split_recursive(text, size, overlap)

    docs = cleaning.clean_pages(paged_documents(spark, folder))
    chunked = chunking.chunk_documents(docs, SIZE, OVERLAP, MIN_CHARS, splitter=sometimes)
    return chunked.select("filename", "strategy", F.size("chunks").alias("n_chunks"))


SOURCE_PAGES_SQL = """
source_pages AS (
  SELECT source AS doc, doc_id AS number, n_chars,
         CAST(coalesce(sum(n_chars + 2) OVER (PARTITION BY source ORDER BY doc_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset
  FROM documents)"""


def _source_pages(spark, folder):
    """Each source as one very long document whose pages are its texts."""
    return table(spark, folder, "documents").select(
        F.col("source").alias("doc"), F.col("doc_id").alias("number"), "n_chars"
    )


@query("i46_page_index", f"WITH {SOURCE_PAGES_SQL} SELECT doc, number, start_offset FROM source_pages")
def i46_page_index(spark, folder):
    return chunking.page_index(_source_pages(spark, folder)).select("doc", "number", "start_offset")


@query(
    "i47_page_lookup",
    f"""
    WITH {SOURCE_PAGES_SQL},
    wanted AS (
      SELECT doc, start_offset + least(CAST(n_chars + 1 AS BIGINT), (number * 37) % (n_chars + 2)) AS lo,
             start_offset + n_chars + 1 AS hi FROM source_pages),
    offsets AS (SELECT doc, lo AS "offset" FROM wanted UNION SELECT doc, hi FROM wanted)
    SELECT o.doc, o."offset", p.number FROM offsets o
    ASOF JOIN source_pages p ON o.doc = p.doc AND o."offset" >= p.start_offset""",
)
def i47_page_lookup(spark, folder):
    index = chunking.page_index(_source_pages(spark, folder))
    end = F.col("start_offset") + F.col("n_chars") + 1
    inner = F.col("start_offset") + F.pmod(F.col("number") * 37, F.col("n_chars") + 2)
    offsets = index.select("doc", F.explode(F.array_distinct(F.array(inner, end))).alias("offset")).distinct()
    return chunking.page_lookup(index, offsets).select("doc", "offset", "number")


@query(
    "i50_page_label",
    """
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'n/a'
                        WHEN doc_id % 3 = 0 OR n_chars % 4 = 0 THEN doc_id::VARCHAR
                        ELSE doc_id || '-' || (doc_id + n_chars % 4) END AS label
    FROM documents""",
)
def i50_page_label(spark, folder):
    start = F.when(F.pmod("doc_id", F.lit(5)) != 0, F.col("doc_id"))
    end = F.when(F.pmod("doc_id", F.lit(3)) != 0, F.col("doc_id") + F.pmod("n_chars", F.lit(4)))
    return table(spark, folder, "documents").select("doc_id", chunking.page_label(start, end).alias("label"))


@query("i51_chunk_documents")
def i51_chunk_documents(spark, folder):
    """Clean, chunk, locate and attribute every document."""
    rows = chunking.explode_chunks(chunked_documents(spark, folder), "filename")
    return rows.select(
        "filename", "chunk_index", "strategy", "page_start", "page_end", "page_label", "char_count",
        F.md5("text").alias("text_md5"),
    )


@query("i65_snapshots")
def i65_snapshots(spark, folder):
    """What was parsed and chunked, as one JSON row per file."""
    docs = chunked_documents(spark, folder).withColumn("loader", F.lit("text"))
    rows = json_state.snapshot_rows(cleaning.profile(docs))
    return rows.select("filename", F.to_json(F.struct(*[c for c in rows.columns if c != "filename"])).alias("snapshot"))


# Deduplication


@query(
    "i52_byte_duplicates",
    """
    SELECT name, first_value(name) OVER w AS canonical, name <> first_value(name) OVER w AS is_duplicate
    FROM (SELECT 'doc_' || doc_id || '.txt' AS name, sha256(text) AS h FROM documents)
    WINDOW w AS (PARTITION BY h ORDER BY length(name), name)""",
)
def i52_byte_duplicates(spark, folder):
    named = table(spark, folder, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        ids.file_hash(F.encode("text", "UTF-8")).alias("file_hash"),
    )
    return dedup.canonical_names(named, "file_hash").select("name", "canonical", "is_duplicate")


@query(
    "i53_content_duplicates",
    f"""
    WITH r AS (SELECT 'doc_' || doc_id || '.txt' AS filename, sha256({sql_repair("text")}) AS h FROM documents)
    SELECT filename, CASE WHEN filename = f THEN 'ok' ELSE 'duplicate' END AS status,
           CASE WHEN filename <> f THEN f END AS duplicate_of
    FROM (SELECT filename, first_value(filename) OVER (PARTITION BY h ORDER BY length(filename), filename) AS f FROM r)""",
)
def i53_content_duplicates(spark, folder):
    """Files that differ as bytes and agree after text repair."""
    records = table(spark, folder, "documents", "doc_id", "text", heavy=True).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        ids.content_hash(tx.normalize(F.col("text"))).alias("content_hash"),
    )
    return dedup.content_status(records).select("filename", "status", "duplicate_of")


@query(
    "i54_chunk_duplicates",
    f"""
    WITH pieces AS (
      SELECT doc_id, k AS idx, substr(t, CAST(k * 60 + 1 AS BIGINT), 60) AS c
      FROM (SELECT doc_id, t, unnest(generate_series(0, CAST(floor(length(t) / 60.0) AS BIGINT))) AS k
            FROM (SELECT doc_id, substr(text, 1, 60) || text || rpad(substr(text, 1, 60), 60, ' ') AS t FROM documents)))
    SELECT doc_id, CAST(min(idx) AS INT) AS idx, md5(c) AS text_md5 FROM pieces WHERE c <> '' GROUP BY doc_id, c""",
)
def i54_chunk_duplicates(spark, folder):
    head = F.substring("text", 1, 60)
    t = F.concat(head, F.col("text"), F.rpad(head, 60, " "))
    docs = table(spark, folder, "documents", "doc_id", "text", heavy=True).select("doc_id", t.alias("t"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor(F.length("t") / 60).cast("int")),
        lambda k: F.struct(k.alias("index"), F.col("t").substr(k * 60 + 1, F.lit(60)).alias("text")),
    )
    cut = docs.select("doc_id", F.filter(pieces, lambda p: p["text"] != "").alias("chunks"))
    kept = unfold(dedup.drop_repeated_chunks(cut), "chunks", "c", "doc_id")
    return kept.select("doc_id", F.col("c.index").alias("idx"), F.md5("c.text").alias("text_md5"))


# Ingestion state

MANIFEST_SQL = """
stored AS (
  SELECT 'doc_' || doc_id || '.txt' AS filename,
         CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE sha256(text) END AS file_hash, sha256(text) AS content_hash,
         CASE WHEN doc_id % 13 = 0 THEN 'duplicate' WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'ok' END AS status,
         CASE WHEN doc_id % 13 = 0 THEN 'doc_' || (doc_id + 1) || '.txt' END AS duplicate_of,
         CAST(n_chars // 1200 + 1 AS INT) AS chunks,
         CASE WHEN doc_id % 19 = 0 THEN 0 ELSE CAST(n_chars // 1200 + 1 AS INT) END AS points,
         CASE WHEN doc_id % 23 = 0 THEN 64 WHEN doc_id % 29 = 0 THEN 0 ELSE 256 END AS embedding_dim
  FROM documents WHERE doc_id % 7 <> 6)"""


def _stored_manifest(spark, folder):
    def every(n):
        return F.pmod("doc_id", F.lit(n)) == 0

    docs = table(spark, folder, "documents").where(F.pmod("doc_id", F.lit(7)) != 6)
    chunks = (F.floor(F.col("n_chars") / 1200) + 1).cast("int")
    return docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.when(every(11), "old").otherwise(F.sha2("text", 256)).alias("file_hash"),
        F.sha2("text", 256).alias("content_hash"),
        F.when(every(13), "duplicate").when(every(17), "failed").otherwise("ok").alias("status"),
        F.when(every(13), F.concat(F.lit("doc_"), (F.col("doc_id") + 1).cast("string"), F.lit(".txt"))).alias(
            "duplicate_of"
        ),
        chunks.alias("chunks"),
        F.when(every(19), 0).otherwise(chunks).alias("points"),
        F.when(every(23), 64).when(every(29), 0).otherwise(256).alias("embedding_dim"),
    )


@query(
    "i55_skip_decision",
    f"""
    WITH {MANIFEST_SQL},
    f AS (SELECT 'doc_' || doc_id || '.txt' AS filename, sha256(text) AS h FROM documents),
    r AS (SELECT f.filename, CASE
        WHEN s.filename IS NULL THEN 'not ingested before'
        WHEN status = 'duplicate' AND file_hash = h THEN 'duplicate of ' || duplicate_of
        WHEN status <> 'ok' THEN 'previous status was ''' || status || ''''
        WHEN points <= 0 THEN 'recorded as ok but has no indexed points'
        WHEN file_hash <> h THEN 'file changed on disk'
        WHEN embedding_dim <> 0 AND embedding_dim <> 256 THEN 'embedding dim changed ' || embedding_dim || ' -> 256'
        ELSE 'unchanged since last successful ingest' END AS reason
      FROM f LEFT JOIN stored s USING (filename))
    SELECT filename, reason LIKE 'duplicate of%' OR reason LIKE 'unchanged%' AS skip, reason FROM r""",
)
def i55_skip_decision(spark, folder):
    found = table(spark, folder, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.sha2("text", 256).alias("file_hash"),
    )
    return manifest.skip_decision(found, _stored_manifest(spark, folder), 256).select("filename", "skip", "reason")


@query(
    "i56_point_id",
    f"""
    WITH d AS (SELECT doc_id, sha1(unhex('{ids.POINT_NAMESPACE}') || encode('doc_' || doc_id || '.txt:' || (doc_id % 40))) AS h
               FROM documents)
    SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
           || substr('89ab', (('0x' || substr(h, 17, 1))::BIGINT % 4 + 1)::BIGINT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
    FROM d""",
)
def i56_point_id(spark, folder):
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, folder, "documents").select(
        "doc_id", ids.point_id(name, F.pmod("doc_id", F.lit(40))).alias("id")
    )


@query(
    "i57_replace_source",
    f"""
    WITH starts AS (
      SELECT source, doc_id, {STEP} * unnest(generate_series(0, greatest(0, CAST(ceil((n_chars - {SIZE}) / {STEP}.0) AS BIGINT)))) AS start
      FROM documents),
    old AS (SELECT source, doc_id, start, 'old' AS version FROM starts),
    fresh AS (SELECT source, doc_id, start, 'new' AS version FROM starts
              WHERE source IN ('src0', 'src3') AND start < {STEP * 2})
    SELECT * FROM old WHERE source NOT IN ('src0', 'src3', 'src7') UNION ALL SELECT * FROM fresh""",
)
def i57_replace_source(spark, folder):
    """Three sources are processed again: two with shorter results, one with none."""
    starts = chunking.window_starts(F.col("n_chars"), SIZE, OVERLAP).cast("array<bigint>")
    windows = unfold(table(spark, folder, "documents"), starts, "start", "source", "doc_id")
    key = F.concat_ws(":", "source", "doc_id", "start").alias("id")
    old = windows.select(key, "source", "doc_id", "start", F.lit("old").alias("version"))
    again = F.col("source").isin("src0", "src3")
    fresh = windows.where(again & (F.col("start") < STEP * 2)).select(
        key, "source", "doc_id", "start", F.lit("new").alias("version")
    )
    touched = windows.where(F.col("source").isin("src0", "src3", "src7")).select("source")
    return store.replace_sources(old, fresh, touched).drop("id")


LOG_SQL = """
log AS (
  SELECT 'file_' || (doc_id % 97) AS filename, CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed'
         WHEN 2 THEN 'duplicate' ELSE 'ok' END AS status, CAST(n_chars // 1200 + 1 AS INT) AS chunks,
         CASE WHEN doc_id % 4 IN (0, 3) THEN CAST(n_chars // 1200 + 1 AS INT) ELSE 0 END AS points,
         '2024-01-01T00:00:00+00:00#' || lpad(doc_id::VARCHAR, 12, '0') AS ingested_at
  FROM documents),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY ingested_at DESC) AS rn FROM log)
           WHERE rn = 1)"""


def _latest_log(spark, folder):
    ok = F.pmod("doc_id", F.lit(4)).isin(0, 3)
    chunks = (F.floor(F.col("n_chars") / 1200) + 1).cast("int")
    log = table(spark, folder, "documents").select(
        F.concat(F.lit("file_"), F.pmod("doc_id", F.lit(97)).cast("string")).alias("filename"),
        F.when(ok, "ok").when(F.pmod("doc_id", F.lit(4)) == 1, "failed").otherwise("duplicate").alias("status"),
        chunks.alias("chunks"),
        F.when(ok, chunks).otherwise(0).alias("points"),
        F.concat(F.lit("2024-01-01T00:00:00+00:00#"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias(
            "ingested_at"
        ),
    )
    return manifest.latest_records(log)


@query("i59_latest_record", f"WITH {LOG_SQL} SELECT filename, status, chunks, points, ingested_at FROM newest")
def i59_latest_record(spark, folder):
    return _latest_log(spark, folder)


@query(
    "i60_manifest_summary",
    f"""
    WITH {LOG_SQL}
    SELECT CASE WHEN grouping(status) = 1 THEN 'all' ELSE status END AS status, count(*) AS files,
           CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(points) AS BIGINT) AS points
    FROM newest GROUP BY ROLLUP (status)""",
)
def i60_manifest_summary(spark, folder):
    return manifest.summary(_latest_log(spark, folder))


@query("i61_indexed_sources", f"WITH {MANIFEST_SQL} SELECT filename FROM stored WHERE status = 'ok'")
def i61_indexed_sources(spark, folder):
    return manifest.indexed_sources(_stored_manifest(spark, folder))


CUBE_SQL = f"""
WITH {MANIFEST_SQL},
kinds AS (
  SELECT s.*, ['text', 'html', 'office-docx'][CAST(d.doc_id % 3 AS INT) + 1] AS loader,
    CASE WHEN d.doc_id % 4 > 0 THEN ['recursive', 'paragraph', 'window'][CAST(d.doc_id % 4 AS INT)] END AS strategy
  FROM stored s JOIN documents d ON s.filename = 'doc_' || d.doc_id || '.txt')
SELECT status, loader, strategy, CAST(grouping(status) * 4 + grouping(loader) * 2 + grouping(strategy) AS INT) AS level,
  count(*) AS files, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(points) AS BIGINT) AS points
FROM kinds GROUP BY CUBE (status, loader, strategy)"""


@query("i60_summary_cube", CUBE_SQL)
def i60_summary_cube(spark, folder):
    """The state summed up by status, loader and strategy and all their subsets; some records have no strategy."""
    number = F.regexp_extract("filename", r"(\d+)", 1).cast("bigint")
    loader = F.get(F.array(*[F.lit(x) for x in ("text", "html", "office-docx")]), (number % 3).cast("int"))
    strategy = F.get(F.array(*[F.lit(x) for x in (None, "recursive", "paragraph", "window")]), (number % 4).cast("int"))
    stored = _stored_manifest(spark, folder).withColumns({"loader": loader, "strategy": strategy})
    return manifest.summary_sets(stored, ["status", "loader", "strategy"])


@query(
    "i60_source_sketches",
    f"""
    WITH {WINDOWS_SQL}
    SELECT source, count(*) AS n, count(DISTINCT piece) AS distinct_texts, true AS distinct_within, true AS median_within
    FROM (SELECT d.source, w.piece FROM windows w JOIN documents d USING (doc_id) WHERE length(piece) >= {MIN_CHARS}) GROUP BY source""",
)
def i60_source_sketches(spark, folder):
    """Distinct texts and the median length of each source from merged sketches of its documents, against the exact ones."""
    windows = unfold(
        table(spark, folder, "documents").select("doc_id", "source", F.filter(chunking.window_chunks(F.col("text"), SIZE, OVERLAP), lambda p: F.length(p) >= MIN_CHARS).alias("c")),
        "c", "text", "doc_id", "source",
    )
    # As if ingested in two runs: sketches per source and run, then merged.
    parts = sketches.of_sources(windows.withColumn("run", F.concat_ws(":", "source", F.col("doc_id") % 2)), "run")
    parts = parts.withColumn("source", F.substring_index("run", ":", 1)).drop("run")
    told = sketches.overview(sketches.merged(parts, "source"), (0.5,))
    rows = windows.join(told.select("source", F.col("distinct_texts").alias("guess"), F.col("length_quantiles")[0].alias("median")), "source")
    exact = rows.groupBy("source", "guess", "median").agg(
        F.count("*").alias("n"), F.countDistinct("text").alias("distinct_texts"),
        F.avg((F.length("text") < F.col("median")).cast("int")).alias("below"), F.avg((F.length("text") <= F.col("median")).cast("int")).alias("upto"),
    )
    return exact.select(
        "source", "n", "distinct_texts",
        (F.abs(F.col("guess") - F.col("distinct_texts")) <= sketches.DISTINCT_BOUND * F.col("distinct_texts")).alias("distinct_within"),
        ((F.col("below") <= 0.5 + sketches.RANK_BOUND) & (F.col("upto") >= 0.5 - sketches.RANK_BOUND)).alias("median_within"),
    )
