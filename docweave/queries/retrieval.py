"""Embedding cache, vector table, search, ranking, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import ids
from docweave.functions import vectors as vx
from docweave.operators import agent, cells, chunking, embedding, ranking, store
from docweave.operators.search import search, top_k
from docweave.operators.unfold import unfold
from docweave.queries.common import query, sql_strip, table
from docweave.queries.ingestion import MIN_CHARS, OVERLAP, SIZE, STEP, WINDOWS_SQL
from docweave.session import written

PREFIX = f"{vx.PROVIDER}|{vx.MODEL}|{vx.DIM}|"
BACKEND = embedding.BUILTIN


# Embedding cache


@query("i66_cache_key", f"SELECT doc_id, sha256('{PREFIX}' || text) AS key FROM documents")
def i66_cache_key(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", ids.cache_key(F.col("text"), vx.PROVIDER, vx.MODEL, vx.DIM).alias("key")
    )


def _texts(spark, folder):
    return table(spark, folder, "documents", "doc_id", "text", heavy=True)


def _cached(spark, folder):
    """A cache that already holds the texts of every third document."""
    known = table(spark, folder, "documents").where(F.pmod("doc_id", F.lit(3)) == 0).select("text")
    return embedding.new_entries(known, None, BACKEND)


CACHED_SQL = f"""
lookups AS (
  SELECT d.doc_id, sha256('{PREFIX}' || d.text) IN
         (SELECT sha256('{PREFIX}' || text) FROM documents WHERE doc_id % 3 = 0) AS hit FROM documents d)"""


@query("i67_cache_hits", f"WITH {CACHED_SQL} SELECT doc_id, hit FROM lookups")
def i67_cache_hits(spark, folder):
    return embedding.cache_hits(_texts(spark, folder), _cached(spark, folder), BACKEND, ["doc_id"]).select(
        "doc_id", "hit"
    )


@query(
    "i68_cache_put",
    f"""
    SELECT DISTINCT sha256('{PREFIX}' || text) AS key,
           max(CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END) OVER (PARTITION BY text) = 'old'
             AND bool_and(doc_id % 2 <> 0) OVER (PARTITION BY text) AS kept_old
    FROM documents""",
)
def i68_cache_put(spark, folder):
    """Entries of odd documents in the cache, those of even documents written over them."""
    docs = embedding.keyed(_texts(spark, folder), BACKEND)
    odd = F.pmod("doc_id", F.lit(2)) != 0
    old = docs.where(odd).select("key", F.lit(True).alias("kept_old")).distinct()
    new = docs.where(~odd).select("key", F.lit(False).alias("kept_old")).distinct()
    return embedding.cache_put(old, new)


@query(
    "i69_cache_stats",
    f"""
    WITH {CACHED_SQL}
    SELECT (SELECT count(DISTINCT text) FROM documents WHERE doc_id % 3 = 0) AS rows,
           count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses,
           round(count(*) FILTER (hit) / count(*), 3) AS hit_rate
    FROM lookups""",
)
def i69_cache_stats(spark, folder):
    cache = _cached(spark, folder).select("key")
    hits = embedding.cache_hits(_texts(spark, folder), cache, BACKEND, ["doc_id"])
    return embedding.cache_stats(hits, cache)


def sql_vectors(source: str, id_expr: str, text: str) -> str:
    """CTEs tok, cnt and vec: hashed unit vectors of a (id, text) query, stored as 32-bit floats."""
    return f"""
    tok AS (SELECT id, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+')) AS w
            FROM (SELECT {id_expr} AS id, {text} AS t FROM {source})),
    cnt AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {vx.DIM} AS b, count(*)::DOUBLE AS n FROM tok GROUP BY ALL),
    vec AS (SELECT id, b, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x FROM cnt)"""


@query(
    "i70_embed_rows",
    f"""
    WITH {sql_vectors("documents", "doc_id", "text")}
    SELECT d.doc_id, CAST(count(b) AS BIGINT) AS filled, round(coalesce(sum(x * (b + 1)), 0), 5) AS digest
    FROM documents d LEFT JOIN vec ON vec.id = d.doc_id GROUP BY d.doc_id""",
)
def i70_embed_rows(spark, folder):
    """Cached vectors taken, the rest embedded once per distinct text, every row served."""
    rows = embedding.embed_rows(_texts(spark, folder), ["doc_id"], BACKEND, _cached(spark, folder))
    filled = F.size(F.filter("vector", lambda x: x != 0)).cast("bigint")
    digest = F.aggregate(
        F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return rows.select("doc_id", filled.alias("filled"), F.round(digest, 5).alias("digest"))


# Error handling


MESSAGES_SQL = """
messages AS (
  SELECT event_id, CASE event_id % 8
    WHEN 0 THEN '429 Too Many Requests: retryDelay: "' || CAST(floor(value) AS INT) || 's"'
    WHEN 1 THEN 'Please retry in ' || CAST(floor(value) AS INT) || '.5 s, quota for ' || event_type
    WHEN 2 THEN 'Retry-After: ' || CAST(floor(value) AS INT)
    WHEN 3 THEN 'INVALID_ARGUMENT: batch size ' || user_id
    WHEN 4 THEN 'Invalid API key for user ' || event_type
    WHEN 5 THEN 'Connection reset, rate limit, retry in ' || CAST(floor(value * 10) AS INT) || 's'
    WHEN 6 THEN event_type || ' ' || props
    ELSE 'service unavailable (503)' END AS message,
    CAST(event_id % 6 + 1 AS INT) AS attempt
  FROM events)"""


def error_messages(spark, folder):
    whole = F.floor("value").cast("int").cast("string")
    texts = [
        F.concat(F.lit('429 Too Many Requests: retryDelay: "'), whole, F.lit('s"')),
        F.concat(F.lit("Please retry in "), whole, F.lit(".5 s, quota for "), "event_type"),
        F.concat(F.lit("Retry-After: "), whole),
        F.concat(F.lit("INVALID_ARGUMENT: batch size "), F.col("user_id").cast("string")),
        F.concat(F.lit("Invalid API key for user "), "event_type"),
        F.concat(
            F.lit("Connection reset, rate limit, retry in "),
            F.floor(F.col("value") * 10).cast("int").cast("string"),
            F.lit("s"),
        ),
        F.concat("event_type", F.lit(" "), "props"),
        F.lit("service unavailable (503)"),
    ]
    return table(spark, folder, "events").select(
        "event_id",
        F.get(F.array(*texts), F.pmod("event_id", F.lit(8)).cast("int")).alias("message"),
        (F.pmod("event_id", F.lit(6)) + 1).cast("int").alias("attempt"),
    )


def _sql_contains(markers):
    return "(" + " OR ".join(f"contains(lower(message), '{m}')" for m in markers) + ")"


def _sql_waits():
    from docweave.functions import rules

    one = r"nullif(regexp_extract(message, '(?i)retryDelay[''\"]?\s*[:=]\s*[''\"]?(\d+(?:\.\d+)?)s', 1), '')::DOUBLE"
    two = r"nullif(regexp_extract(message, '(?i)retry\s+in\s+(\d+(?:\.\d+)?)\s*s', 1), '')::DOUBLE"
    three = r"nullif(regexp_extract(message, '(?i)retry[-_ ]?after[''\"]?\s*[:=]\s*[''\"]?(\d+(?:\.\d+)?)', 1), '')::DOUBLE"
    return f"""
    WITH {MESSAGES_SQL},
    asked AS (SELECT *, least(120.0::DOUBLE, greatest({one}, {two}, {three})) AS retry_after,
                     {_sql_contains(rules.EMBEDDING_BATCH)} AS batch, {_sql_contains(rules.EMBEDDING_RETRYABLE)} AS again
              FROM messages)
    SELECT event_id, retry_after,
           CASE WHEN batch AND attempt > 1 THEN 'split' WHEN again AND attempt < 5 THEN 'retry' ELSE 'fail' END AS step,
           greatest(nullif(retry_after, 0) + 1, least(60.0::DOUBLE, pow(2.0, attempt))) AS batch_wait,
           CASE WHEN coalesce(retry_after, 0) = 0 THEN least(30.0::DOUBLE, pow(2.0, attempt))
                ELSE least(greatest(retry_after, least(30.0::DOUBLE, pow(2.0, attempt))), 20.0::DOUBLE) END AS query_wait
    FROM asked"""


@query("i72_74_error_waits", _sql_waits())
def i72_74_error_waits(spark, folder):
    """Retry, split or fail, and how long to wait (without the random part)."""
    message, attempt, none = F.col("message"), F.col("attempt"), F.lit(0.0)
    return error_messages(spark, folder).select(
        "event_id",
        embedding.retry_after(message).alias("retry_after"),
        embedding.next_step(message, attempt, attempt, F.lit(0)).alias("step"),
        embedding.batch_wait(message, attempt, none).alias("batch_wait"),
        embedding.query_wait(message, attempt, none).alias("query_wait"),
    )


@query(
    "i76_unit_vectors",
    """
    WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS len
               FROM embeddings)
    SELECT vec_id, round(len, 6) AS length,
           round(sqrt(list_sum(list_transform(embedding, lambda x: (x / len) * (x / len)))), 6) AS unit_length,
           round(embedding[1] / len, 6) AS first_value
    FROM n""",
)
def i76_unit_vectors(spark, folder):
    scaled = vx.unit(F.col("embedding"))
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.round(vx.norm(F.col("embedding")), 6).alias("length"),
        F.round(vx.norm(scaled), 6).alias("unit_length"),
        F.round(F.get(scaled, F.lit(0)), 6).alias("first_value"),
    )


# Search over the given vectors: one question per label, the mean of the label's vectors.

DIM = 64
QUESTIONS_SQL = """
parts AS (SELECT label, i, avg(x::DOUBLE) AS m
          FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
          GROUP BY label, i),
q AS (SELECT label AS qid, list(m ORDER BY i) AS v FROM parts GROUP BY label),
scored AS (SELECT q.qid, e.vec_id AS id, e.label, round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 8) AS score
           FROM q, embeddings e)"""


def label_questions(spark, folder):
    """Mean vector per label, summed per dimension so that a frequent label is reduced early."""
    vectors = table(spark, folder, "embeddings").select("label", "embedding")
    means = vectors.groupBy("label").agg(
        *[F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"m{i}") for i in range(DIM)]
    )
    return means.select(F.col("label").alias("qid"), F.array(*[f"m{i}" for i in range(DIM)]).alias("vector"))


def _corpus(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("label"), "label").alias("source")
    )


def _rounded(found):
    return found.select("qid", "id", "rank", "score")


@query(
    "i78_top_k",
    f"""
    WITH {QUESTIONS_SQL}
    SELECT qid, id, CAST(rank AS INT) AS rank, score
    FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 20""",
)
def i78_top_k(spark, folder):
    return _rounded(top_k(label_questions(spark, folder), _corpus(spark, folder).drop("source"), DIM, 20))


@query(
    "i78_top_k_source",
    f"""
    WITH {QUESTIONS_SQL}
    SELECT qid, id, CAST(rank AS INT) AS rank, score
    FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
          FROM scored WHERE qid % 2 = 0 OR label = (qid + 1) % 10) WHERE rank <= 20""",
)
def i78_top_k_source(spark, folder):
    """Odd questions search one source only."""
    wanted = F.concat(F.lit("label"), F.pmod(F.col("qid") + 1, F.lit(10)).cast("string"))
    asked = label_questions(spark, folder).withColumn(
        "source_filter", F.when(F.pmod("qid", F.lit(2)) != 0, wanted)
    )
    return _rounded(top_k(asked, _corpus(spark, folder), DIM, 20))


@query(
    "i78_top_k_floor",
    f"""
    WITH {QUESTIONS_SQL}
    SELECT qid, id, CAST(rank AS INT) AS rank, score
    FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
          FROM scored WHERE score >= 0.3) WHERE rank <= 20""",
)
def i78_top_k_floor(spark, folder):
    """Scores below the floor are no results; the questions meet the vectors in the block form."""
    asked = label_questions(spark, folder)
    return _rounded(top_k(asked, _corpus(spark, folder).drop("source"), DIM, 20, floor=0.3, sent_values=0))


# Chunks of the documents as a vector table


def window_points(spark, folder):
    """Window chunks as rows of the vector table, without vectors."""
    docs = table(spark, folder, "documents", "doc_id", "text", heavy=True).select(
        "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"),
        F.filter(
            chunking.window_chunks(F.col("text"), SIZE, OVERLAP), lambda p: F.length(p) >= MIN_CHARS
        ).alias("c"),
    )
    rows = unfold(docs, "c", "text", "doc_id", "source", position="chunk_index")
    label = F.when(F.col("chunk_index") % 3 != 2, (F.col("chunk_index") + 1).cast("string"))
    return rows.withColumn("page_label", label).withColumn(
        "id", F.concat_ws(":", "source", "chunk_index")
    )


POINTS_SQL = f"""
{WINDOWS_SQL},
points AS (SELECT doc_id, 'doc_' || doc_id || '.txt' AS source, piece AS text,
                  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INT) AS chunk_index
           FROM windows WHERE length(piece) >= {MIN_CHARS}),
labelled AS (SELECT *, source || ':' || chunk_index AS id,
                    CASE WHEN chunk_index % 3 <> 2 THEN (chunk_index + 1)::VARCHAR END AS page_label FROM points)"""


@query(
    "i79_80_citations",
    f"""
    WITH {POINTS_SQL}
    SELECT id, md5(text) AS content_md5, coalesce(page_label, 'n/a') AS page_label,
           source || CASE WHEN page_label IS NULL THEN '' ELSE ' (p. ' || page_label || ')' END AS citation
    FROM labelled""",
)
def i79_80_citations(spark, folder):
    rows = store.with_defaults(window_points(spark, folder))
    return rows.select(
        "id",
        F.md5("content").alias("content_md5"),
        "page_label",
        store.citation(F.col("source"), F.col("page_label")).alias("citation"),
    )


@query(
    "i81_stats",
    f"WITH {POINTS_SQL} SELECT count(*) AS points, CAST({vx.DIM} AS INT) AS vectors_dim FROM points",
)
def i81_stats(spark, folder):
    points = window_points(spark, folder)
    return store.stats(points.withColumn("vector", vx.embed(F.col("text"))))


@query("i82_sources", f"WITH {POINTS_SQL} SELECT DISTINCT source FROM points")
def i82_sources(spark, folder):
    return store.list_sources(window_points(spark, folder))


def questions(spark, folder):
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def candidates(spark, folder, k=20):
    """(qid, question, id, source, chunk_index, page_label, content, score, rank)."""
    points = store.with_defaults(window_points(spark, folder))
    asked = questions(spark, folder)
    found = search(
        asked.select("qid", vx.embed(F.col("question")).alias("vector")),
        points.drop("doc_id").withColumn("vector", vx.embed(F.col("content"))),
        vx.DIM,
        k,
    )
    return found.join(asked, "qid")


SEARCH_SQL = f"""
{POINTS_SQL},
{sql_vectors("labelled", "id", "text").replace("tok AS", "ptok AS").replace("FROM tok", "FROM ptok").replace("cnt AS", "pcnt AS").replace("FROM cnt", "FROM pcnt").replace("vec AS", "pvec AS")},
{sql_vectors("benchmark", "item_id", "text").replace("tok AS", "qtok AS").replace("FROM tok", "FROM qtok").replace("cnt AS", "qcnt AS").replace("FROM cnt", "FROM qcnt").replace("vec AS", "qvec AS")},
pn AS (SELECT id, sqrt(sum(x * x)) AS len FROM pvec GROUP BY id),
qn AS (SELECT id, sqrt(sum(x * x)) AS len FROM qvec GROUP BY id),
dots AS (SELECT q.id AS qid, p.id, round(sum(q.x * p.x) / any_value(qn.len * pn.len), 8) AS score
         FROM qvec q JOIN pvec p ON q.b = p.b JOIN qn ON qn.id = q.id JOIN pn ON pn.id = p.id GROUP BY q.id, p.id),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM dots)
          WHERE rank <= 20),
words_q AS (SELECT item_id AS qid, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM benchmark),
rescored AS (
  SELECT f.qid, f.id, f.rank AS first_rank, l.source, coalesce(l.page_label, 'n/a') AS page_label, l.text,
         len(list_intersect(w, list_distinct(regexp_extract_all(lower(l.text), '[\\p{{L}}\\p{{N}}]+')))) / len(w) AS score
  FROM found f JOIN labelled l USING (id) JOIN words_q USING (qid)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, first_rank) AS rank
                        FROM rescored) WHERE rank <= 5)"""


@query(
    "i83_two_stage",
    f"""
    WITH {SEARCH_SQL}
    SELECT qid, id, CAST(rank AS INT) AS rank, score FROM best""",
)
def i83_two_stage(spark, folder):
    """Twenty nearest chunks per question, the best five by the second stage."""
    return _rounded(ranking.rerank(candidates(spark, folder)))


@query(
    "i85_retrieval_notes",
    f"""
    WITH {SEARCH_SQL},
    per AS (SELECT qid, count(*) AS n, list_sort(list(DISTINCT source)) AS s FROM best GROUP BY qid)
    SELECT b.item_id AS qid, 'Retrieval pass 1: ' || (SELECT count(*) FROM found f WHERE f.qid = b.item_id)
             || ' candidates → reranked to ' || n || ' | Sources: ' || array_to_string(s[1:4], ', ')
             || CASE WHEN len(s) > 4 THEN '...' ELSE '' END AS notes
    FROM benchmark b JOIN per ON per.qid = b.item_id""",
)
def i85_retrieval_notes(spark, folder):
    found = candidates(spark, folder)
    per = found.withColumn("n", F.count("*").over(_per_question()))
    top = ranking.rerank(per).groupBy("qid").agg(
        F.first("n").alias("n"), F.count("*").alias("kept"), F.array_sort(F.collect_set("source")).alias("s")
    )
    notes = agent.retrieval_notes(F.lit(1), F.col("n"), F.col("kept"), F.col("s"))
    return top.select("qid", F.array_join(notes, " | ").alias("notes"))


def _per_question():
    from pyspark.sql import Window

    return Window.partitionBy("qid")


def _sql_context(block, budget, extra=""):
    return f"""
    WITH {SEARCH_SQL},
    blocks AS (SELECT qid, rank, {block} AS b FROM best {extra}),
    summed AS (SELECT *, sum(length(b)) OVER (PARTITION BY qid ORDER BY rank) AS used,
                      row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM blocks),
    kept AS (SELECT * FROM summed WHERE place = 1 OR used <= {budget})
    SELECT qid, count(*) AS passages_used,
           md5(string_agg(b, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place)) AS context_md5
    FROM kept GROUP BY qid"""


@query(
    "i86_numbered_context",
    _sql_context(
        "'[' || rank || '] Source: ' || source || ' — page ' || page_label || ' (relevance '"
        " || printf('%.3f', score) || ')' || chr(10) || text",
        3000,
    ),
)
def i86_numbered_context(spark, folder):
    packed = ranking.context(ranking.rerank(candidates(spark, folder)), 3000)
    return packed.select("qid", "passages_used", F.md5("context").alias("context_md5"))


@query("i87_plain_context", _sql_context("text", 2500, f"WHERE {sql_strip('text')} <> ''"))
def i87_plain_context(spark, folder):
    packed = ranking.context(ranking.rerank(candidates(spark, folder)), 2500, numbered=False)
    return packed.select("qid", "passages_used", F.md5("context").alias("context_md5"))


@query(
    "i78_cells",
    """
    SELECT CAST(count(*) FILTER (vec_id % 20 = 0) AS BIGINT) AS questions, true AS recall_reached, true AS reads_less, true AS exact_with_all
    FROM embeddings WHERE len(embedding) = 64""",
)
def i78_cells(spark, folder):
    """The coarse index over all given vectors: measured recall of nine tenths, and the exact answer with all cells."""
    rows = table(spark, folder, "embeddings", "vec_id", "embedding").where(F.size("embedding") == 64)
    corpus = rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = written(corpus.where("id % 20 = 0").withColumnRenamed("id", "qid"), "asked")
    index = cells.CellIndex.build(corpus, 64)
    probes, recall = index.tuned(asked, 10)
    exact = written(top_k(asked, corpus, 64, 10).select("qid", "id"), "exact")
    every = index.search(asked, 10, len(index.centres)).select("qid", "id")
    missed = exact.join(every, ["qid", "id"], "left_anti").count()
    return asked.agg(F.count("*").alias("questions")).select(
        "questions", F.lit(recall >= 0.9).alias("recall_reached"), F.lit(index.read(asked, probes) < 1.0 or probes == len(index.centres)).alias("reads_less"),
        F.lit(missed == 0).alias("exact_with_all"),
    )
