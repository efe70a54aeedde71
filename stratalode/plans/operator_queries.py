"""One query for each group of operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import autotag as tagging
from ..operators import catalog, chunking, lexical, notebooks, retrieval, semantic, store, sync, tools, transcripts
from ..sources import files as sources
from . import adapters as A
from .function_queries import _flat, _pick, _pick_sql
from .queries import _DOCS, _FOLD, _HYBRID_SQL, _bm25_sql, _hybrid, _vector
from .registry import query


@query(f"WITH {_DOCS} SELECT doc_id, title FROM d WHERE active AND NOT local_only")
def scoped_documents(spark, sf_dir):
    return catalog.scoped(A.documents(spark, sf_dir), active=True, include_local_only=False).select("doc_id", "title")


@query(f"""WITH {_DOCS} SELECT row_number() OVER (ORDER BY translate(title, '{T.ASCII_UPPER}', '{T.ASCII_LOWER}'), doc_id) AS row, doc_id, title, source_path, count(*) OVER () AS total FROM d WHERE active QUALIFY row BETWEEN 11 AND 40""")
def corpus_listing(spark, sf_dir):
    got = catalog.corpus_listing(A.documents(spark, sf_dir), key="doc_id", limit=30, offset=10)
    return got.withColumn("row", F.col("row").cast("long"))


@query("""WITH s AS (SELECT conv_id AS session_id, count(*) AS chunk_count FROM conversations GROUP BY conv_id) SELECT row_number() OVER (ORDER BY chunk_count DESC, session_id) AS row, session_id, chunk_count FROM s QUALIFY row <= 20""")
def sessions_by_size(spark, sf_dir):
    counts = catalog.chunk_counts(A.turns(spark, sf_dir), key="session_id").withColumn("title", F.lit(""))
    return catalog.page(counts, sort="most-chunks", key="session_id", limit=20).select(F.col("row").cast("long").alias("row"), "session_id", "chunk_count")


@query("SELECT doc_id, lang FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 25")
def keyset_page(spark, sf_dir):
    return catalog.after_key(A.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100, 25)


@query("""SELECT count(*) FILTER (turn > 0) AS indexed, count(*) AS stored, CASE WHEN count(*) FILTER (turn > 0) = count(*) THEN 'ready' ELSE 'out-of-sync' END AS state FROM conversations UNION ALL SELECT count(*), count(*), 'ready' FROM conversations""")
def index_states(spark, sf_dir):
    t = A.turns(spark, sf_dir)
    return catalog.index_state(t.filter("turn > 0"), t).unionAll(catalog.index_state(t, t))


@query("SELECT 'all' AS kind, true AS same UNION ALL SELECT 'one less', false UNION ALL SELECT 'one twice', false")
def permutation_checks(spark, sf_dir):
    ids = A.table(spark, sf_dir, "documents").select("doc_id")
    cases = {"all": ids.orderBy(F.desc("doc_id")), "one less": ids.filter("doc_id != 3"), "one twice": ids.unionAll(ids.filter("doc_id = 3"))}
    parts = [catalog.same_ids(ids, other).select(F.lit(k).alias("kind"), "same") for k, other in cases.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(f"WITH {_DOCS} SELECT count(*) > 0 AS has_local_only FROM d WHERE local_only")
def local_only_exists(spark, sf_dir):
    return catalog.has_local_only(A.documents(spark, sf_dir))


@query("SELECT turn AS chunk_index, role FROM conversations WHERE conv_id = 2")
def recording_transcript(spark, sf_dir):
    rows = A.turns(spark, sf_dir).select(F.col("session_id").alias("document_id"), F.col("turn").alias("chunk_index"), "role")
    return catalog.transcript(rows, 2).select("chunk_index", "role")


@query("""WITH g AS (SELECT lang AS "group", count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY lang), p AS (SELECT lang AS "group", string_agg(concat('f', lpad(doc_id::VARCHAR, 8, '0')), ',' ORDER BY doc_id) AS pending FROM documents WHERE doc_id % 50 = 0 GROUP BY lang)
SELECT coalesce(g."group", p."group") AS "group", n, coalesce(pending, '') AS pending FROM g FULL JOIN p ON g."group" = p."group" """)
def pending_uploads(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").withColumn("group", F.col("lang"))
    groups = d.filter(F.col("lang").isin("en", "de")).groupBy("group").agg(F.count("*").alias("n"))
    waiting = d.filter("doc_id % 50 = 0").select("group", F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("name"))
    return catalog.pending_groups(groups, waiting).withColumn("pending", F.array_join("pending", ","))


@query("SELECT user_id AS chunk_id, min(event_id) AS position, arg_max(event_type, event_id) AS content FROM events GROUP BY user_id")
def rerank_input(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("position"), F.col("event_type").alias("content"))
    return retrieval.deduplicated(rows)


@query(f"""WITH f AS (SELECT conv_id * 1000 + turn AS chunk_id, {_flat('text')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, count(*) OVER (PARTITION BY conv_id) AS total_chunks FROM conversations)
SELECT chunk_id, position, total_chunks, concat('Page 1: ', CASE WHEN length(t) <= 200 THEN t ELSE concat(rtrim(substr(t, 1, 200)), '...') END) AS description FROM f""")
def source_cards(spark, sf_dir):
    rows = A.turns(spark, sf_dir).withColumnsRenamed({"id": "chunk_id", "turn": "chunk_index", "session_id": "document_id"}).withColumns({"page_index": F.lit(0), "source_type": F.lit("TEXT")})
    return retrieval.source_cards(rows, retrieval.positions(rows)).select("chunk_id", F.col("position").cast("long").alias("position"), "total_chunks", "description")


@query(f"{_HYBRID_SQL} SELECT 'semantic' AS method, rank, chunk_id FROM sem UNION ALL SELECT 'bm25', rank, chunk_id FROM lex")
def all_methods(spark, sf_dir):
    lists = {
        "semantic": lexical.ranked(semantic.search_semantic(A.vectors(spark, sf_dir), _vector(spark, sf_dir, 2), top_k=10), F.desc("score"), "chunk_id"),
        "bm25": lexical.ranked(lexical.search_bm25(A.chunks(spark, sf_dir), "tion ing", top_k=10), F.desc("score"), "chunk_id"),
    }
    return retrieval.all_methods(lists).select("method", F.col("rank").cast("long").alias("rank"), "chunk_id")


@query(f"""WITH {_bm25_sql(['tion', 'ing'])}, k AS (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 5)
SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id AS chunk_id, concat(source, '-', lang, '-', doc_id) AS title FROM k JOIN documents USING (doc_id) WHERE score >= greatest(0.35 * (SELECT max(score) FROM k), 0.8)""")
def retrieve_bm25(spark, sf_dir):
    chunks = A.chunks(spark, sf_dir)
    found = lexical.ranked(lexical.search_bm25(chunks, "tion ing", top_k=10), F.desc("score"), "chunk_id")
    got = retrieval.retrieve(found.limit(0), found, chunks, "tion ing", mode="bm25", confidence="medium", top_k=5)
    return retrieval.without_score(got).select(F.col("rank").cast("long").alias("rank"), "chunk_id", "title")


@query(_HYBRID_SQL + f""", r AS (SELECT chunk_id, position, list_distinct(list_filter(regexp_split_to_array({_FOLD}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS ws FROM c JOIN documents ON doc_id = chunk_id),
s AS (SELECT chunk_id, position, len(list_intersect(ws, ['tion', 'ing'])) / (len(ws) + 2.0 - len(list_intersect(ws, ['tion', 'ing']))) AS score FROM r)
SELECT row_number() OVER (ORDER BY score DESC, position) AS rank, chunk_id, round(score, 9) AS score FROM s QUALIFY rank <= 10""")
def retrieve_hybrid(spark, sf_dir):
    chunks = A.chunks(spark, sf_dir)
    near = lexical.ranked(semantic.search_semantic(A.vectors(spark, sf_dir), _vector(spark, sf_dir, 2), top_k=10), F.desc("score"), "chunk_id")
    found = lexical.ranked(lexical.search_bm25(chunks, "tion ing", top_k=10), F.desc("score"), "chunk_id")
    got = retrieval.retrieve(near, found, chunks, "tion ing", mode="hybrid", top_k=10)
    return got.select(F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 9).alias("score"))


@query("""WITH p AS (SELECT conv_id, turn, lower(concat('Talk ', conv_id)) AS b, lower(concat(role, ' ', turn)) AS t, lower(text) AS x FROM conversations),
f AS (SELECT *, (length(x) - length(replace(x, 'the', ''))) // 3 + (length(x) - length(replace(x, 'user', ''))) // 4 AS c FROM p WHERE contains(concat(b, chr(10), t, chr(10), x), 'the') AND contains(concat(b, chr(10), t, chr(10), x), 'user')),
s AS (SELECT *, (CASE WHEN contains(t, 'user') THEN 5 ELSE 0 END + CASE WHEN contains(t, 'the') THEN 5 ELSE 0 END + least(c, 20)) AS score FROM f)
SELECT row_number() OVER (ORDER BY score DESC, b, t) AS rank, conv_id AS session_id, turn FROM s QUALIFY rank <= 50""")
def notebook_search_order(spark, sf_dir):
    pages = A.turns(spark, sf_dir).withColumns({"notebook_title": F.concat(F.lit("Talk "), F.col("session_id").cast("string")), "page_title": F.concat_ws(" ", "role", F.col("turn").cast("string"))})
    found = notebooks.search_pages(pages, "the User", limit=50)
    return lexical.ranked(found, F.desc("score"), F.lower("notebook_title"), F.lower("page_title")).select(F.col("rank").cast("long").alias("rank"), "session_id", "turn")


@query("""WITH a AS (SELECT DISTINCT label AS d FROM embeddings), g AS (SELECT label AS d, count(*) AS n FROM embeddings WHERE vec_id % 97 = 0 GROUP BY label)
SELECT coalesce(sum(n), 0)::BIGINT AS applied, count(n) AS tagged, (SELECT count(*) FROM a) - count(n) AS unchanged, (SELECT count(*) FROM a WHERE d % 2 = 0) AS skipped FROM g""")
def autotag_totals(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    documents = v.select("document_id").unionAll(v.filter("document_id % 2 = 0").select(F.col("document_id") + 1_000_000))
    return tagging.totals(documents, v, v.filter("chunk_id % 97 = 0").select("document_id"))


@query("""SELECT n_name AS text, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 4 = 0 ELSE false END AS done FROM nation""")
def goal_states(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation")
    wanted = n.select(F.col("n_name").alias("text"), F.lit(None).cast("boolean").alias("done"))
    return notebooks.goals(wanted, n.filter("n_nationkey % 2 = 0").select(F.concat(F.lit(" "), F.lower("n_name")).alias("text"), (F.col("n_nationkey") % 4 == 0).alias("done"))).select("text", "done")


@query("SELECT count(*) FILTER (n_nationkey % 4 = 0) AS done, count(*) FILTER (n_nationkey % 4 <> 0) AS remaining FROM nation")
def goal_counts(spark, sf_dir):
    return notebooks.goal_counts(A.table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 4 == 0).alias("done")))


@query(f"""WITH {_DOCS} SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE title END AS title, local_only, doc_id AS created_at, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS chunk_count FROM d""")
def stored_documents(spark, sf_dir):
    docs = A.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "title", "local_only", F.col("doc_id").alias("created_at"))
    chunks = docs.select(F.col("id").alias("document_id"), F.lit(0).alias("chunk_index"))
    new = docs.filter("id % 4 = 0").withColumns({"title": F.lit("new"), "local_only": F.lit(False), "created_at": F.lit(-1).cast("long")})
    pieces = new.select(F.col("id").alias("document_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"))
    kept, parts = store.stored(docs, chunks, new, pieces)
    return kept.join(catalog.chunk_counts(parts, key="document_id").withColumnRenamed("document_id", "id"), "id")


@query(f"""WITH {_DOCS}, t AS (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id FROM labels WHERE quality = 0)
SELECT 'documents' AS part, count(*) AS n FROM d WHERE doc_id % 6 <> 1 UNION ALL SELECT 'chunks', count(*) FROM d WHERE doc_id % 6 <> 1 UNION ALL SELECT 'tags', count(*) FROM t WHERE doc_id % 6 <> 1
UNION ALL SELECT 'ignored', count(*) FROM d WHERE doc_id % 3 = 0 AND doc_id % 6 = 1 OR doc_id % 4 = 1 AND doc_id % 6 = 1 UNION ALL SELECT 'synced', count(*) FROM d WHERE doc_id % 4 = 1 AND doc_id % 6 <> 1""")
def removed_documents(spark, sf_dir):
    docs = A.documents(spark, sf_dir).select(F.col("doc_id").alias("id"))
    chunks = docs.select(F.col("id").alias("document_id"))
    tags = A.document_tags(spark, sf_dir).withColumnRenamed("doc_id", "document_id")
    files = docs.filter("id % 4 = 1").select(F.concat(F.lit("f/"), F.col("id").cast("string")).alias("path"), F.lit("synced").alias("state"), F.col("id").alias("document_id"), F.lit("m").alias("managed_path"))
    got = store.removed(docs.filter("id % 6 = 1"), docs, chunks, tags, files)
    parts = [got[k].select(F.lit(k).alias("part")) for k in ("documents", "chunks", "tags")] + [got["files"].select(F.col("state").alias("part"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey IN (1, 3, 5) THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation")
def changed_rows(spark, sf_dir):
    rows = A.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return store.changed(rows, {"n_name": F.concat(F.upper("n_name"), F.lit("!"))}, [1, 3, 5], key="n_nationkey")


@query("""WITH t AS (SELECT doc_id, lang AS tag FROM documents UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'low-quality' FROM labels WHERE quality = 0)
SELECT doc_id AS document_id, tag FROM (SELECT * FROM t UNION SELECT unnest([1, 2, 3]), 'x' UNION SELECT unnest([1, 2, 3]), 'en') WHERE NOT (doc_id IN (2, 4) AND tag IN ('x', 'de'))""")
def tag_assignment(spark, sf_dir):
    tags = A.document_tags(spark, sf_dir).withColumnRenamed("doc_id", "document_id")
    return store.unassigned(store.assigned(tags, [1, 2, 3], ["x", "en"]), [2, 4], ["x", "de"])


@query("SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'X' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (5, 6) UNION ALL SELECT 99, 'NEW', NULL")
def settings_rows(spark, sf_dir):
    rows = A.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = store.put(store.put(rows, {"n_nationkey": 3, "n_name": "X"}, key="n_nationkey"), {"n_nationkey": 99, "n_name": "NEW"}, key="n_nationkey")
    return store.deleted(rows, [5, 6], key="n_nationkey")


@query("SELECT conv_id * 1000 + turn AS tool_call_id, a.text AS content, (SELECT b.text FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant') AS result FROM conversations a WHERE role = 'user'")
def call_results(spark, sf_dir):
    t = A.turns(spark, sf_dir)
    calls = t.filter("role = 'user'").select(F.col("id").alias("tool_call_id"), "content")
    return store.tool_results(calls, t.filter("role = 'assistant'").select((F.col("id") - 1).alias("tool_call_id"), "content"))


@query("""SELECT event_id AS pos, round(value * 1000)::BIGINT AS start_ms, greatest(round(value * 1000), round((value + (event_id % 5 - 1) * 0.25::DOUBLE) * 1000))::BIGINT AS end_ms, event_type AS text FROM events WHERE event_id % 7 <> 0""")
def speech_segments(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type", F.lit("\n")))
    raw = e.select(F.col("user_id").alias("recording"), F.col("event_id").alias("pos"), F.col("value").alias("start_s"), (F.col("value") + (F.col("event_id") % 5 - 1) * 0.25).alias("end_s"), text.alias("text"))
    return transcripts.normalized_segments(raw).select("pos", "start_ms", "end_ms", "text")


@query("""SELECT user_id, event_id AS pos, event_type AS language FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN starts_with(event_type, 'e') THEN 0 ELSE 1 END, event_id % 2, event_id) = 1""")
def caption_tracks(spark, sf_dir):
    tracks = A.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.regexp_replace("event_type", "^e", "en").alias("language"), (F.col("event_id") % 2 == 1).alias("generated"))
    return transcripts.caption_track(tracks, by="user_id").select("user_id", "pos", F.regexp_replace("language", "^en", "e").alias("language"))


@query(f"""WITH s AS (SELECT conv_id, turn AS pos, role, {_flat('text')} AS t FROM conversations), k AS (SELECT * FROM s WHERE t <> ''),
g AS (SELECT *, CASE WHEN pos = min(pos) OVER (PARTITION BY conv_id) OR role = lag(role) OVER (PARTITION BY conv_id ORDER BY pos) THEN 0 ELSE 1 END AS ch FROM k),
n AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY pos) AS turn FROM g),
c AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM n),
r AS (SELECT conv_id, turn, min(pos) AS pos FROM c WHERE 40 < greatest(a + length(t), a + 1) GROUP BY ALL),
h AS (SELECT c.conv_id, c.turn, CASE WHEN 40 <= a THEN c.pos * 1000 ELSE floor(c.pos * 1000 + 900 * ((40 - a) / greatest(length(t), 1)) + 0.5) END AS at_ms FROM c JOIN r USING (conv_id, turn, pos)),
w AS (SELECT conv_id, turn, any_value(role) AS speaker, sha256(string_agg(t, ' ' ORDER BY pos)) AS digest, max(pos) * 1000 + 900 AS last_ms FROM c GROUP BY ALL)
SELECT conv_id AS session_id, turn::BIGINT AS turn, speaker, digest, coalesce(at_ms, last_ms)::BIGINT AS at_ms FROM w LEFT JOIN h USING (conv_id, turn)""")
def turn_timelines(spark, sf_dir):
    rows = A.turns(spark, sf_dir).select("session_id", F.col("turn").alias("pos"), F.col("role").alias("speaker"), F.col("content").alias("text"), (F.col("turn") * 1000).cast("long").alias("start_ms"), (F.col("turn") * 1000 + 900).cast("long").alias("end_ms"))
    turns = transcripts.turn_texts(rows, by="session_id", order="pos")
    return turns.select("session_id", F.col("turn").cast("long").alias("turn"), "speaker", F.sha2("content", 256).alias("digest"), transcripts.time_at(F.col("timeline"), F.lit(40)).alias("at_ms"))


@query("""WITH p AS (SELECT user_id AS d, (event_id % 3)::INT AS page, event_id AS piece, CASE event_id % 4 WHEN 0 THEN 'only four words here' WHEN 1 THEN '' ELSE concat('five words of text ', event_id % 6) END AS c FROM events),
f AS (SELECT * FROM p WHERE c LIKE 'five%' QUALIFY row_number() OVER (PARTITION BY d, page, c ORDER BY piece) = 1), n AS (SELECT *, row_number() OVER (PARTITION BY d, page ORDER BY piece) - 1 AS i FROM f)
SELECT d AS document_id, page AS page_index, i::INT AS chunk_index, c AS content, sha256(concat_ws(chr(10), concat('s', d), page, i, 'TEXT', c)) AS chunk_id FROM n""")
def assembled_chunks(spark, sf_dir):
    k = F.col("event_id")
    content = F.when(k % 4 == 0, "only four words here").when(k % 4 == 1, " ").otherwise(F.concat(F.lit("five words of text "), (k % 6).cast("string"), F.lit(" ")))
    pieces = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("source"), F.lit("TEXT").alias("chunk_type"), (k % 3).cast("int").alias("page_index"), k.alias("piece"), content.alias("content"))
    return chunking.assembled(pieces).select("document_id", "page_index", "chunk_index", "content", "chunk_id")


@query("""WITH u AS (SELECT concat('u/', doc_id) AS path, sha256(text) AS h FROM documents), t AS (SELECT sha256(text) AS h, min(concat('t/', doc_id)) AS owner FROM documents WHERE n_chars % 3 = 0 GROUP BY 1),
r AS (SELECT path, coalesce(owner, min(path) OVER (PARTITION BY u.h)) AS o FROM u LEFT JOIN t USING (h)) SELECT path, CASE WHEN o = path THEN 'synced' ELSE 'duplicate' END AS state, CASE WHEN o <> path THEN o END AS message FROM r""")
def ingest_outcomes(spark, sf_dir):
    d, name = A.table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    uploads = d.select(F.concat(F.lit("u/"), name).alias("path"), F.lit(0).alias("last_modified"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("content_hash"))
    tracked = d.filter("n_chars % 3 = 0").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min(F.concat(F.lit("t/"), name)).alias("path")).withColumn("state", F.lit("synced"))
    return sync.ingested(uploads, tracked).select("path", "state", "message")


@query("""SELECT concat('f/', doc_id) AS path FROM documents WHERE doc_id % 5 <> 0 AND NOT (doc_id % 5 = 1 AND doc_id % 3 = 0)""")
def freed_duplicates(spark, sf_dir):
    k = F.col("doc_id")
    name = lambda x: F.concat(F.lit("f/"), x.cast("string"))
    duplicate = (k % 5 == 1) & (k % 3 == 0)
    tracked = A.table(spark, sf_dir, "documents").select(name(k).alias("path"), F.when(duplicate, "duplicate").otherwise("synced").alias("state"), F.when(duplicate, name(k - 1)).alias("message"))
    gone = A.table(spark, sf_dir, "documents").filter("doc_id % 5 = 0").select(name(k).alias("path"))
    return sync.freed_duplicates(tracked, gone).select("path")


@query("""WITH c AS (SELECT event_id AS seq, user_id AS document_id, user_id * 10 + event_id % 5 AS chunk_id, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'put' END AS kind, event_type <> 'signup' AS live, value FROM events WHERE event_id % 9 = 0),
r AS (SELECT document_id, max(seq) AS r FROM c WHERE kind = 'remove' GROUP BY 1), n AS (SELECT document_id, chunk_id, arg_max(live, seq) AS live, arg_max(value, seq) AS value FROM c LEFT JOIN r USING (document_id) WHERE kind = 'put' AND (r IS NULL OR seq > r) GROUP BY ALL),
i AS (SELECT DISTINCT user_id AS document_id, user_id * 10 + event_id % 5 AS chunk_id, 0.0::DOUBLE AS value FROM events)
SELECT document_id, chunk_id, value FROM n WHERE live UNION ALL SELECT * FROM i WHERE document_id NOT IN (SELECT document_id FROM r) AND chunk_id NOT IN (SELECT chunk_id FROM c WHERE kind = 'put')""")
def applied_changes(spark, sf_dir):
    log = A.change_log(spark, sf_dir)
    index = log.select("document_id", "chunk_id", F.lit(0.0).alias("value")).distinct()
    return sync.applied(index, log.filter("seq % 9 = 0"), "stand-in/64")


@query("SELECT conv_id * 1000 + turn AS id, concat('c', turn) AS chunk_id FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id * 1000 + turn, 'd' FROM conversations WHERE role = 'assistant'")
def message_sources(spark, sf_dir):
    out = lambda kind, chunk: F.struct(F.lit(kind).alias("type"), chunk.alias("chunkId"))
    outputs = F.array(out("source", F.concat(F.lit("c"), F.col("turn").cast("string"))), out("chart", F.lit("x")), out("source", F.lit("d")), out("source", F.lit(None).cast("string")))
    rows = A.turns(spark, sf_dir).select("id", F.when(F.col("role") == "assistant", F.to_json(F.struct(outputs.alias("outputs")))).otherwise("{}").alias("metadata"))
    return notebooks.sources_of(rows)


@query("SELECT conv_id AS session_id, sha256(string_agg(text, '' ORDER BY turn)) AS content, sha256(string_agg(CASE WHEN role = 'user' THEN role ELSE '' END, '' ORDER BY turn)) AS reasoning FROM conversations GROUP BY conv_id")
def stream_folds(spark, sf_dir):
    deltas = A.turns(spark, sf_dir).withColumn("reasoning", F.when(F.col("role") == "user", F.col("role")))
    return notebooks.streamed_turns(deltas, by=["session_id"], order="turn").select("session_id", F.sha2("content", 256).alias("content"), F.sha2("reasoning", 256).alias("reasoning"))


@query("SELECT row_number() OVER (ORDER BY CASE WHEN starts_with(lower(p_name), 'co') THEN 0 ELSE 1 END, p_name) AS place, p_name AS name FROM (SELECT DISTINCT p_name FROM part) WHERE contains(lower(p_name), 'co')")
def skill_matches(spark, sf_dir):
    skills = A.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    found = tools.matching_skills(skills, "CO")
    return lexical.ranked(found, (~F.lower("name").startswith("co")).cast("int"), "name", name="place").select(F.col("place").cast("long").alias("place"), "name")


@query("SELECT DISTINCT p_name AS name FROM part WHERE p_name = (SELECT min(p_name) FROM part WHERE length(p_name) % 2 = 0)")
def skill_lookup(spark, sf_dir):
    skills = A.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("model_invocable", F.char_length("name") % 2 == 0)
    return tools.skill(skills, skills.filter("model_invocable").agg(F.min("name")).first()[0] or "").select("name")


@query("""SELECT n_nationkey, concat('text of ', n_name, chr(10), chr(10), '## Citations', chr(10), chr(10), '| Source | Page |', chr(10), '| --- | --- |', chr(10), '| [a](x) | 1 |', chr(10), '| [', n_name, '](y) | 2 |') AS content FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, concat('text of ', n_name) FROM nation WHERE n_nationkey % 2 = 1""")
def citation_tables(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation")
    pages = n.select("n_nationkey", F.concat(F.lit("text of "), "n_name").alias("content"))
    listed = F.array(F.lit("| [a](x) | 1 |"), F.concat(F.lit("| ["), "n_name", F.lit("](y) | 2 |")), F.lit("| [again](x) | 3 |"))
    rows = n.filter("n_nationkey % 2 = 0").select("n_nationkey", F.posexplode(listed).alias("position", "row"))
    return notebooks.citations_added(pages, rows, key="n_nationkey")


@query("""SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_nationkey = 3 THEN '0' ELSE n_regionkey::VARCHAR END AS notebook_id, CASE WHEN n_nationkey = 3 THEN 'Page 2' ELSE 'page' END AS title, CASE WHEN n_nationkey = 3 THEN (SELECT max(n_nationkey) + 1 FROM nation WHERE n_regionkey = 0) ELSE n_nationkey END::INT AS sort_order FROM nation""")
def moved_pages(spark, sf_dir):
    k = F.col("n_nationkey")
    pages = A.table(spark, sf_dir, "nation").select(k.cast("string").alias("id"), F.col("n_regionkey").cast("string").alias("notebook_id"), F.when(k == 3, "Page").otherwise("page").alias("title"), k.cast("int").alias("sort_order"))
    return notebooks.moved_page(pages, "3", "0")


_EXTENSIONS = [".pdf", ".AIF", ".aiff", ".oga", ".mp4", ".txt", ".webm", ".exe", "", ".md", ".XLSX", ".csv"]


@query(f"""SELECT doc_id, doc_id % 12 NOT IN (4, 7, 8) AS known, {_pick_sql('doc_id', ['PDF', 'AUDIO', 'AUDIO', 'AUDIO', None, 'TEXT', 'AUDIO', None, None, 'TEXT', 'XLSX', 'CSV'])} AS kind, doc_id % 12 NOT IN (4, 7, 8, 11) AND NOT coalesce(toxic, 0) = 1 AS embeds FROM documents LEFT JOIN labels USING (doc_id)""")
def file_kinds(spark, sf_dir):
    path = F.concat(F.lit("f/x."), F.col("doc_id").cast("string"), _pick(F.col("doc_id"), _EXTENSIONS))
    kind = sources.source_type(path)
    return A.documents(spark, sf_dir).select("doc_id", sync.ingestable(path).alias("known"), kind.alias("kind"), F.coalesce(store.embeds(kind, F.col("local_only"), True), F.lit(False)).alias("embeds"))


@query(f"""SELECT doc_id, {_pick_sql('doc_id', ['no PDF header', None, 'no zip header', None, 'binary content', None, 'empty audio', 'audio over 100 MB'])} AS reason FROM documents""")
def file_checks(spark, sf_dir):
    k = F.col("doc_id")
    heads = ["xPDF", "%PDF-1.7", "PKxx", "PK\x03\x04x", "a\x00b", "plain", "", "ID3"]
    files = A.table(spark, sf_dir, "documents").select("doc_id", _pick(k, heads).cast("binary").alias("content"), F.when(k % 8 == 7, 200 << 20).otherwise(F.when(k % 8 == 6, 0).otherwise(9)).cast("long").alias("length"), _pick(k, ["PDF", "PDF", "DOCX", "XLSX", "CSV", "TEXT", "AUDIO", "AUDIO"]).alias("source_type"))
    return sources.rejected(files).select("doc_id", "reason")


_STUB = '{"compacted":true,"note":"' + notebooks.NOTE + '"}'


@query(f"""WITH m AS (SELECT conv_id, turn, turn % 2 = 1 AS tool, text AS c, length(text) AS l FROM conversations),
w AS (SELECT *, sum(tool::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS late, sum(l + 4) OVER (PARTITION BY conv_id) - 900 AS excess FROM m),
s AS (SELECT *, tool AND late > 2 AND l > 320 AS able, CASE WHEN tool AND late > 2 AND l > 320 THEN l - {len(_STUB)} ELSE 0 END AS saving FROM w),
b AS (SELECT *, coalesce(sum(saving) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT conv_id AS session_id, turn, sha256(CASE WHEN able AND before < excess THEN '{_STUB}' ELSE c END) AS digest FROM b""")
def compacted_transcripts(spark, sf_dir):
    rows = A.turns(spark, sf_dir).withColumns({"role": F.when(F.col("turn") % 2 == 1, "tool").otherwise("user"), "name": F.lit(None).cast("string"), "reasoning": F.lit("hmm."), "tool_calls": F.lit(None).cast("string")})
    return notebooks.compacted(rows, by="session_id", order="turn", budget=900).select("session_id", "turn", F.sha2("content", 256).alias("digest"))


@query("SELECT conv_id AS session_id, sum(length(text) + length(role) + CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END)::BIGINT AS chars FROM conversations GROUP BY conv_id")
def message_sizes(spark, sf_dir):
    rows = A.turns(spark, sf_dir).withColumns({"reasoning": F.col("role"), "tool_calls": F.when(F.col("turn") % 2 == 0, "[]")})
    return notebooks.message_sizes(rows, by="session_id")


_FOLDERS = """f AS (SELECT concat('f/', doc_id) AS path, concat('folder', doc_id % 7) AS folder_id, CASE WHEN doc_id % 11 = 0 THEN 'malformed' ELSE 'synced' END AS state, CASE WHEN doc_id % 11 <> 0 THEN doc_id END AS document_id FROM documents WHERE doc_id % 3 <> 0)"""


def _folder_files(spark, sf_dir):
    k, sound = F.col("doc_id"), F.col("doc_id") % 11 != 0
    return A.table(spark, sf_dir, "documents").filter("doc_id % 3 != 0").select(F.concat(F.lit("folder"), (k % 7).cast("string")).alias("folder_id"), F.when(sound, "synced").otherwise("malformed").alias("state"), F.when(sound, k).alias("document_id"))


@query(f"""WITH {_DOCS}, {_FOLDERS}, g AS (SELECT coalesce(folder_id, CASE origin WHEN 'MANUAL' THEN 'manual' ELSE 'individual' END) AS "group", active, local_only FROM d LEFT JOIN f ON document_id = doc_id)
SELECT "group", count(*) AS n, count(*) FILTER (active) AS n_active, count(*) FILTER (local_only) AS n_local_only FROM g GROUP BY 1""")
def folder_groups(spark, sf_dir):
    return catalog.group_counts(catalog.with_folder(A.documents(spark, sf_dir).drop("id").withColumnRenamed("doc_id", "id"), _folder_files(spark, sf_dir)))


@query(f"WITH {_FOLDERS} SELECT folder_id, count(*) FILTER (state = 'malformed') AS malformed FROM f GROUP BY folder_id")
def malformed_counts(spark, sf_dir):
    return catalog.malformed_counts(_folder_files(spark, sf_dir))


@query("""SELECT concat('conv ', c.conv_id) AS title, c.turn, length(c.text)::BIGINT AS chars FROM conversations c WHERE c.conv_id % 2 = 0 AND c.turn = 1 ORDER BY c.conv_id LIMIT 30""")
def notebook_sources(spark, sf_dir):
    t = A.turns(spark, sf_dir)
    chunks = t.select(F.col("id").alias("chunk_id"), F.col("session_id").alias("document_id"), "turn", "content")
    documents = t.select(F.col("session_id").alias("id")).distinct().withColumns({"active": F.col("id") % 2 == 0, "title": F.concat(F.lit("conv "), F.col("id").cast("string"))})
    cited = t.filter("session_id % 2 = 0").select(F.lit("n").alias("notebook_id"), F.col("id").alias("chunk_id"), F.col("session_id").alias("sort_order"), "turn").filter("turn = 1").drop("turn")
    return notebooks.notebook_context(cited, chunks, documents, "n", most=30).select("title", "turn", F.char_length("content").cast("long").alias("chars"))


@query("""SELECT doc_id FROM documents WHERE doc_id % 4 <> 0""")
def paging_dedupe(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id")
    return catalog.not_shown(d.unionAll(d.filter("doc_id % 3 = 0")), d.filter("doc_id % 4 = 0"), key="doc_id")


@query("SELECT 'whole' AS kind, count(*) FILTER (doc_id % 4 = 0) AS n FROM documents UNION ALL SELECT 'page', 2 * count(*) FILTER (doc_id % 4 = 0) FROM documents")
def selection_pruning(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").filter("doc_id % 4 = 0").select("doc_id")
    selection = d.unionAll(d.select(-F.col("doc_id") - 1))
    parts = [catalog.pruned(selection, d, whole=w, key="doc_id").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, w in (("whole", True), ("page", False))]
    return parts[0].unionAll(parts[1])


@query("SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type, count(DISTINCT event_id) AS event_id FROM events")
def distinct_counts(spark, sf_dir):
    return catalog.distinct_counts(A.table(spark, sf_dir, "events"), ["user_id", "event_type", "event_id"])


@query("""WITH f AS (SELECT user_id, event_id % 50 AS done, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 40 END AS total FROM events)
SELECT user_id, sum(done)::BIGINT AS done, sum(greatest(done, coalesce(total, done)))::BIGINT AS total, round(CASE WHEN sum(greatest(done, coalesce(total, done))) > 0 THEN sum(done) / sum(greatest(done, coalesce(total, done))) ELSE 0 END, 9) AS share FROM f GROUP BY user_id""")
def download_progress(spark, sf_dir):
    k = F.col("event_id")
    rows = A.table(spark, sf_dir, "events").select("user_id", (k % 50).alias("done"), F.when(k % 3 != 0, 40).cast("long").alias("total"))
    return catalog.download_progress(rows, by="user_id").withColumn("share", F.round("share", 9))


@query("SELECT row_number() OVER (ORDER BY lower(n), n DESC) AS place, n AS name FROM (SELECT DISTINCT p_brand AS n FROM part UNION SELECT DISTINCT lower(p_brand) FROM part)")
def model_names(spark, sf_dir):
    names = A.table(spark, sf_dir, "part").select(F.explode(F.array("p_brand", F.lower("p_brand"))).alias("name"))
    found = catalog.model_names(names)
    return found.select(F.row_number().over(Window.orderBy(F.lower("name"), F.desc("name"))).cast("long").alias("place"), "name")  # one row a name


@query("SELECT n_nationkey AS id, (24 - n_nationkey)::INT AS sort_order FROM nation")
def reordered_rows(spark, sf_dir):
    rows = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("int").alias("sort_order"))
    return store.reordered(rows, list(range(24, -1, -1)))
