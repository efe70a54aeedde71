"""Micro-fixtures of the operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalode.operators import catalog, chunking, lexical, models, notebooks, retrieval, semantic, speakers, sync, tools, transcripts
from stratalode.operators.porter import stem


def test_porter():
    got = {w: stem(w) for w in "caresses ponies cats feed agreed plastered motoring conflated hopping falling happy relational generalizations as is ski dying".split()}
    assert got == {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "happy": "happi", "relational": "relat", "generalizations": "gener", "as": "as", "is": "is", "ski": "ski", "dying": "dy"}


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["the pump is broken", "the pumps are running running", "café open", "nothing here at all today", "running shoes"]
    rows = [(i + 1, i + 1, t, i != 99, False, "TEXT", "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id long, document_id long, content string, active boolean, local_only boolean, chunk_type string, source_path string").cache()


def scores(frame):
    return {r["chunk_id"]: r["score"] for r in frame.collect()}


def test_bm25_values_of_the_full_text_engine(corpus):
    near = lambda got, want: got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert near(scores(lexical.bm25_scores(corpus, "pump", stemmed=True)), {1: 0.3218430089420298, 2: 0.29028977277124257})
    assert near(scores(lexical.bm25_scores(corpus, "run", stemmed=True)), {2: 0.41703601158685544, 5: 0.4112438447592603})
    assert near(scores(lexical.bm25_scores(corpus, "running running", stemmed=True)), {2: 2 * 0.41703601158685544, 5: 2 * 0.4112438447592603})
    assert scores(lexical.bm25_scores(corpus, "café")) == {} and near(scores(lexical.bm25_scores(corpus, "cafe")), {3: 1.342748352816579})


def test_bm25_by_postings_agrees(spark, corpus):
    index = lexical.postings(corpus, stemmed=True)
    queries = spark.createDataFrame([("q", "run", 1.0), ("q", "pump", 1.0)], "query_id string, term string, weight double")
    got = {r["chunk_id"]: round(r["score"], 12) for r in lexical.search_postings(index, queries).collect()}
    assert got == {k: round(v, 12) for k, v in scores(lexical.bm25_scores(corpus, "run pump", stemmed=True)).items()}


def test_filters_and_confidence(spark, corpus):
    hidden = corpus.withColumn("active", F.col("chunk_id") != 1)
    assert {r[0] for r in lexical.search_bm25(hidden, "pump running", stemmed=True).select("chunk_id").collect()} == {2, 5}
    m = spark.createDataFrame([(4.0,), (1.5,), (1.3,), (0.9,)], "score double")
    assert [r[0] for r in lexical.confident(m, "bm25", "medium").collect()] == [4.0, 1.5] and [r[0] for r in lexical.confident(m, "bm25", "high").collect()] == [4.0]
    assert lexical.confident(m, "semantic", "low").count() == 4


def test_top_vectors_and_ties(spark):
    v = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0])], "chunk_id long, embedding array<float>")
    assert [r["chunk_id"] for r in semantic.top_vectors(v, [1.0, 0.0], top_k=2).collect()] == [1, 2]
    assert semantic.top_vectors(v, [1.0, 0.0], top_k=0).count() == 0


def test_candidates_and_rerank(spark):
    s = spark.createDataFrame([(7, 1), (8, 2)], "chunk_id long, rank int")
    b = spark.createDataFrame([(8, 1), (9, 2)], "chunk_id long, rank int")
    c = retrieval.candidates(s, b)
    assert {r["chunk_id"]: r["position"] for r in c.collect()} == {7: 1, 8: 2, 9: 3}
    assert [r["chunk_id"] for r in retrieval.rerank(c, F.lit(0.5)).collect()] == [7, 8, 9]
    with pytest.raises(Exception, match="relevance"):
        retrieval.rerank(c, F.lit(1.5)).collect()
    assert retrieval.search_arguments({"query": " x ", "top_k": "99", "mode": "?"}) == {"query": "x", "mode": "hybrid", "top_k": 20}


def test_window_clamps(spark):
    rows = spark.createDataFrame([(1, 0, i) for i in range(5)], "document_id long, page_index int, chunk_index int")
    assert [r["position"] for r in retrieval.chunk_window(rows, 9, 4).collect()] == [5]
    assert [r["position"] for r in retrieval.chunk_window(rows, -3, 2).orderBy("position").collect()] == [1, 2]


def test_sentences():
    cut = lambda t: [t[a:b].strip() for a, b in chunking.sentences(t)]
    assert cut("Dr. Evil left. He ran.") == ["Dr. Evil left.", "He ran."]
    assert cut("The U.S.A. won. Yes.") == ["The U.S.A. won.", "Yes."]
    assert cut("Version 3.6 works. a.b stays.") == ["Version 3.6 works.", "a.b stays."]
    assert cut("One. two three") == ["One.", "two three"] and cut("") == []


def test_windows_overlap_and_split():
    sentence = "word " * 99 + "end."
    got = chunking.sentence_windows(" ".join([sentence] * 4))
    assert all(len(c) <= 1200 for c, _, _ in got) and got[1][0].startswith(sentence)
    assert [len(c) for c, _, _ in chunking.sentence_windows("x" * 3000)] == [1200, 1200, 600]
    assert chunking.page_chunks("TEXT", "x" * 3000) == [] and chunking.page_chunks("IMAGE", " a  b ") == ["a b"]


def test_assembly(spark):
    pages = spark.createDataFrame([(1, "p", "TEXT", 0, "too short here."), (1, "p", "TEXT", 0, "one two three four five six."), (1, "p", "TEXT", 1, "one two three four five six."), (1, "p", "TABLE", 1, "a b")], "document_id long, source string, chunk_type string, page_index int, content string")
    rows = chunking.assembled(chunking.chunk_pages(pages)).collect()
    assert sorted((r["page_index"], r["chunk_type"]) for r in rows) == [(0, "TEXT"), (1, "TABLE"), (1, "TEXT")] and all(len(r["chunk_id"]) == 64 for r in rows)


def test_csv_and_tables():
    assert chunking.parse_csv('﻿a,"b ""q"", c"\r\nd\n\n"x\ny",z"w,v"\r') == [["a", 'b "q", c'], ["d"], [""], ["x\ny", "zw,v"]]
    pages = chunking.table_pages([["h1", " h 2 "]] + [["x" * 50, "y" * 50]] * 30, "S")
    assert len(pages) > 1 and all(p.startswith("Sheet: S\nh1 | h 2\n") and len(p) <= 1200 for p in pages)
    assert chunking.table_pages([["", ""]]) == [] and chunking.table_pages([["only"]]) == ["only"]


def test_preview_segments():
    text = "Intro.\n\nFirst part here.\n\n- item\nSecond part."
    got = chunking.preview_segments(text, [(0, "First part here."), (1, "Second  part.")])
    assert "".join(t for _, t in got) == text and [i for i, _ in got] == [[], [0], [1]]
    assert [i for i, _ in chunking.preview_segments(text, [(0, "part here."), (1, "Second part.")], markdown=True)] == [[], [0, 1]]


def test_transcripts(spark):
    rows = [("r", i, s, t, i * 1000, i * 1000 + 1000) for i, (s, t) in enumerate([(1, "a b"), (1, " c "), (None, "d"), (None, "e"), (2, "f"), (2, " ")])]
    seg = spark.createDataFrame(rows, "recording string, pos int, speaker int, text string, start_ms long, end_ms long")
    turns = sorted(transcripts.turn_texts(seg, by="recording", order="pos").collect(), key=lambda r: r["turn"])
    assert [(r["speaker"], r["content"]) for r in turns] == [(1, "a b c"), (None, "d e"), (2, "f")]
    times = transcripts.turn_texts(seg, by="recording", order="pos").filter("turn = 0").select(*[transcripts.time_at(F.col("timeline"), F.lit(k)).alias(f"t{k}") for k in (0, 1, 3, 4, 9)]).first()
    assert tuple(times) == (0, 333, 1000, 1000, 2000)
    chunks = transcripts.transcript_chunks(transcripts.turn_texts(seg, by="recording", order="pos"), by="recording").orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["content"], r["start_ms"], r["end_ms"]) for r in chunks] == [(0, "a b c", 0, 2000), (1, "d e", 2000, 4000), (2, "f", 4000, 5000)]


def test_speaker_clusters():
    rng = np.random.default_rng(0)
    base = np.eye(8)[:2]
    v = np.concatenate([base[0] + rng.normal(0, 0.05, (6, 8)), base[1] + rng.normal(0, 0.05, (6, 8))])
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    labels = speakers.clustered(v)
    assert set(labels[:6]) == {0} and set(labels[6:]) == {6}
    at = lambda c: speakers.clustered(np.array([[1, 0], [c, np.sqrt(1 - c * c)]]))
    assert list(at(0.46)) == [0, 0] and list(at(0.44)) == [0, 1]
    pdf = pd.DataFrame({"pos": range(13), "start_ms": [i * 5000 for i in range(13)], "end_ms": [i * 5000 + 3000 for i in range(13)], "embedding": [*map(list, v), None]})
    assert speakers.labelled(pdf)["speaker"].tolist() == [1] * 6 + [2] * 7
    assert speakers.crop(0, 400) is None and speakers.crop(0, 20_000) == (5000, 15_000)


def test_sync_rules(spark):
    rows = [("ignored", None, False), ("malformed", None, True), ("synced", None, True), ("synced", 1, True), ("duplicate", None, False)]
    frame = spark.createDataFrame(rows, "state string, document_id int, same boolean").select(sync.settled(F.col("state"), F.col("document_id"), F.col("same")).alias("x"))
    assert [r["x"] for r in frame.collect()] == [True, True, False, True, False]
    uploads = spark.createDataFrame([("b", 1, 1, "h"), ("a", 1, 1, "h"), ("c", 1, 1, "k")], "path string, last_modified int, size int, content_hash string")
    tracked = spark.createDataFrame([("old", "synced", "k", None)], "path string, state string, content_hash string, message string")
    replaced = spark.createDataFrame([("c", "old")], "path string, replaces string")
    got = lambda r: {x["path"]: (x["state"], x["message"]) for x in sync.ingested(uploads, tracked, r).collect()}
    assert got(None) == {"a": ("synced", None), "b": ("duplicate", "a"), "c": ("duplicate", "old")} and got(replaced)["c"] == ("synced", None)
    left = spark.createDataFrame([("old", "synced", "k", None), ("d", "duplicate", "k", "old"), ("e", "duplicate", "k", "x")], "path string, state string, content_hash string, message string")
    assert [r["path"] for r in sync.freed_duplicates(left, spark.createDataFrame([("old",)], "path string")).collect()] == ["e"]


def test_net_changes(spark):
    log = spark.createDataFrame([(1, 1, 10, "put", "m", 1.0), (2, 1, 0, "remove", "m", 0.0), (3, 2, 20, "put", "m", 1.0), (4, 2, 20, "put", "other", 2.0), (5, 3, 30, "put", "m", 3.0)], "seq long, document_id long, chunk_id long, kind string, embedding_model string, value double")
    index = spark.createDataFrame([(1, 11, 9.0), (2, 20, 9.0), (4, 40, 9.0)], "document_id long, chunk_id long, value double")
    assert sorted(tuple(r) for r in sync.applied(index, log, "m").collect()) == [(3, 30, 3.0), (4, 40, 9.0)]
    assert sync.needs_compaction(3, 10) and not sync.needs_compaction(2, 10)


def test_notebook_operators(spark):
    m = spark.createDataFrame([("s", i, "tool" if i % 2 else "user", "t", '{"query":"q"}' + "x" * 500) for i in range(10)], "session string, id int, role string, name string, content string")
    got = notebooks.compacted(m, by="session", order="id", budget=4500).orderBy("id").collect()
    small = [r["id"] for r in got if r["content"].startswith('{"compacted"')]
    assert small == [1, 3] and '"query":"q"' in got[1]["content"]
    pages = spark.createDataFrame([(1, 0, "A b"), (1, 1, "a B!"), (1, 2, "")], "n int, o int, title string")
    assert [r["file"] for r in notebooks.exported_names(pages, by="n", order="o").orderBy("o").collect()] == ["a-b.md", "a-b-2.md", "page-3.md"]
    once = notebooks.with_citations("Text", ["| [A](/x) | 1 |", "| [A again](/x) | 1 |"])
    assert once.count("/x") == 1 and notebooks.with_citations(once, ["| [B](/y) | 2 |"]).count("## Citations") == 1
    assert notebooks.find_in_page("aAa", "a") == [(0, 1), (1, 2), (2, 3)]
    files = spark.createDataFrame([("p10.md", "x"), ("p2.txt", "a\nb"), ("p3.md", " ")], "name string, content string")
    assert [(r["title"], r["content"], r["error"]) for r in notebooks.imported_pages(files).orderBy("sort_order").collect()] == [("p2", "a  \nb", None), ("p3", " ", "no text"), ("p10", "x", None)]


def test_tools(spark):
    r = tools.Registry([tools.Tool("count", "Counts", lambda s, t, a: t["x"].agg(F.count("*").alias("n")))])
    ok, bad = r.execute(spark, "count", {"x": spark.range(3)}, {}).first(), r.execute(spark, "none", {}, {}).first()
    assert ok["content"] == '{"n":3}' and bad["is_error"]
    with pytest.raises(ValueError, match="registered"):
        r.add(r.catalogue()[0])
    assert tools.python_tool(spark.range(2), "def transform(pdf):\n    return pdf * 2", "id long").agg(F.sum("id")).first()[0] == 2


def test_models_and_catalogue(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "")], "id long, t string")
    v = {r["id"]: r["embedding"] for r in models.embedded(rows, models.HashedWords, key="stand-in/64", id_col="id", text_col="t").collect()}
    assert abs(np.linalg.norm(v[1]) - 1) < 1e-6
    assert catalog.same_ids(spark.range(3), spark.range(3)).first()[0] and not catalog.same_ids(spark.range(3), spark.range(4)).first()[0]
    assert [r["id"] for r in catalog.after_key(spark.range(9), "id", 3, 2).collect()] == [4, 5]


def test_remote_embeddings_are_put_in_order():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            body = json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 0.0]} for i, t in reversed(list(enumerate(texts)))]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    got = models.RemoteEmbedder(f"http://127.0.0.1:{server.server_port}", "m").embed(["a", "bb"])
    server.shutdown()
    assert got.tolist() == [[1.0, 0.0], [1.0, 0.0]]


def test_reembedding_and_listing(spark):
    chunks = spark.createDataFrame([(1, "a", [0.0], "old"), (2, "b", None, None)], "chunk_id long, content string, embedding array<float>, embedding_model string")
    fresh = chunks.select("chunk_id", F.sha2(F.when(F.col("chunk_id") == 1, F.lit("a")).otherwise("changed"), 256).alias("content_hash"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    got = semantic.reembedded(chunks, fresh, "new")
    assert {r["chunk_id"]: r["embedding_model"] for r in got.collect()} == {1: "new", 2: None}
    assert tuple(semantic.index_counts(got, "new").first()) == (1, 1)
    docs = spark.createDataFrame([(1, "b", "p", True), (2, "A", "p", True), (3, "c", "p", False)], "id int, title string, source_path string, active boolean")
    assert [(r["title"], r["total"]) for r in catalog.corpus_listing(docs, limit=1, offset=1).collect()] == [("b", 2)]


def test_white_space_is_one_set(spark):
    from stratalode.functions import text as T

    probe = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF and c not in (9, 32))
    assert "".join(chunking._WORD.findall(probe)) == "".join(c for c in probe if c not in chunking.WHITE)
    texts = [f"a{c}b. {c}" for c in [*chunking.WHITE, "\x1c", "\x85", "​"]]
    rows = spark.createDataFrame(enumerate(texts), "i int, t string").select("i", "t", T.normalized("t").alias("n"), T.cleaned_page("t").alias("c"), T.word_count("t").alias("w")).collect()
    for r in rows:
        assert (r["n"], r["c"], r["w"]) == (chunking._normal(r["t"]), chunking.clean_page(r["t"]), len(chunking._WORD.findall(r["t"]))), repr(r["t"])
    assert chunking.sentences("One. ﻿") == [(0, 4)] and chunking.by_length("﻿ ab cd", 0, 7, 3) == [(2, 4), (5, 7)]


def test_only_bounded_sides_are_broadcast(spark):
    rows = spark.range(50).withColumnRenamed("id", "chunk_id")
    hinted = lambda x: "strategy=broadcast" in x._jdf.queryExecution().analyzed().toString() or "ResolvedHint" in x._jdf.queryExecution().logical().toString()
    wide = rows.union(rows).repartition(3)
    assert hinted(semantic.bounded(wide.limit(5))) and not hinted(semantic.bounded(wide, most=10))
