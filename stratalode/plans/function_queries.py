"""One query for each group of scalar functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import semantic
from . import adapters as A
from .registry import query

_WS = "[ \\t\\n\\r\\x0b\\x0c]"


def _flat(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))"


def _pick(key: Column, values: list[str | None]) -> Column:
    """One of the values by the key's remainder."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(F.pmod(key, F.lit(len(values))) == i, F.lit(v)).otherwise(out)
    return out


def _pick_sql(key: str, values: list[str | None]) -> str:
    quoted = [f"'{v.replace(chr(39), chr(39) * 2)}'" if v is not None else "NULL" for v in values]
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


@query(f"""SELECT doc_id, substr(regexp_replace(concat('  ', text, ' '), '^{_WS}+|{_WS}+$', '', 'g'), 1, 40) AS clamped,
greatest(100, least(5000, floor(coalesce(try_cast(CASE doc_id % 3 WHEN 0 THEN n_chars::VARCHAR WHEN 1 THEN 'abc' ELSE concat(n_chars, '.7') END AS DOUBLE), 250))))::BIGINT AS number FROM documents""")
def clamped_values(spark, sf_dir):
    number = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("string")).when(F.col("doc_id") % 3 == 1, "abc").otherwise(F.concat(F.col("n_chars").cast("string"), F.lit(".7")))
    return A.table(spark, sf_dir, "documents").select("doc_id", T.clamped(F.concat(F.lit("  "), "text", F.lit(" ")), 40).alias("clamped"), T.clamped_integer(number, 100, 5000, 250).alias("number"))


@query("""SELECT event_id, substr(concat('{"id":', event_id, ',"type":"', event_type, '"}'), 1, 24) AS clipped, CASE WHEN event_id % 3 <> 0 THEN props->>'$.k' END AS k, CASE WHEN event_id % 3 <> 0 THEN len(json_keys(props)) ELSE 0 END::INT AS n FROM events""")
def json_values(spark, sf_dir):
    parsed = T.json_object(F.when(F.col("event_id") % 3 != 0, F.col("props")).otherwise(F.col("event_type")))
    shown = T.json_clipped(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")), 24)
    return A.table(spark, sf_dir, "events").select("event_id", shown.alias("clipped"), F.element_at(parsed, "k").alias("k"), F.size(parsed).alias("n"))


_ENDINGS = [".TXT", ".tar.gz", "", ".Md"]


@query(f"""SELECT doc_id, concat(lang, '-', doc_id, {_pick_sql('doc_id', ['', '.tar', '', ''])}) AS title, {_pick_sql('doc_id', ['.txt', '.gz', '', '.md'])} AS extension, concat(substr(sha256(text), 1, 16), {_pick_sql('doc_id', ['.txt', '.gz', '', '.md'])}) AS managed FROM documents""")
def file_names(spark, sf_dir):
    path = F.concat(F.lit("a/b.c/"), "lang", F.lit("-"), F.col("doc_id").cast("string"), _pick(F.col("doc_id"), _ENDINGS))
    extension = T.file_extension(path)
    return A.table(spark, sf_dir, "documents").select("doc_id", T.title_of(path).alias("title"), extension.alias("extension"), T.managed_name(F.col("text"), extension).alias("managed"))


@query("""SELECT event_id, concat('&t=', greatest(0, floor((event_id * 977 - 5000) / 1000.0))::BIGINT, 's') AS seek,
greatest(24000, round((32768 - (event_id % 40000 + CASE WHEN user_id % 3 = 0 THEN 0 ELSE greatest(0, user_id - 50) END))::DOUBLE * 3.2::DOUBLE * 0.6::DOUBLE))::BIGINT AS budget FROM events""")
def seek_and_budget(spark, sf_dir):
    reasoning = F.when(F.col("user_id") % 3 != 0, F.col("user_id") - 50)
    return A.table(spark, sf_dir, "events").select("event_id", T.seek_suffix(F.col("event_id") * 977 - 5000).alias("seek"), T.transcript_budget(F.col("event_id") % 40000, reasoning).alias("budget"))


@query("""SELECT doc_id, (list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(concat(source, lang, doc_id), ''), lambda c: ord(c)::BIGINT)), lambda h, c: xor(h, c) * 16777619 % 4294967296) % 360)::INT AS hue FROM documents""")
def tag_hues(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.tag_hue(F.concat("source", "lang", F.col("doc_id").cast("string"))).alias("hue"))


_ERF = "sign({x}) * (1 - (((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t) * exp(-({x}) * ({x})))"


@query(f"""WITH v AS (SELECT event_id, value / 100 - 1.5::DOUBLE AS x FROM events),
e AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(x)) AS t FROM v), g AS (SELECT event_id, x, x / sqrt(2) AS y, 1 / (1 + 0.3275911::DOUBLE * abs(x / sqrt(2))) AS t FROM v)
SELECT e.event_id, round(1 / (1 + exp(-e.x)), 9) AS sigmoid, round({_ERF.format(x='e.x').replace('* t', '* e.t').replace('t +', 't +')}, 9) AS erf, round(0.5 * g.x * (1 + {_ERF.format(x='g.y').replace('* t', '* g.t')}), 9) AS gelu FROM e JOIN g USING (event_id)""")
def activations(spark, sf_dir):
    x = F.col("value") / 100 - 1.5
    return A.table(spark, sf_dir, "events").select("event_id", F.round(V.sigmoid(x), 9).alias("sigmoid"), F.round(V.erf(x), 9).alias("erf"), F.round(V.gelu(x), 9).alias("gelu"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n, list_avg(e) AS m FROM v),
c AS (SELECT vec_id, n, e, m, list_transform(e, lambda x: x - m) AS d FROM n)
SELECT vec_id, round((e[1] / n)::FLOAT::DOUBLE, 6) AS first, round(d[1] / sqrt(list_dot_product(d, d) / len(d) + 1e-5::DOUBLE), 6) AS scaled FROM c""")
def normalized_vectors(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    unit, scaled = V.unit(F.col("embedding")), V.layer_norm(F.col("embedding").cast("array<double>"))
    return v.select(F.col("chunk_id").alias("vec_id"), F.round(unit[0].cast("double"), 6).alias("first"), F.round(scaled[0], 6).alias("scaled"))


@query(r"""SELECT doc_id, concat('%', replace(replace(replace(concat(lang, '%_\', source), '\', '\\'), '%', '\%'), '_', '\_'), '%') AS pattern FROM documents""")
def like_patterns(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.like_escaped(F.concat("lang", F.lit("%_\\"), "source")).alias("pattern"))


@query(f"""WITH p AS (SELECT doc_id, translate(lower(concat('¡', lang, ' — ', substr(text, 1, 120))), '{T.ACCENTED}', '{T.PLAIN}') AS t FROM documents),
s AS (SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(t, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', '') AS slug FROM p) SELECT doc_id, CASE WHEN slug = '' THEN 'page' ELSE slug END AS slug, 'none' AS blank FROM s""")
def slugs(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.slug(F.concat(F.lit("¡"), "lang", F.lit(" — "), F.substring("text", 1, 120))).alias("slug"), T.slug(F.lit("—!"), "none").alias("blank"))


@query(r"""WITH x AS (SELECT doc_id, concat('[', lang, '|\', source, ']', chr(10), chr(13), chr(10), 'b') AS c FROM documents), l AS (SELECT doc_id, replace(replace(replace(c, '\', '\\'), '[', '\['), ']', '\]') AS label FROM x)
SELECT doc_id, label, regexp_replace(replace(label, '|', '\|'), '[\r\n]+', ' ', 'g') AS cell FROM l""")
def markdown_escapes(spark, sf_dir):
    c = F.concat(F.lit("["), "lang", F.lit("|\\"), "source", F.lit("]\n\r\nb"))
    return A.table(spark, sf_dir, "documents").select("doc_id", T.escaped_label(c).alias("label"), T.escaped_cell(c).alias("cell"))


_BEFORE, _AFTER = ["", "word", "open (", "space ", "x["], ["", "word", ".", " x", ")", "(a", "!"]


@query(f"""SELECT doc_id, {_pick_sql('doc_id', ['', ' ', '', '', ''])} AS prefix, {_pick_sql('doc_id', ['', ' ', '', '', '', ' ', ''])} AS suffix FROM documents""")
def citation_spaces(spark, sf_dir):
    k = F.col("doc_id")
    return A.table(spark, sf_dir, "documents").select("doc_id", T.citation_spacing(_pick(k, _BEFORE), _pick(k, _AFTER)).alias("x")).select("doc_id", "x.prefix", "x.suffix")


@query(f"""WITH f AS (SELECT doc_id, {_flat('text')} AS t FROM documents), p AS (SELECT *, coalesce(least(nullif(instr(lower(t), 'ander'), 0), nullif(instr(lower(t), 'ing'), 0)), 1) - 1 AS hit FROM f),
s AS (SELECT *, greatest(0, hit - 60) AS a FROM p), e AS (SELECT *, least(length(t), a + 180) AS b FROM s)
SELECT doc_id, CASE WHEN t = '' THEN 'Empty page' ELSE concat(CASE WHEN a > 0 THEN '...' ELSE '' END, trim(substr(t, a + 1, b - a)), CASE WHEN b < length(t) THEN '...' ELSE '' END) END AS snippet FROM e""")
def snippets(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), ["ander", "ing"]).alias("snippet"))


@query(f"""WITH f AS (SELECT doc_id, {_flat('text')} AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 100 THEN t ELSE concat(rtrim(substr(t, 1, 100)), '…') END AS page, CASE WHEN length(t) <= 220 THEN t ELSE concat(rtrim(substr(t, 1, 220)), '...') END AS source FROM f""")
def previews(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("page"), T.compact(F.col("text"), 220).alias("source"))


_PLACES = ["/home/a/x.docx", "/home/ab/x", "/home/a/../x.y/z", "/home/a/", "/home/a/b/c.d.pptx", "/home/a"]


@query(f"""SELECT doc_id, doc_id % 6 IN (0, 4) AS inside, {_pick_sql('doc_id', ['/home/a/x.pdf', '/home/ab/x', '/home/a/../x.y/z', '/home/a/', '/home/a/b/c.d.pdf', '/home/a'])} AS shown FROM documents""")
def path_rules(spark, sf_dir):
    path = _pick(F.col("doc_id"), _PLACES)
    return A.table(spark, sf_dir, "documents").select("doc_id", T.path_contains(F.lit("/home/a/"), path).alias("inside"), T.preview_path(path).alias("shown"))


@query("""SELECT event_id AS id, concat(strftime(ts, '%Y-%m-%d'), ' ', rpad(upper(CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'purchase' THEN 'info' ELSE 'debug' END), 5, ' '), ' [', event_type, '] read ~/', event_id, '.txt') AS line FROM events""")
def log_lines(spark, sf_dir):
    said = T.scrubbed(F.concat(F.lit("read /home/u/"), F.col("id").cast("string"), F.lit(".txt")), "/home/u")
    return A.log_entries(spark, sf_dir).select("id", T.log_line(F.date_format("ts", "yyyy-MM-dd"), F.col("level"), F.col("subsystem"), said).alias("line"))


_TYPED = ["/sum the rest of it", "no command", "  /x  ", "/", "/a-b\nmore\nlines ", "a /b c"]


@query(f"""SELECT doc_id, {_pick_sql('doc_id', ['sum', None, 'x', None, 'a-b', None])} AS name, {_pick_sql('doc_id', ['the rest of it', None, '', None, 'more' + chr(10) + 'lines', None])} AS rest FROM documents""")
def commands(spark, sf_dir):
    x = T.command(_pick(F.col("doc_id"), _TYPED))
    return A.table(spark, sf_dir, "documents").select("doc_id", x["name"].alias("name"), x["rest"].alias("rest"))


_KINDS = ["AUDIO", "YOUTUBE", "TEXT", "CSV", "XLSX", "PDF"]


@query(f"""WITH x AS (SELECT doc_id, {_pick_sql('doc_id', _KINDS)} AS kind, concat('a%2F', doc_id) AS d, concat('c%3A', doc_id) AS c, doc_id % 9 AS page FROM documents)
SELECT doc_id, CASE WHEN kind IN ('AUDIO', 'YOUTUBE') THEN concat('/transcripts/', d, '?chunk=', c) WHEN kind = 'PDF' THEN concat('/document-files/', d, '#page=', page + 1) ELSE concat('/text-documents/', d, '?chunk=', c) END AS link,
CASE WHEN kind IN ('AUDIO', 'YOUTUBE') THEN 'shown' WHEN kind = 'XLSX' THEN concat('Sheet ', page + 1, ': shown') ELSE concat('Page ', page + 1, ': shown') END AS label FROM x""")
def viewer_links(spark, sf_dir):
    k, kind = F.col("doc_id"), _pick(F.col("doc_id"), _KINDS)
    name = k.cast("string")
    return A.table(spark, sf_dir, "documents").select("doc_id", T.viewer_link(kind, F.concat(F.lit("a/"), name), F.concat(F.lit("c:"), name), k % 9).alias("link"), T.location_label(kind, k % 9, F.lit("shown")).alias("label"))


_RANGES = ["bytes=0-99", "bytes=500-", "bytes=-200", "bytes=-", "junk", "bytes=99999999-", "bytes=7-3", "bytes=10-999999999"]


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN n_chars > 500 THEN 500 END WHEN 2 THEN CASE WHEN n_chars > 0 THEN greatest(0, n_chars - 200) END WHEN 7 THEN CASE WHEN n_chars > 10 THEN 10 END END::BIGINT AS first,
CASE doc_id % 8 WHEN 0 THEN least(99, n_chars - 1) WHEN 1 THEN CASE WHEN n_chars > 500 THEN n_chars - 1 END WHEN 2 THEN CASE WHEN n_chars > 0 THEN n_chars - 1 END WHEN 7 THEN CASE WHEN n_chars > 10 THEN n_chars - 1 END END::BIGINT AS last FROM documents WHERE n_chars > 0""")
def byte_ranges(spark, sf_dir):
    x = T.byte_range(_pick(F.col("doc_id"), _RANGES), F.col("n_chars").cast("long"))
    return A.table(spark, sf_dir, "documents").filter("n_chars > 0").select("doc_id", x["start"].cast("long").alias("first"), x["end"].cast("long").alias("last"))


@query("""SELECT doc_id, CASE WHEN doc_id % 8 IN (6, 7) THEN NULL ELSE id END AS video FROM (SELECT doc_id, lpad(doc_id::VARCHAR, 11, 'a') AS id FROM documents)""")
def video_ids(spark, sf_dir):
    v = F.lpad(F.col("doc_id").cast("string"), 11, "a")
    forms = ["", "https://www.youtube.com/watch?v=", "youtu.be/", "https://youtube.com/shorts/", "http://m.youtube.com/embed/", "https://www.youtube-nocookie.com/embed/", "https://example.org/watch?v=", "https://youtube.com/channel/"]
    return A.table(spark, sf_dir, "documents").select("doc_id", T.video_id(F.concat(_pick(F.col("doc_id"), forms), v)).alias("video"))


@query("""WITH l AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM documents),
m AS (SELECT doc_id, list_transform(x, lambda s, i: CASE WHEN trim(s, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' AND trim(coalesce(x[i + 1], ''), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' THEN concat(rtrim(s, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '  ') ELSE s END) AS y FROM l)
SELECT doc_id, sha256(array_to_string(y, chr(10))) AS digest FROM m""")
def hard_breaks(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.hard_breaks(F.concat(F.lit("﻿"), "text")), 256).alias("digest"))


@query("""SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'en' END AS language, concat('a,', lang, ',', source) AS filters, CASE WHEN doc_id % 2 = 0 THEN 'Read Pages' ELSE concat('Read Pages: ', lang, ' ', source) END AS title FROM documents""")
def settings_and_filters(spark, sf_dir):
    values = F.array(F.lit(" a "), F.lit("  "), "lang", F.concat("lang", F.lit("\n")), "source", F.lit("a"))
    argument = F.when(F.col("doc_id") % 2 == 1, F.concat_ws("  ", "lang", "source"))
    return A.table(spark, sf_dir, "documents").select("doc_id", T.sanitized(F.col("lang"), ("en", "de"), "en").alias("language"), F.array_join(T.cleaned_values(values), ",").alias("filters"), T.tool_title(F.lit("read_pages"), argument).alias("title"))


@query("""WITH o AS (SELECT conv_id, list(turn ORDER BY turn) FILTER (role = 'user') AS s, count(*) FILTER (role <> 'user')::INT AS n_others FROM conversations GROUP BY conv_id)
SELECT conv_id AS session_id, coalesce(len(s), 0)::INT AS n_sources, coalesce(array_to_string(s[1:2], ','), '') AS shown, n_others FROM o""")
def tool_outputs(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "source").otherwise("chart")
    outputs = A.turns(spark, sf_dir).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", kind.alias("type")))).alias("x"))
    return outputs.select("session_id", T.split_outputs(F.col("x"), 2).alias("y")).select("session_id", "y.n_sources", F.array_join("y.sources.turn", ",").alias("shown"), F.size("y.others").alias("n_others"))


@query("""SELECT event_id AS id, concat(strftime(ts + INTERVAL 330 MINUTE, '%A, %B '), day(ts + INTERVAL 330 MINUTE), ', ', year(ts + INTERVAL 330 MINUTE), ' at ', (hour(ts + INTERVAL 330 MINUTE) + 11) % 12 + 1, strftime(ts + INTERVAL 330 MINUTE, ':%M:%S %p')) AS there FROM events""")
def local_times(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.long_date(F.col("ts").cast("timestamp"), "Asia/Kolkata")["local"].alias("there"))


@query("""SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id % 50, doc_id) AS place, doc_id FROM documents""")
def natural_order(spark, sf_dir):
    name = F.concat(F.lit("Page "), (F.col("doc_id") % 50).cast("string"), F.when(F.col("doc_id") % 2 == 0, "-part").otherwise("-PART"), F.col("doc_id").cast("string"))
    rows = A.table(spark, sf_dir, "documents").select("doc_id", "lang", T.natural_key(name).alias("k"))
    return rows.select(F.row_number().over(Window.partitionBy("lang").orderBy("k")).cast("long").alias("place"), "doc_id")


@query("""WITH c AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'other/64' WHEN 1 THEN NULL ELSE 'stand-in/64' END AS model, vec_id % 5 = 0 AS bare FROM embeddings)
SELECT count(*) FILTER (model = 'stand-in/64' AND NOT bare) AS ready, count(*) FILTER (model IS DISTINCT FROM 'stand-in/64' OR bare) AS stale FROM c""")
def embedding_counts(spark, sf_dir):
    k = F.col("chunk_id")
    model = F.when(k % 4 == 0, "other/64").when(k % 4 >= 2, "stand-in/64")
    return semantic.index_counts(A.vectors(spark, sf_dir).withColumns({"embedding_model": model, "embedding": F.when(k % 5 != 0, F.col("embedding"))}), "stand-in/64")
