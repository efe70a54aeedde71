"""Micro-fixtures of the text and vector functions, all in one projection a test."""

import math

from pyspark.sql import functions as F

from stratalode.functions import text as T
from stratalode.functions import vector as V


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_white_space_and_cuts(spark):
    got = values(
        spark,
        nbsp=T.collapsed(F.lit(" a  b﻿ c ")),
        short=T.compact(F.lit("a  b"), 5),
        cut=T.compact(F.lit("ab cd  ef"), 6),
        shown=T.preview(F.lit("abcdef"), 3),
        clamp=T.clamped(F.lit("  abc "), 2),
        page=T.cleaned_page(F.lit("a\t b\r\n\r\n  \n c ")),
        words=T.word_count(F.lit(" one two\nthree ")),
        number=T.clamped_integer(F.lit("7.9"), 1, 5, 3),
        fallback=T.clamped_integer(F.lit("x"), 1, 5, 3),
    )
    assert got == {"nbsp": "a b c", "short": "a b", "cut": "ab cd...", "shown": "abc…", "clamp": "ab", "page": "a b\nc", "words": 3, "number": 5, "fallback": 3}


def test_ascii_matching(spark):
    got = values(spark, a=T.ascii_contains(F.lit("100%_Done É"), "%_D"), b=T.ascii_contains(F.lit("100%_Done É"), "é"), like=T.like_escaped(F.lit("a%b_c\\")))
    assert got == {"a": True, "b": False, "like": "%a\\%b\\_c\\\\%"}


def test_names_and_tags(spark):
    got = values(
        spark, ext=T.file_extension(F.lit("a/b.c/Report.PDF")), title=T.title_of(F.lit("a/b/Report v1.2.pdf")), hidden=T.title_of(F.lit(".env")), tag=T.normalized_tag(F.lit(" #Big-Data ")),
        good=T.valid_tag(F.lit("big-data_2")), bad=T.valid_tag(F.lit("-x")), hue=T.tag_hue(F.lit("music")), slug=T.slug(F.lit("  Ünïcode & Co. -- 2 ")), empty=T.slug(F.lit("!!"), "page-1"),
    )
    h = 2166136261
    for ch in "music":
        h = (h ^ ord(ch)) * 16777619 & 0xFFFFFFFF
    assert got == {"ext": ".pdf", "title": "Report v1.2", "hidden": ".env", "tag": "big-data", "good": True, "bad": False, "hue": h % 360, "slug": "unicode-co-2", "empty": "page-1"}


def test_labels(spark):
    got = values(
        spark, a=T.timestamp_label(F.lit(61_000)), b=T.timestamp_label(F.lit(3_723_000)), c=T.byte_label(F.lit(512)), d=T.byte_label(F.lit(1536)), e=T.seek_suffix(F.lit(61_999)),
        f=T.location_label(F.lit("XLSX"), F.lit(1), F.lit("x")), g=T.location_label(F.lit("AUDIO"), F.lit(1), F.lit("x")), h=T.location_label(F.lit("PDF"), F.lit(0), F.lit("x")),
    )
    assert got == {"a": "1:01", "b": "1:02:03", "c": "512 B", "d": "1.5 KB", "e": "&t=61s", "f": "Sheet 2: x", "g": "x", "h": "Page 1: x"}


def test_video_ids(spark):
    v = "dQw4w9WgXcQ"
    urls = [v, f"https://www.youtube.com/watch?v={v}&t=1", f"youtu.be/{v}", f"https://m.youtube.com/shorts/{v}", f"https://example.com/watch?v={v}", "", f"https://youtube.com/other/{v}"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", T.video_id(F.col("u")).alias("v")).collect()
    assert [r["v"] for r in sorted(rows)] == [v, v, v, v, None, None, None]


def test_json_commands_and_ranges(spark):
    got = values(
        spark, a=T.json_object(F.lit('{"a": 1}')), b=T.json_object(F.lit("[1]")), c=T.command(F.lit("/plan make it")), d=T.command(F.lit("plain")),
        e=T.byte_range(F.lit("bytes=5-"), F.lit(10)), f=T.byte_range(F.lit("bytes=-3"), F.lit(10)), g=T.byte_range(F.lit("bytes=20-30"), F.lit(10)), h=T.citation_spacing(F.lit("a"), F.lit(".")),
    )
    assert got["a"] == {"a": "1"} and got["b"] == {} and tuple(got["c"]) == ("plan", "make it") and got["d"] is None
    assert tuple(got["e"]) == (5, 9) and tuple(got["f"]) == (7, 9) and got["g"] is None and tuple(got["h"]) == (" ", "")


def test_notebook_text(spark):
    got = values(spark, a=T.hard_breaks(F.lit("﻿one\r\ntwo\n\nthree")), n=T.occurrences(F.lit("aaaa"), "aa"), s=T.snippet(F.lit("x" * 100 + " needle " + "y" * 300), ["needle"]), p=T.path_contains(F.lit("/a/b/"), F.lit("/a/b/c")), q=T.path_contains(F.lit("/a/b"), F.lit("/a/bc")))
    assert got["a"] == "one  \ntwo\n\nthree" and got["n"] == 2 and got["s"].startswith("...") and "needle" in got["s"] and got["p"] and not got["q"]


def test_natural_order(spark):
    names = ["page 10", "Page 2", "page 1b", "a"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n"))).collect()
    assert [r["n"] for r in rows] == ["a", "page 1b", "Page 2", "page 10"]


def test_budget_and_terms(spark):
    assert values(spark, a=T.transcript_budget(F.lit(4096), F.lit(None).cast("int")), b=T.transcript_budget(F.lit(30_000), F.lit(0))) == {"a": round((32768 - 4096) * 3.2 * 0.6), "b": 24_000}
    assert T.query_terms("Café cafe RUN-2 run") == ["caf", "cafe", "run", "2", "run"]


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    got = values(spark, d=V.dot(a, a), n=V.norm(a), u=V.unit(a), z=V.unit(F.array(F.lit(0.0), F.lit(0.0))), s=V.sigmoid(F.lit(0.0)), e=V.erf(F.lit(0.5)), g=V.gelu(F.lit(1.0)), m=V.layer_norm(F.array(F.lit(1.0), F.lit(3.0))))
    assert got["d"] == 25 and got["n"] == 5 and [round(x, 6) for x in got["u"]] == [0.6, 0.8] and got["z"] is None and got["s"] == 0.5
    assert abs(got["e"] - math.erf(0.5)) < 2e-7 and abs(got["g"] - 0.841345) < 1e-5 and [round(x, 3) for x in got["m"]] == [-1.0, 1.0]
