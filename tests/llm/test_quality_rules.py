import random
import re
from collections import Counter

import pytest

from stratalode.llm import quality_rules as op

WORD = re.compile("[^\x20\x09-\x0d]+")
STOP = set(op.STOP_WORDS.split())


def brute_row(d, t):
    t = t or ""
    ws = WORD.findall(t)
    seen = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    again = {p for i in range(len(ws) - 7) if seen[tuple(ws[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, chars = len(ws), sum(map(len, ws))
    symbols, marks, upper = (sum(t.count(c) for c in cs) for cs in (op.SYMBOLS, "!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    dup = len(lines) - len(set(lines))
    stop = sum(w.lower() in STOP for w in ws)
    failed = n < 20 or 100 * len(again) > 30 * n
    good = 200 * n <= 100 * chars <= 1500 * n and 100 * symbols <= 10 * n and 100 * marks <= 40 * n and 100 * stop >= 2 * n and 100 * dup <= 60 * len(lines) and 100 * upper <= 50 * chars
    return (d, n, chars, symbols, dup, len(again), failed, not failed and good)


def cases():
    rng = random.Random(0)
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c d e f g h"), (5, "the " * 50), (6, "x" * 5000), (7, "One two\x0bthree\x0cfour\rfive"), (8, "line of the text\n" * 9), (9, "é#*$%&|<> ñ"), (10, "!? " * 40), (None, "a\n\na\n b\n"), (10, "!? " * 40), (11, "word with nbsp " * 12)]
    for i in range(40):
        ws = [rng.choice("the of and a b c d e f".split()) + rng.choice(["", "", "x", "#"]) for _ in range(rng.randint(0, 80))]
        ws += ws[: rng.randint(0, 30)]
        out.append((100 + i, "".join(w + rng.choice([" ", " ", "\n"]) for w in ws)))
    return out + [(999, " ".join(f"w{i} of" for i in range(20_000)))]


def test_small_cases_match_brute_force(spark):
    docs = cases()
    frame = spark.createDataFrame([(d, t, 5, "x") for d, t in docs], "doc_id long, text string, n_words int, _words string")
    got = sorted((tuple(r) for r in op.quality_rules(frame).collect()), key=repr)
    assert got == sorted((brute_row(d, t) for d, t in docs), key=repr)
    kept = op.keep_good(frame.drop("_words"))
    assert kept.columns == ["doc_id", "text", "n_words"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, t in docs if brute_row(d, t)[7])


def test_plan_has_no_python_and_no_shuffle(spark):
    frame = spark.createDataFrame(cases(), "doc_id long, text string")
    plan = op.quality_rules(frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_a_rule_is_a_row_of_the_table(spark):
    frame = spark.createDataFrame([(1, "plain words here"), (2, "a | b | c")], "doc_id long, text string")
    kept = op.measured(frame, "text").filter(op.verdict([op.Rule("n_symbols", "n_words", greatest=10)]))
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_empty_table(spark):
    assert op.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_good_documents_stay(spark, sf_dir):
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").join(op.query(spark, sf_dir), "doc_id").filter("not base_failed and not kept")
    assert good.count() == 0


def test_query_matches_duckdb(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        want = db.execute(op.ORACLE).fetchall()
    got = op.query(spark, sf_dir)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
