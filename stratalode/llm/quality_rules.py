"""Quality rules: a threshold table compiled into one Spark projection.

Everything is a built-in expression: words come from one split, repeated windows from hashes of eight words
(sorted only in texts that repeat one), lines from a split at line feeds. A rule is a row of a table, a measure
with the least and greatest ratio it may have; ratios are compared by cross-multiplied integers.

Defined cases: null text has no words and fails; an empty table gives no rows; repeated rows are judged alike;
columns of the input that share a name with a measure are not touched (measures are in a struct).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keys

#: What separates words, as a regular expression and as characters.
_GAP, _GAPS = "[\\x20\\x09-\\x0D]+", " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Very common words of the languages that the corpus is in.
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que pour est dans qui par sur pas au avec "
    "el y los se las del por con no una su para al es lo"
)


@dataclass(frozen=True)
class Rule:
    """``least <= measure / per <= greatest``, in percent; None is no bound. ``per`` 0 passes."""

    measure: str
    per: str
    least: int | None = None
    greatest: int | None = None


#: The production table: lengths, symbols, shouting, stop words, repeated lines.
RULES = (
    Rule("word_chars", "n_words", least=200, greatest=1500),
    Rule("n_symbols", "n_words", greatest=10),
    Rule("n_marks", "n_words", greatest=40),
    Rule("n_stop_words", "n_words", least=2),
    Rule("n_dup_lines", "n_lines", greatest=60),
    Rule("n_upper", "word_chars", greatest=50),
)


def _bind(value: Column, use) -> Column:
    """use(value) with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(hashes: Column, size: int) -> Column:
    """Words in windows of ``size`` words that occur twice or more."""

    def covered(keys: Column) -> Column:
        ordered = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def of(rows: Column) -> Column:
            same = lambda x, i: ((i > 0) & (rows[i - 1]["k"] == x["k"])) | ((i + 1 < F.size(rows)) & (rows[i + 1]["k"] == x["k"]))
            places = F.array_sort(F.transform(F.filter(rows, same), lambda x: x["i"]))
            return _bind(places, lambda p: F.aggregate(F.transform(p, lambda at, i: F.when(i + 1 < F.size(p), F.least(F.lit(size), F.get(p, i + 1) - at)).otherwise(F.lit(size))), F.lit(0), lambda s, x: s + x))

        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), _bind(ordered, of)).otherwise(0)

    keys = F.transform(F.sequence(F.lit(1), F.size(hashes) - (size - 1)), lambda i: F.xxhash64(F.slice(hashes, i, size)))
    return F.when(F.size(hashes) >= size, _bind(keys, covered)).otherwise(0)


def _computed(frame: DataFrame, **columns: Column) -> DataFrame:
    """``frame`` with columns that the optimizer neither repeats where they are used nor moves below: a generator of one row."""
    return frame.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def measured(documents: DataFrame, text_col: str, window: int = 8) -> DataFrame:
    """``documents`` with a struct ``_m`` of all measures; one stage without a shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lists = _computed(documents, _words=F.filter(F.split(text, _GAP), lambda w: w != ""), _lines=F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_GAPS)) != ""))
    hashed = _computed(lists, _hashes=F.transform("_words", lambda w: F.xxhash64(w)))
    count = lambda characters: F.char_length(text) - F.char_length(F.translate(text, characters, ""))
    stop = sorted(set(STOP_WORDS.split()))
    measures = {
        "n_words": F.size("_words"),
        "word_chars": F.char_length(F.translate(text, _GAPS, "")),
        "n_symbols": count(SYMBOLS),
        "n_marks": count("!?"),
        "n_upper": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(stop))),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeat_words(F.col("_hashes"), window),
    }
    return _computed(hashed, _m=F.struct(*[c.cast("long").alias(k) for k, c in measures.items()])).drop("_words", "_lines", "_hashes")


def verdict(rules=RULES) -> Column:
    """True if every rule holds."""
    out = F.lit(True)
    for r in rules:
        value, per = F.col(f"_m.{r.measure}") * 100, F.col(f"_m.{r.per}")
        if r.least is not None:
            out = out & (value >= per * r.least)
        if r.greatest is not None:
            out = out & (value <= per * r.greatest)
    return out


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("_m.n_words") < 20) | (F.col("_m.n_repeat_words") * 100 > F.col("_m.n_words") * 30)


def quality_rules(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document row: id, the base measures, base_failed, kept."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = measured(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    return judged.select("id", *[F.col(f"_m.{n}").alias(n) for n in names], base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def keep_good(documents: DataFrame, *, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``documents`` that the rules keep, all columns unchanged."""
    rows = documents.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    return measured(rows, "_text").filter(~base_failed() & verdict(rules)).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(keys.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumnRenamed("id", "doc_id")


_QUOTED = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
windows AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
             len(list_filter(ws, lambda x: lower(x) IN ({_QUOTED}))) AS n_stop,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words AND 100 * n_symbols <= 10 * n_words
       AND 100 * n_marks <= 40 * n_words AND 100 * n_stop >= 2 * n_words AND 100 * n_dup_lines <= 60 * n_lines AND 100 * n_upper <= 50 * word_chars AS kept
FROM b
"""
