"""Text functions as Column expressions; nothing here runs Python on rows.

Lengths count code points. White space is that of ECMAScript, which is wider than Java's ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OTHERS = "\\t\\n\\u000B\\f\\r\\u00a0\\ufeff\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACE = "[\\s\\u000B\\u00a0\\ufeff\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+\\z", "")


def right_trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+\\z", "")


def collapsed(c: Column) -> Column:
    """All runs of white space as one space, ends trimmed.

    Single spaces are left alone, and one range settles most characters: no more than a few places need the long class.
    """
    return F.trim(F.regexp_replace(c, f"(?=[^!-~])(?:[{_OTHERS}]{SPACE}*| {SPACE}+)", " "))


def normalized(c: Column) -> Column:
    """Runs of spaces and tabs as one space, ends trimmed; line feeds stay."""
    return trimmed(F.regexp_replace(c, "[ \\t]+", " "))


def _clipped(c: Column, limit: int, mark: str) -> Column:
    """Collapsed text of at most ``limit`` characters, with ``mark`` where it was cut.

    The start of a text decides if it collapses to more than ``limit`` characters; otherwise the whole text is looked at.
    """
    start = collapsed(F.substring(c, 1, limit + limit // 4 + 16))
    enough = bound(start, lambda x: F.when(F.char_length(x) > limit, x).otherwise(collapsed(c)))
    return bound(enough, lambda x: F.when(F.char_length(x) <= limit, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, limit)), F.lit(mark))))


def compact(c: Column, limit: int) -> Column:
    """Collapsed text of at most ``limit`` characters, with ``...`` where it was cut."""
    return _clipped(c, limit, "...")


def preview(c: Column, limit: int = 100) -> Column:
    """Like :func:`compact` with one ellipsis character."""
    return _clipped(c, limit, "…")


def clamped(c: Column, limit: int) -> Column:
    return F.substring(trimmed(c), 1, limit)


def clamped_integer(c: Column, least: int, most: int, fallback: int) -> Column:
    """Text or number as an integer within bounds; ``fallback`` if it is no number."""
    number = F.coalesce(c.try_cast("double"), F.lit(float(fallback)))
    return F.least(F.lit(most).cast("long"), F.greatest(F.lit(least).cast("long"), F.floor(number)))


def cleaned_page(c: Column) -> Column:
    """Lines normalised one by one, blank ones dropped."""
    lines = F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n")
    return F.array_join(F.filter(F.transform(lines, normalized), lambda x: x != ""), "\n")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, f"{SPACE}+"), lambda w: w != ""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, as case-insensitive matching of the embedded store does."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def ascii_contains(c: Column, token: str) -> Column:
    """Substring match that ignores the case of A-Z; ``%`` and ``_`` are plain characters."""
    return ascii_lower(c).contains(token.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER)))


def like_escaped(c: Column) -> Column:
    """A token as a LIKE pattern that matches itself anywhere (escape character ``\\``)."""
    return F.concat(F.lit("%"), F.regexp_replace(c, "([\\\\%_])", "\\\\$1"), F.lit("%"))


#: Accented letters of Latin-1 that the corpus has, and what they lose their mark to.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def folded(c: Column) -> Column:
    """Lower case, Latin-1 marks removed."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def index_tokens(c: Column) -> Column:
    """Array of index terms: runs of letters and digits of the folded text."""
    return F.array_remove(F.split(folded(c), "[^\\p{L}\\p{N}]+"), "")


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def term_counts(terms: Column) -> Column:
    """Array of terms as (term, tf), each term once, in order."""

    def runs(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return bound(heads, lambda h: F.transform(h, lambda at, k: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(h, k + 1), F.size(s)) - at).cast("long").alias("tf"))))

    return F.when(F.size(terms) > 0, bound(F.array_sort(terms), runs))


def term_occurrences(folded: Column, term: str) -> Column:
    """How often an index term occurs in folded text, as a whole run of letters and digits."""
    return F.regexp_count(folded, F.lit(f"{term}(?<![\\p{{L}}\\p{{N}}]{term})(?![\\p{{L}}\\p{{N}}])"))


def query_terms(query: str) -> list[str]:
    """Terms of a query, repeats kept: runs of ASCII letters and digits of its lower case."""
    out, run = [], ""
    for ch in query.lower() + " ":
        if ch in "abcdefghijklmnopqrstuvwxyz0123456789":
            run += ch
        elif run:
            out.append(run)
            run = ""
    return out


def cleaned_values(c: Column) -> Column:
    """Filter list: trimmed, blanks dropped, first of equals kept."""
    return F.array_distinct(F.filter(F.transform(c, trimmed), lambda x: x != ""))


def file_extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "(\\.[^.\\\\/]+)$", 1))


def title_of(c: Column) -> Column:
    """File name without folders and extension."""
    name = F.regexp_extract(c, "([^/\\\\]*)$", 1)
    return F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")


def document_id(path: Column) -> Column:
    return F.sha2(path, 256)


def chunk_id(path: Column, page: Column, index: Column, kind: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\n", path, page.cast("string"), index.cast("string"), kind, content), 256)


def managed_name(content: Column, extension: Column) -> Column:
    """Name of a stored file by its bytes: equal files get equal names."""
    return F.concat(F.substring(F.sha2(content, 256), 1, 16), extension)


def normalized_tag(c: Column) -> Column:
    return F.lower(F.regexp_replace(trimmed(c), "^#", ""))


def valid_tag(c: Column) -> Column:
    return c.rlike("^[a-z0-9][a-z0-9_-]{0,39}$")


def tag_hue(c: Column) -> Column:
    """FNV-1a of the characters, as a hue of 0 to 359 (characters of the basic plane)."""
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    mask = F.lit(4294967295).cast("long")

    def step(h: Column, letter: Column) -> Column:
        mixed = h.bitwiseXOR(F.ascii(letter).cast("long"))
        # 16777619 = 2**24 + 403: the product stays inside 64 bits.
        return (F.shiftleft(mixed.bitwiseAND(F.lit(255).cast("long")), 24) + mixed * F.lit(403).cast("long")).bitwiseAND(mask)

    return (F.aggregate(letters, F.lit(2166136261).cast("long"), step) % 360).cast("int")


def timestamp_label(ms: Column) -> Column:
    """Milliseconds as ``m:ss``, from one hour on ``h:mm:ss``."""
    total = F.floor(F.greatest(ms, F.lit(0)) / 1000).cast("long")
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def byte_label(n: Column, largest: str = "GB") -> Column:
    """Bytes with one decimal in the unit below which they fall; from ``largest`` on, in that."""
    units = ("KB", "MB", "GB")[: ("KB", "MB", "GB").index(largest) + 1]
    label = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(units, 1):
        shown = F.format_string(f"%.1f {unit}", n / 1024.0**i)
        label = label.otherwise(shown) if unit == largest else label.when(n < 1024.0 ** (i + 1), shown)
    return label


def seek_suffix(ms: Column) -> Column:
    return F.concat(F.lit("&t="), F.greatest(F.lit(0), F.floor(ms / 1000)).cast("string"), F.lit("s"))


def video_id(c: Column) -> Column:
    """Eleven-character video id of a bare id or of the known URL forms, else null."""
    text = trimmed(c)
    url = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")
    path = F.try_parse_url(url, F.lit("PATH"))
    query = F.try_parse_url(url, F.lit("QUERY"), F.lit("v"))
    shaped = lambda x: F.when(x.rlike("^[A-Za-z0-9_-]{11}$"), x)
    known = host.rlike("(^|\\.)(youtube\\.com|youtube-nocookie\\.com|youtu\\.be)$")
    short = F.when(host == "youtu.be", F.regexp_extract(path, "^/+([^/]+)", 1))
    long = F.when(host != "youtu.be", F.regexp_extract(path, "^/+(?:shorts|embed|live|v)/+([^/]+)", 1))
    return F.coalesce(shaped(text), F.when(known, F.coalesce(shaped(query), shaped(short), shaped(long))))


def location_label(source_type: Column, page: Column, shown: Column) -> Column:
    """Where a chunk is: transcripts have no page, spreadsheets have sheets."""
    number = (page + 1).cast("string")
    return F.when(source_type.isin("AUDIO", "YOUTUBE"), shown).when(source_type == "XLSX", F.concat(F.lit("Sheet "), number, F.lit(": "), shown)).otherwise(F.concat(F.lit("Page "), number, F.lit(": "), shown))


def viewer_link(source_type: Column, document: Column, chunk: Column, page: Column) -> Column:
    ref = F.url_encode(document)
    at = F.url_encode(chunk)
    return (
        F.when(source_type.isin("AUDIO", "YOUTUBE"), F.concat(F.lit("/transcripts/"), ref, F.lit("?chunk="), at))
        .when(source_type.isin("TEXT", "CSV", "XLSX"), F.concat(F.lit("/text-documents/"), ref, F.lit("?chunk="), at))
        .otherwise(F.concat(F.lit("/document-files/"), ref, F.lit("#page="), (page + 1).cast("string")))
    )


def json_clipped(c: Column, limit: int = 32_000) -> Column:
    return F.substring(F.to_json(c), 1, limit)


def json_object(c: Column) -> Column:
    """A JSON object as a map of strings; anything else is the empty map."""
    return F.coalesce(F.from_json(F.when(F.ltrim(c).startswith("{"), c), "map<string,string>"), F.create_map().cast("map<string,string>"))


def escaped_label(c: Column) -> Column:
    return F.regexp_replace(c, "([\\\\\\[\\]])", "\\\\$1")


def escaped_cell(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(escaped_label(c), "\\|", "\\\\|"), "[\\r\\n]+", " ")


def citation_spacing(before: Column, after: Column) -> Column:
    """Spaces that a citation needs towards its neighbours."""
    left = F.when((before != "") & ~before.rlike("[\\s(\\[{]$"), " ").otherwise("")
    right = F.when((after != "") & ~after.rlike("^[\\s.,;:!?)}\\]]"), " ").otherwise("")
    return F.struct(left.alias("prefix"), right.alias("suffix"))


def slug(c: Column, fallback: Column | str = "page") -> Column:
    """Lower case, Latin-1 marks removed, other characters as single dashes, at most 80."""
    plain = F.translate(F.lower(c), ACCENTED, PLAIN)
    dashed = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, 80), "-+$", "")
    return F.when(cut != "", cut).otherwise(F.lit(fallback) if isinstance(fallback, str) else fallback)


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` occurs, from left to right without overlap."""
    return F.floor((F.char_length(text) - F.char_length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def snippet(content: Column, terms: list[str], limit: int = 180) -> Column:
    """A window of the collapsed text that begins a third before the first term."""

    def first(lower: Column) -> Column:
        places = F.filter(F.array(*[F.locate(t, lower) for t in terms]), lambda p: p > 0)
        return F.greatest(F.lit(0), F.coalesce(F.array_min(places), F.lit(1)) - 1 - limit // 3)

    def window(flat: Column, start: Column) -> Column:
        more = F.char_length(flat) > start + limit
        return F.concat(F.when(start > 0, "...").otherwise(""), F.trim(flat.substr(start + 1, F.lit(limit))), F.when(more, "...").otherwise(""))

    shown = lambda flat: bound(bound(F.lower(flat), first), lambda start: window(flat, start))
    return bound(collapsed(content), lambda flat: F.when(flat == "", "Empty page").otherwise(shown(flat)))


def command(c: Column) -> Column:
    """``/name rest`` as (name, rest); null if the text is no command."""
    name = F.regexp_extract(trimmed(c), "^/(\\S+)", 1)
    rest = trimmed(F.regexp_extract(trimmed(c), "^/\\S+\\s*([\\s\\S]*)$", 1))
    return F.when(name != "", F.struct(name.alias("name"), rest.alias("rest")))


def without_byte_order_mark(c: Column) -> Column:
    return F.regexp_replace(c, "^\\ufeff", "")


def hard_breaks(c: Column) -> Column:
    """Plain text as Markdown: two spaces end a line whose next line is not blank."""
    lines = F.split(F.replace(without_byte_order_mark(c), F.lit("\r\n"), F.lit("\n")), "\n")

    def mark(all_lines: Column) -> Column:
        after = lambda i: F.coalesce(F.get(all_lines, i + 1), F.lit(""))
        return F.array_join(F.transform(all_lines, lambda x, i: F.when((trimmed(x) != "") & (trimmed(after(i)) != ""), F.concat(right_trimmed(x), F.lit("  "))).otherwise(x)), "\n")

    return F.transform(F.array(lines), mark)[0]


def natural_key(c: Column) -> Column:
    """Sort key that orders digit runs by value, ignoring case."""
    padded = F.regexp_replace(F.lower(c), "(\\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, "\\d*(\\d{20})", "$1")


def byte_range(header: Column, size: Column) -> Column:
    """``bytes=a-b`` over a file of ``size`` bytes as (start, end); null if it cannot be met."""
    first = F.regexp_extract(header, "^bytes=(\\d*)-(\\d*)$", 1)
    last = F.regexp_extract(header, "^bytes=(\\d*)-(\\d*)$", 2)
    start = F.when(first != "", first.cast("long")).otherwise(F.greatest(F.lit(0), size - last.try_cast("long")))
    end = F.when((first != "") & (last != ""), F.least(last.cast("long"), size - 1)).otherwise(size - 1)
    return F.when(header.rlike("^bytes=(\\d+-\\d*|-\\d+)$") & (start <= end) & (start < size), F.struct(start.alias("start"), end.alias("end")))


def log_line(time: Column, level: Column, subsystem: Column, message: Column) -> Column:
    return F.concat_ws(" ", time, F.rpad(F.upper(level), 5, " "), F.concat(F.lit("["), subsystem, F.lit("]")), message)


def scrubbed(c: Column, home: str) -> Column:
    """Text in which the user's folder is ``~``."""
    return F.replace(c, F.lit(home), F.lit("~"))


def long_date(ts: Column, zone: str) -> Column:
    """ISO instant and long English form in a zone."""
    there = F.from_utc_timestamp(ts, zone)
    return F.struct(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), F.date_format(there, "EEEE, MMMM d, yyyy 'at' h:mm:ss a").alias("local"), F.lit(zone).alias("zone"))


def path_contains(parent: Column, child: Column) -> Column:
    """Whether ``child`` lies strictly inside the folder ``parent``."""
    folder = F.regexp_replace(parent, "/+$", "")
    return child.startswith(F.concat(folder, F.lit("/"))) & ~child.contains("/../") & (child != F.concat(folder, F.lit("/")))


def preview_path(path: Column) -> Column:
    return F.regexp_replace(path, "\\.[^./]*$", ".pdf")


def transcript_budget(max_tokens: Column, reasoning: Column) -> Column:
    """Characters that a transcript may have beside the reserved tokens of a 32,768-token window."""
    free = 32_768 - (max_tokens + F.greatest(F.lit(0), F.coalesce(reasoning, F.lit(0))))
    return F.greatest(F.lit(24_000).cast("long"), F.round(free * 3.2 * 0.6).cast("long"))


def sanitized(c: Column, allowed: tuple[str, ...], default: str) -> Column:
    """A value of the allowed ones, else the default."""
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def split_outputs(outputs: Column, shown: int = 5) -> Column:
    """Tool outputs (array of structs with ``type``) as the first sources and the others."""
    sources = F.filter(outputs, lambda o: o["type"] == "source")
    return F.struct(F.slice(sources, 1, shown).alias("sources"), F.size(sources).alias("n_sources"), F.filter(outputs, lambda o: o["type"] != "source").alias("others"))


def tool_title(name: Column, argument: Column) -> Column:
    """A trace line's title: the tool's words, and what it was asked."""
    words = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    return F.when(F.coalesce(argument, F.lit("")) == "", words).otherwise(F.concat(words, F.lit(": "), compact(argument, 80)))
