"""Text functions on columns; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats that are read and written.
LIST_ITEM = r"^(\s*(?:\*|-|\+|\d+[.)])\s+)(.*)"
FENCE = r"^[ \t]{0,3}(```+|~~~+)"
HEADING = r"^(#{1,6})\s+(.*)$"
QUOTES = "\"'`“”‘’"
QUOTE_PAIRS = (('"', '"'), ("'", "'"), ("“", "”"), ("”", "“"), ("‘", "’"), ("`", "`"))
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))
REFUSALS = ("不知道", "我不知道", "无法回答")
MARKDOWN_SYNTAX = (r"^!\[.*\]\(.*\)", r"^\[[^\]]+\]\([^)]+\)", r"^#{2,6}\s+", r"^[-*+]\s+", r"^\d+[.)]\s+", r"^\|(.*\|)?$", r"^>")


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """Line ends to \\n, \\_ to _, three or more blanks to two, three or more hyphens to two."""
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\_"), F.lit("_")), " {3,}", "  "), "-{3,}", "--")


def finalize(c: Column) -> Column:
    """At most one empty line in a row, no white space around, one line end at the end."""
    return F.concat(strip(F.regexp_replace(c, "\n{3,}", "\n\n")), F.lit("\n"))


def rstrip_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")


def unescape_entities(c: Column) -> Column:
    """Six entities, one after another in this order, so an escaped ampersand may make a later one."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def is_markdown_syntax(line: Column) -> Column:
    return any_of(line.rlike(p) for p in MARKDOWN_SYNTAX)


def has_paired_marker(c: Column) -> Column:
    """Is there ** or == with text right after it and a second one with text right before it?"""
    def paired(m: str) -> Column:
        first = F.instr(c, m)
        rest = F.substring(c, first + F.lit(2), F.length(c))
        second = F.instr(rest, m)
        close = F.when(second == 1, F.lit(m[1])).otherwise(F.substring(rest, second - F.lit(1), F.lit(1)))
        return (first > 0) & (F.length(rest) > 0) & ~F.startswith(rest, F.lit(" ")) & (second > 0) & (close != " ")

    return paired("**") | paired("==")


def is_title_only(c: Column) -> Column:
    t = strip(c)
    return F.startswith(t, F.lit("#")) & ~F.contains(t, F.lit("\n"))


def has_level_one(c: Column) -> Column:
    """A first-level heading in a text without code fences."""
    return c.rlike(r"(?m)^# [^#]")


def prepend_heading(c: Column, stem: Column) -> Column:
    return F.when(has_level_one(c), c).otherwise(F.concat(F.lit("# "), stem, F.lit("\n\n"), F.regexp_replace(c, r"(?U)^\s+", "")))


def rewrite_images(c: Column, folder: Column, base: str = "/static/ref_md/") -> Column:
    """Image targets get the served folder and forward slashes; addresses with a scheme stay, and so do their slashes."""
    c = F.regexp_replace(c, r"(!\[[^\]]*\]\([^)\\]*)\\", "$1/")
    return F.regexp_replace(c, F.lit(r"!\[([^\]]*)\]\((?!\w+://|/)([^)]*)\)"), F.concat(F.lit(f"![$1]({base}"), folder, F.lit("/$2)")))


def sanitize_query(c: Column) -> Column:
    return strip(F.translate(c, QUOTES, ""))


def is_quoted(c: Column) -> Column:
    t = strip(c)
    return any_of(F.startswith(t, F.lit(a)) & F.endswith(t, F.lit(b)) & (F.length(strip(F.substring(t, F.lit(2), F.length(t) - 2))) > 0) for a, b in QUOTE_PAIRS) & (F.length(t) > 1)


def clean_definition(c: Column) -> Column:
    c = F.replace(c, F.lit('""'), F.lit('"'))
    c = F.when((F.length(c) > 1) & F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)
    c = F.regexp_replace(c, r'<a\s+href="entry://[^"]+">([^<]+)</a>', "$1")
    c = F.replace(F.replace(c, F.lit("■"), F.lit("\n- ")), F.lit("<br>"), F.lit("\n"))
    return F.coalesce(strip(F.regexp_replace(c, "\n+", "\n")), F.lit(""))


def matching_sections(text: Column, terms: Column) -> Column:
    """Sections (each from a [SECTION] mark) that hold any of the terms as a whole ASCII word, whatever the case."""
    parts = F.split(text, r"(?=\[SECTION\])")
    hit = lambda s: F.exists(terms, lambda t: F.rlike(s, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])\Q"), t, F.lit(r"\E(?![A-Za-z0-9_])"))))
    return F.array_join(F.transform(F.filter(parts, hit), strip), "\n\n")


def sanitize_utf8(c: Column) -> Column:
    return F.make_valid_utf8(c)


def hybrid_tokens(c: Column, segments: Column | None = None) -> Column:
    """Segmenter tokens, if given, and then runs of ASCII letters, digits and _; those of one character go."""
    words = F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]{2,}"), F.lit(0))
    return words if segments is None else F.concat(F.filter(F.transform(segments, lambda t: F.trim(t)), lambda t: F.length(t) > 1), words)


def cjk_bigrams(c: Column) -> Column:
    """The default segmenter: neighbouring pairs of CJK ideographs."""
    runs = F.regexp_extract_all(c, F.lit("[一-鿿]{2,}"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))


def exact_terms(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?U)\b[A-Za-z][A-Za-z0-9_]+\b"), F.lit(0)), F.lower))


def rounded(c: Column, digits: int) -> Column:
    """A double to `digits` as DuckDB rounds it: scaled, half away from zero. F.round goes by the decimal digits, so it
    rounds 0.00015 up, which scaled is below the half."""
    v = F.abs(c) * 10.0**digits
    whole = F.floor(v).cast("double")
    return F.when(v < 2.0**52, F.signum(c) * (whole + F.when(v - whole >= 0.5, 1.0).otherwise(0.0)) / 10.0**digits).otherwise(c)


def token_analysis(c: Column) -> Column:
    words = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), F.lower))
    return F.struct(words.alias("english_words"), F.size(words).alias("english_count"), F.regexp_count(c, F.lit("[一-鿿]")).alias("chinese_count"))


def rough_tokens(c: Column) -> Column:
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 2))).cast("long")


def parent_header(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) <= 1, "/").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), "/"), F.lit("/")))


def relative_to_parent(parent: Column, target: Column) -> Column:
    rest = F.substring(target, F.length(parent) + 1, F.length(target))
    return F.when(F.startswith(target, parent), F.when(rest == "", "").otherwise(F.concat(F.lit("/"), rest))).otherwise(target)


def wrap_section(path: Column, text: Column) -> Column:
    header = F.replace(F.trim(path, F.lit("/")), F.lit("/"), F.lit(" > "))
    return F.concat(F.lit("[SECTION]\n"), header, F.lit("\n\n[CONTENT]\n"), text)


def duration(ms: Column) -> Column:
    ms = F.floor(ms).cast("long")
    s = F.floor(ms / 1000).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes = F.floor(s / 60).cast("long")
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(F.round(ms.cast("decimal(20,3)") / 1000, 2).cast("decimal(20,2)").cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"), two(s % 60), F.lit("s")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("long").cast("string"), F.lit("h"), two(minutes % 60), F.lit("m"), two(s % 60), F.lit("s")))
    )


#: Upper bounds in ms and what is shown below each.
SPEEDS = ((500, "⚡"), (2000, "🚀"), (5000, "✈️"), (10000, "🚅"), (20000, "🚗"), (40000, "🏃"), (60000, "🚶"))


def speed(ms: Column) -> Column:
    return reduce(lambda c, x: c.when(ms < x[0], x[1]), SPEEDS[1:], F.when(ms < SPEEDS[0][0], SPEEDS[0][1])).otherwise("🐢")


def is_refusal(c: Column) -> Column:
    return any_of(F.startswith(strip(c), F.lit(r)) for r in REFUSALS)


def cosine(a: Column, b: Column) -> Column:
    d = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def safe_link(url: Column) -> Column:
    """A link's target: the address if it parses, else the text as it is."""
    return F.coalesce(F.when(F.try_parse_url(url, F.lit("HOST")).isNotNull(), url), url)
