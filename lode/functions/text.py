"""Text functions as Column -> Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, here and in the functions below: patterns of links, sheet names, page numbers, capitals, captions, data URIs.
#: Unicode white space, with the separators U+001C to U+001F that Java's class leaves out.
SPACE = "(?U)[\\s\\x1c-\\x1f]"
QUERY_CHARS = 500
CHARS_PER_TOKEN = 3.5


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def tokenize(col: Column) -> Column:
    """Lower-cased words between white space, in order, repeats kept; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(col, F.lit(""))), f"{SPACE}+"), "")


def sentences(col: Column) -> Column:
    """Pieces after a full stop, exclamation or question mark with white space, stripped, blanks dropped."""
    parts = F.split(F.coalesce(col, F.lit("")), "(?<=[.!?])(?U)\\s+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def l2_normalise(v: Column) -> Column:
    """A vector over its norm, in double precision; a zero vector stays as it is."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def html_escape(col: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(plain), F.lit(coded))
    return col


def url_sanitise(col: Column) -> Column:
    """Links with a script or data scheme lead to ``#``."""
    return F.regexp_replace(col, "(?i)(<a\\s[^>]*href\\s*=\\s*[\"'])(?:javascript|vbscript|data):[^\"']*([\"'])", "$1#$2")


def strip_sheet_names(col: Column) -> Column:
    return F.regexp_replace(col, "(?m)^\\s*Thẻ\\s+\\d+\\s*$", "")


def collapse_blank_lines(col: Column) -> Column:
    """Four or more newlines become three."""
    return F.regexp_replace(col, "\n{4,}", "\n\n\n")


def strip_page_numbers(col: Column) -> Column:
    """A paragraph of one to four digits goes."""
    return F.regexp_replace(col, "\n\n\\s*\\d{1,4}\\s*\n\n", "\n\n")


def collapse_spaced_caps(col: Column) -> Column:
    """Three or more single capitals, each one white space apart, lose their blanks; then runs of blanks become one."""
    return F.regexp_replace(_join_runs(col, "\\b[A-Z](?:\\s[A-Z]){2,}\\b"), "  +", " ")


def _join_runs(col: Column, run: str) -> Column:
    """``col`` with the blanks taken out of each match of ``run``."""
    hits = F.regexp_extract_all(col, F.lit(f"({run})"), F.lit(1))
    rest = F.split(col, run, -1)
    return F.array_join(F.zip_with(rest, hits, lambda a, b: F.concat(a, F.coalesce(F.replace(b, F.lit(" "), F.lit("")), F.lit("")))), "")


def attach_captions(col: Column) -> Column:
    """An italic caption stands directly above the list that follows it."""
    return F.regexp_replace(col, "(_[^_\n]+_)\\s*\n\n+(- \\*\\*)", "$1\n$2")


# An image reference, and the mark that an extractor leaves for a picture.
IMAGE = "!\\[([^\\]]*)\\]\\(([^)]+)\\)"
OMITTED = "\\*?\\*?=+>.*?picture\\s*\\[.*?\\].*?omitted.*?<==\\*?\\*?"


def rewrite_images(col: Column) -> Column:
    """Images become their alternative text in brackets, or a placeholder."""
    col = F.regexp_replace(col, "!\\[\\s*\\]\\([^)]+\\)", "[Image: visual content]")
    col = F.regexp_replace(col, "!\\[\\s*([^\\]]*?)\\s*\\]\\(([^)]+)\\)", "[Image: $1]")
    return F.regexp_replace(col, OMITTED, "[Image: visual content]")


def count_images(col: Column) -> Column:
    return (F.regexp_count(col, F.lit(IMAGE)) + F.regexp_count(col, F.lit(OMITTED))).cast("int")


def preview(col: Column, chars: int) -> Column:
    return F.replace(F.substring(col, 1, chars), F.lit("\n"), F.lit(" "))


def clamp_query(col: Column, chars: int = QUERY_CHARS) -> Column:
    return F.substring(strip(col), 1, chars)


def token_estimate(col: Column) -> Column:
    return (F.length(col) / CHARS_PER_TOKEN).cast("int")


def data_uri(col: Column) -> Column:
    """struct(media_type, data) of a base64 image URI; null if it is none."""
    pattern = "^data:(image/\\w+);base64,([\\s\\S]+)"
    kind = F.regexp_extract(col, pattern, 1)
    return F.when(kind != "", F.struct(kind.alias("media_type"), F.regexp_extract(col, pattern, 2).alias("data")))


# Punctuation at a word's edges, and the wrapping of a matched word.
PUNCTUATION = ".,!?;:\"'()[]{}—-"
MARK = ('<span style="background-color:#F9E79F;padding:1px 3px;border-radius:3px;font-weight:600">', "</span>")


def highlight(text: Column, matched: Column) -> Column:
    """Words whose bare form is matched are wrapped; words are joined by single blanks.

    A text without a matched token stays as it is.
    """
    cls = "[" + "".join("\\" + c for c in PUNCTUATION) + "]+"
    bare = lambda w: F.regexp_replace(F.lower(w), f"^{cls}|{cls}$", "")

    def mark(row: Column) -> Column:
        words = F.filter(F.split(row["text"], f"{SPACE}+"), lambda w: w != "")
        marked = F.transform(words, lambda w: F.when(F.array_contains(row["matched"], bare(w)), F.concat(F.lit(MARK[0]), w, F.lit(MARK[1]))).otherwise(w))
        return F.when(F.size(row["matched"]) == 0, row["text"]).otherwise(F.array_join(marked, " "))

    # bound to a lambda variable, so that the matched tokens are found once and not for every word
    return F.get(F.transform(F.array(F.struct(text.alias("text"), matched.alias("matched"))), mark), F.lit(0))
