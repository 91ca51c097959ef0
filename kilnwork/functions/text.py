"""Cleaning, cutting and tokenising text with built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = r"\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: White space as Unicode has it; the same class in every engine.
SPACE = f"[{_SPACES}]"
#: Its characters one by one.
SPACE_CHARACTERS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Runs that are tokens, and the particles that are taken off the end of Hangul ones.
TOKEN = "[가-힣]+|[a-zA-Z]+|[0-9]+"
PARTICLE = "^([가-힣]+?)(?:에서|[을를이가은는의에과와도로])$"
#: Markup to text, in this order. It is an approximation of a markdown and HTML parser.
MARKUP = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<(script|style|template)\b[^>]*>.*?</(?:script|style|template)>", ""),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?m)^[ ]{0,3}\[[^\]]+\]:[ \t]*[^\t-\r ]+[^\n]*$", ""),
    (r"(?m)^[ ]{0,3}#{1,6}[ \t]+", ""),
    (r"(?m)^[ ]{0,3}>[ ]?", ""),
    (r"(?m)^[ ]{0,3}(?:[-*_][ ]*){3,}$", ""),
    (r"(?m)^[ ]{0,3}(?:[-*+]|[0-9]+\.)[ \t]+", ""),
    (r"\*\*([^*\n]+)\*\*", "$1"),
    (r"\*([^*\t-\r ][^*\n]*)\*", "$1"),
    (r"`([^`\n]+)`", "$1"),
    (r"</?[a-zA-Z!][^>]*>", ""),
]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
FENCE = r"(?s)```.*?```"
MIN_CLEAN = 10
SIZE, OVERLAP = 500, 50


def _lines(pattern: str) -> str:
    """Only \\n ends a line."""
    return pattern.replace("(?m)", "(?md)")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def without_fences(c: Column) -> Column:
    return F.regexp_replace(c, FENCE, "")


def markup_to_text(c: Column, block_newlines: bool = False) -> Column:
    """Text of markdown or HTML; with block_newlines the ends of HTML blocks are line ends."""
    if block_newlines:
        c = F.regexp_replace(c, r"(?i)</(?:p|div|li|h[1-6]|tr|ul|ol|table|article|nav)>|<br\s*/?>", "$0\n")
    for pattern, new in MARKUP:
        c = F.regexp_replace(c, _lines(pattern), new)
    for entity, new in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(new))
    return c


def is_noise_line(line: Column) -> Column:
    """Blank, or over 5 characters of which over 30 % are neither ASCII letters or digits, Hangul syllables nor white space."""

    def noise(text: Column) -> Column:
        special = F.length(F.regexp_replace(text, f"[a-zA-Z0-9가-힣{_SPACES}]+", ""))
        return (F.length(text) == 0) | ((F.length(text) > 5) & (special * 10 > F.length(text) * 3))

    return bound(stripped(line), noise)


def without_noise_lines(c: Column) -> Column:
    """Lines that aren't noise, joined with a space."""
    return F.array_join(F.filter(F.split(c, "\n", -1), lambda x: ~is_noise_line(x)), " ")


def collapsed(c: Column) -> Column:
    # A single plain space is left alone, as it is most of what there is.
    return stripped(F.regexp_replace(c, f"{SPACE}{{2,}}|[{_SPACES}&&[^ ]]", " "))


def clean_markdown(c: Column, block_newlines: bool = False) -> Column:
    return collapsed(without_noise_lines(markup_to_text(without_fences(F.coalesce(c, F.lit(""))), block_newlines)))


def chunk_text(c: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of `size` characters that begin every size - overlap characters; none of an empty or null text."""
    if overlap >= size:
        raise ValueError(f"the overlap ({overlap}) must be under the size ({size})")
    starts = F.when(F.length(c) > 0, F.sequence(F.lit(0), F.length(c) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda p: F.substring(c, p + 1, F.lit(size)))


def tokenize(c: Column) -> Column:
    """Runs of Hangul, ASCII letters or digits; one particle off the end of a Hangul run; under 2 characters dropped; lower case."""
    # Hangul sorts after ASCII, so only Hangul runs meet the second pattern.
    bare = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.when(t >= "가", F.regexp_replace(t, PARTICLE, "$1")).otherwise(t))
    return F.transform(F.filter(bare, lambda t: F.length(t) >= 2), F.lower)


def _runs(values: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """use(sorted list, first place of a run, first place behind it) for each run of equal values of the sorted list."""

    def of(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(v), F.lit(1)), lambda i: (i == 1) | (F.get(v, i - 1) != F.get(v, i - 2)))
        return bound(F.when(F.size(v) > 0, starts).otherwise(F.array().cast("array<int>")), lambda s: F.zip_with(s, F.slice(F.concat(s, F.array(F.size(v) + 1)), 2, F.size(s)), lambda a, b: use(v, a, b)))

    return bound(F.sort_array(values), of)


def runs(values: Column) -> Column:
    """The list's distinct values, sorted, each with its count: structs (value, n). A null list has none."""
    return _runs(values, lambda v, a, b: F.struct(F.get(v, a - 1).alias("value"), (b - a).alias("n")))


def counts(values: Column) -> Column:
    """The counts of the list's distinct values, in the values' order."""
    return _runs(values, lambda v, a, b: b - a)


def page_path(department: Column, title: Column) -> Column:
    """department/title, the title with white space and slashes as hyphens and only letters, digits, _ and - otherwise."""
    dashed = F.regexp_replace(stripped(title), f"(?:{SPACE}|/)+", "-")
    return F.concat(department, F.lit("/"), F.regexp_replace(dashed, r"[^\p{L}\p{N}_-]", ""))


def tag_names(tags: Column) -> Column:
    """Tag objects to strings, empty ones dropped; null tags are none."""
    names = F.transform(F.coalesce(tags, F.array().cast("array<struct<tag:string>>")), lambda x: x["tag"])
    return F.filter(names, lambda t: t.isNotNull() & (t != ""))


#: Tags of pages made, and those ensured on pages brought up to date.
CREATED_TAGS, UPDATED_TAGS = ["auto", "pdf"], ["pdf", "updated"]


def merged_tags(tags: Column) -> Column:
    return F.sort_array(F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.array(*map(F.lit, UPDATED_TAGS))))


def has_tag(tags: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))
