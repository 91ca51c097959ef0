"""Putting text that page breaks cut apart back together. Everything is worked out within its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, bound, stripped

#: Fixed values.
PAGE_BREAK = r"\n{0,2}(?<!\|)-{3,}(?!\|)\n{0,2}"
TABLE_RULE = r"^\|(?:[-:]+\|)+$"
DATA_ROW = rf"^\|{SPACE}*[0-9]+{SPACE}*\|"
SENTENCE_END = ".。!?|#"
HYPHEN, UNHYPHENED = "([가-힣a-zA-Z])-\n([가-힣a-zA-Z])", "$1$2"
BLANK_LINES, TABLE_GAP = r"\n{3,}", r"(\|[^\n]+)\n\n+(\|)"

_BLANK = SPACE.replace(r"\t-\r", r"\t\x0B-\r")
#: A line end before a line that is neither blank nor a table rule.
_BEFORE_SOLID = rf"\n(?!{_BLANK}*+(?:\|(?![-:|]*\|\|)[-:][-:|]*\|{_BLANK}*+)?(?:\n|\z))"


def segments(c: Column) -> Column:
    """What page breaks lie between."""
    return F.split(c, PAGE_BREAK, -1)


def joined_segments(parts: Column) -> Column:
    """Segments in one text: table rows on the next line, an open sentence without a gap, anything else after a blank line.

    Blank segments between others leave no trace, so each of the others is looked
    at with its neighbour alone.
    """

    def gap(tail: Column, head: Column) -> Column:
        table = tail.endswith("|") & head.startswith("|")
        open_ = (F.length(tail) > 0) & ~F.right(tail, F.lit(1)).isin(*SENTENCE_END)
        return F.concat(F.when(table, "\n").when(open_, "").otherwise("\n\n"), head)

    left = lambda c: F.regexp_replace(c, f"^{SPACE}+", "")
    right = lambda c: F.regexp_replace(c, f"{SPACE}+$", "")

    def several(p: Column) -> Column:
        first, last = F.array(right(F.element_at(p, 1))), F.array(left(F.element_at(p, -1)))
        middle = F.filter(F.transform(F.slice(p, 2, F.size(p) - 2), stripped), lambda x: x != "")
        tails = F.concat(first, middle)
        return bound(tails, lambda t: bound(F.concat(F.slice(t, 2, F.size(t)), last), lambda heads: F.concat(F.element_at(t, 1), F.array_join(F.zip_with(t, heads, gap), ""))))

    return bound(parts, lambda p: F.when(F.size(p) < 2, F.element_at(p, 1)).otherwise(several(p)))


def dehyphenated(c: Column) -> Column:
    return F.regexp_replace(c, HYPHEN, UNHYPHENED)


def squeezed(c: Column) -> Column:
    """At most one blank line, none between table rows."""
    return F.regexp_replace(F.regexp_replace(c, BLANK_LINES, "\n\n"), TABLE_GAP, "$1\n$2")


def is_rule(line: Column) -> Column:
    """What TABLE_RULE says, without its repeated group: Java's engine recurses there, and a line of some 50,000 characters overflows its stack."""
    bare = stripped(line)
    return bare.rlike(r"^\|[-:][-:|]*\|$") & ~line.contains("||")


def without_repeated_rules(c: Column) -> Column:
    """The text without table rules whose last line before, other rules and blank ones aside, is a data row; a null is empty.

    The text is cut before each line that is neither a rule nor blank: what follows
    such a line, up to the next, are all rules that it decides about.
    """
    parts = F.split(F.coalesce(c, F.lit("")), _BEFORE_SOLID, -1)
    head = lambda part: stripped(F.substring_index(part, "\n", 1))
    bare = lambda part: F.array_join(F.filter(F.split(part, "\n", -1), lambda line: ~is_rule(line)), "\n")
    return F.array_join(F.transform(parts, lambda part: F.when(head(part).rlike(DATA_ROW), bare(part)).otherwise(part)), "\n")


def merged_page_breaks(c: Column) -> Column:
    """The text with page breaks undone: sentences and tables joined, hyphens across lines and repeated table rules dropped, blank lines squeezed. A null is empty."""
    return squeezed(without_repeated_rules(dehyphenated(joined_segments(segments(F.coalesce(c, F.lit("")))))))


def merge_page_breaks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) of each row, page breaks undone; keys may repeat or be null."""
    return df.select(key, merged_page_breaks(F.col(text)).alias(text))
