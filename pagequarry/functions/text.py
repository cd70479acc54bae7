"""Text functions as Spark expressions, with the SQL fragments that state the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line breaks as code points; ``\s`` differs between regex engines.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = "[^" + WS[1:]
LB = r"(?:\r\n|[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}])"
#: Characters that are words of their own where no spaces are written.
CJK = r"\x{3400}-\x{9fff}\x{3040}-\x{30ff}"
WORD = rf"[{CJK}]|(?:[^\P{{L}}{CJK}]|[^\P{{N}}{CJK}])+"

#: Markdown forms. Java needs (?d) so that only \n ends a line.
MD_HEADING = rf"^ {{0,3}}(#{{1,6}}){WS}+(.+)$"
MD_LIST = rf"(?:\A|\n{WS}*\n){WS}*(?:[-*+] |\p{{Nd}}+\. )"
MD_FENCE = rf"^{WS}*```"
MD_TABLE = rf"^{WS}*\|?{WS}*:?-{{3,}}.*\|"
MD_IMAGE = r"!\[([^\]]*)\]\([^)]*\)"
MD_LINK = r"\[([^\]]+)\]\([^)]*\)"
MD_MARK = rf"^ {{0,3}}#{{1,6}}{WS}+"
MD_FENCE_LINE = rf"^{WS}*```[^\n]*$"
BLANK_LINE = rf"\n{WS}*\n"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def word_units(c: Column) -> Column:
    """Words: runs of letters and digits, and each CJK character."""
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("long")


def clean_text(c: Column) -> Column:
    """Lines with single spaces, without blank ones."""
    lines = F.transform(F.split(c, LB, -1), lambda x: F.btrim(F.regexp_replace(x, f"{WS}+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def markdown_headings(c: Column) -> Column:
    """The hash signs of each heading; code fences are not left out."""
    return F.regexp_extract_all(c, F.lit("(?md)" + MD_HEADING), F.lit(1))


def markdown_title(c: Column) -> Column:
    """The first heading's text, null where there is none."""
    return F.substring(F.get(F.regexp_extract_all(c, F.lit("(?md)" + MD_HEADING), F.lit(2)), F.lit(0)), 1, 500)


def heading_level(headings: Column, level: int) -> Column:
    return F.size(F.filter(headings, lambda h: F.length(h) == level)).cast("long")


def markdown_lists(c: Column) -> Column:
    """Lists that begin the text or follow a blank line."""
    return F.regexp_count(c, F.lit("(?d)" + MD_LIST)).cast("long")


def markdown_code_blocks(c: Column) -> Column:
    return F.floor(F.regexp_count(c, F.lit("(?md)" + MD_FENCE)) / 2).cast("long")


def markdown_tables(c: Column) -> Column:
    return F.regexp_count(c, F.lit("(?md)" + MD_TABLE)).cast("long")


def strip_markdown(c: Column) -> Column:
    """Images and links by their labels, headings and fences without their marks."""
    for pattern, by in ((MD_IMAGE, "$1"), (MD_LINK, "$1"), ("(?md)" + MD_MARK, ""), ("(?md)" + MD_FENCE_LINE, "")):
        c = F.regexp_replace(c, pattern, by)
    return c


def count_paragraphs(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "(?d)" + BLANK_LINE, -1), lambda x: x.rlike(NOT_WS))).cast("long")


def content_status(text: Column, words: Column, js_shell: Column) -> Column:
    return F.when(js_shell, "likely_requires_javascript").when(text == "", "empty").when(words < 30, "too_short").otherwise("ok")
