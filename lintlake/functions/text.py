"""Lines, blanks, escapes, names and number formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space that is trimmed, as a character class.
BLANK = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def lines(content: Column) -> Column:
    """Lines by CRLF, CR or LF; one empty line at the end does not count, and empty content has none."""
    parts = F.split(content, "\r\n|\r|\n", -1)
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>")).otherwise(cut)


def is_blank(line: Column) -> Column:
    return line.rlike(f"^{BLANK}*$")


def pure_comment(line: Column, language: Column) -> Column:
    """Whether a line holds nothing but a comment, by how it begins (or ends) without white space."""
    brace = line.rlike(rf"^{BLANK}*(?://|/\*|\*)|\*/{BLANK}*$")
    return F.when(language == "python", line.rlike(f"^{BLANK}*#")).otherwise(brace)


def language_of(path: Column) -> Column:
    """Language by extension, case-insensitive; null for others."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    ext = F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1))
    return F.when(ext == ".py", "python").when(ext == ".java", "java").when(ext.isin(".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"), "cpp").when(ext.isin(".c", ".h"), "c")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def escape_html(text: Column) -> Column:
    """The five signs; the ampersand first."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def number(value: Column, digits: int = 0) -> Column:
    """Grouped, with exactly ``digits`` decimals, halves away from zero."""
    return F.format_number(F.round(value.cast("double"), digits), digits)


def percent(share: Column) -> Column:
    """A share as percent with one decimal."""
    return F.concat(F.format_number(F.round(share.cast("double") * 100, 1), 1), F.lit("%"))


def shown_date(moment: Column) -> Column:
    """A timestamp to the minute, year first, in the session's time zone."""
    return F.date_format(moment, "yyyy/MM/dd HH:mm")


def location(file: Column, start: Column, end: Column) -> Column:
    """``file:start-end`` for a range, else the file."""
    ranged = F.concat(file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when(F.coalesce(start, F.lit(0)) > 0, ranged).otherwise(file)


def report_name(key: Column) -> Column:
    """A file name from a project key: ASCII letters, digits, ``_``, ``.`` and ``-`` only."""
    name = F.regexp_replace(F.regexp_replace(key, r"[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")
    return F.when(name == "", "analysis-report").otherwise(name)
