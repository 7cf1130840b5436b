"""Scalar text functions as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in the order in which they are replaced.
XML_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
HTML_ENTITIES = XML_ENTITIES[:4]
DJOT_SPECIAL = r"([\\*_`\[\]{}^~<>])"


def tokens(text: Column) -> Column:
    """Words between white space; empty ones are dropped."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def xml_escape(text: Column) -> Column:
    return _replaced(text, XML_ENTITIES)


def html_escape(text: Column) -> Column:
    return _replaced(text, HTML_ENTITIES)


def djot_escape(text: Column) -> Column:
    return F.regexp_replace(text, DJOT_SPECIAL, r"\\$1")


def csv_quote(cell: Column) -> Column:
    """Always quoted; a quote inside is doubled."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(cell, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_row(cells: Column) -> Column:
    """A row of an array of cells, of any length."""
    return F.array_join(F.transform(cells, csv_quote), ",")


def padded_number(n: Column, digits: int) -> Column:
    """Zeros on the left up to ``digits``; longer numbers keep all theirs."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.length(s), F.lit(digits)), F.lit("0"))


def initial(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", "?").otherwise(F.upper(F.substring(name, 1, 1)))


def heading_level(line: Column) -> Column:
    """Number of leading # of a heading line, or 0."""
    return F.length(F.regexp_extract(line, "^(#{1,6}) ", 1))


def is_list_item(line: Column) -> Column:
    return line.rlike(r"^[-*] ")


def base_font(name: Column) -> Column:
    """A font's family: without slash, subset prefix and style tail."""
    plain = F.regexp_replace(name, "^/", "")
    return F.regexp_replace(F.regexp_replace(plain, r"^[A-Z]{6}\+", ""), "[,-].*$", "")


def file_stem(path: Column) -> Column:
    """The file name without its folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def byte_size(n: Column) -> Column:
    """Bytes for reading: B, KB or MB with one decimal."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))
    )


def word_attributes(page: Column, x: Column, y: Column, w: Column, h: Column, font: Column, confidence: Column) -> Column:
    """Attributes of a recognised word; confidence 92 is written 0.92."""
    conf = (F.round(confidence * 10) / 1000).cast("string")
    box = F.concat_ws(" ", *[v.cast("long").cast("string") for v in (x, y, w, h)])
    return F.concat(F.lit("{pdf-page="), page.cast("string"), F.lit(' pdf-bbox="'), box, F.lit('" pdf-font="'), font, F.lit('" ocr-conf='), conf, F.lit("}"))


def provenance(attributes: Column, path: Column) -> Column:
    return F.concat_ws("|", attributes, path)


def provenance_parts(joined: Column) -> Column:
    """struct<attributes, path>, split at the first bar."""
    at = F.instr(joined, "|")
    return F.struct(
        F.when(at > 0, F.substring(joined, F.lit(1), at - 1)).otherwise(joined).alias("attributes"),
        F.when(at > 0, F.substring(joined, at + 1, F.length(joined))).otherwise("").alias("path"),
    )


#: Control characters that literal strings name by a letter.
_NAMED_CONTROLS = {"\n": "n", "\r": "r", "\t": "t", "\b": "b", "\f": "f"}


def literal_escape(text: Column) -> Column:
    """A literal string's inner text: brackets and backslashes escaped, controls by letter, other bytes beyond ASCII in octal.

    What is escaped already stays as it is, but for bytes in octal: a backslash before a digit is a backslash of
    the text. The text is cut into escapes, single special bytes and plain runs, and each is written by itself.
    """
    raw = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    parts = F.regexp_extract_all(raw, F.lit(r"\\[()\\nrtbf]|[()\\]|[^\x20-\x7e]|[^()\\\x00-\x1f\x7f-\xff]+"), 0)

    def written(p: Column) -> Column:
        out = F.when((F.length(p) > 1) | p.rlike(r"^[\x20-\x7e]$"), p).otherwise(F.concat(F.lit("\\"), F.lpad(F.conv(F.ascii(p), 10, 8), 3, "0")))
        for control, letter in _NAMED_CONTROLS.items():
            out = F.when(p == control, "\\" + letter).otherwise(out)
        return F.when(p.isin("(", ")", "\\"), F.concat(F.lit("\\"), p)).otherwise(out)

    return F.array_join(F.transform(parts, written), "")


def literal_unescape(text: Column) -> Column:
    """What a literal string's inner text stands for: one to three octal digits are a byte, an unknown escape is its letter, a last lone backslash stays."""
    parts = F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(r"(?s)\\[0-7]{1,3}|\\.|\\|[^\\]+"), 0)

    def meant(p: Column) -> Column:
        octal = F.chr(F.conv(F.substring(p, 2, 3), 8, 10).cast("bigint").bitwiseAND(F.lit(255).cast("bigint")))
        out = F.when(p.rlike(r"^\\[0-7]"), octal).when(p.startswith("\\") & (F.length(p) == 2), F.substring(p, 2, 1)).otherwise(p)
        for control, letter in _NAMED_CONTROLS.items():
            out = F.when(p == "\\" + letter, control).otherwise(out)
        return out

    return F.decode(F.encode(F.array_join(F.transform(parts, meant), ""), "ISO-8859-1"), "UTF-8")
