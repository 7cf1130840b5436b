"""Djot lines as XHTML and as plain text. Inline markup nests, so lines are scanned in Arrow batches."""

from __future__ import annotations

import re
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INLINE = re.compile(
    r"\\(?P<escaped>.)|`(?P<code>[^`]*)`|\*\*(?P<strong>.*?)\*\*|\*(?!\*)(?P<star>[^*]*)\*|_(?P<emph>[^_]*)_|\[(?P<label>(?:\\.|[^\]\\])*)\]\((?P<url>[^)]*)\)"
)
_HEADING = re.compile(r"#{1,6} ")
_ITEM = re.compile(r"[-*] ")
_BODY = '<body xmlns="http://www.w3.org/1999/xhtml">'
_XML = '<?xml version="1.0"?>'
#: Rich text has no headings and no code element.
_CODE = '<span style="font-family:Courier">{}</span>'
_HEADING_TAG = '<p style="font-weight:bold">{}</p>'
_BULLET = "• "


def _xml(text: str) -> str:
    return escape(text, quote=True).replace("&#x27;", "&#39;")


def inline(line: str, html: bool) -> str:
    """Markup of one line; marks without a partner are text."""
    show = _xml if html else str
    out, at = [], 0
    for m in _INLINE.finditer(line):
        out.append(show(line[at : m.start()]))
        at = m.end()
        kind = m.lastgroup if m["label"] is None else "label"
        body = m[kind]
        if kind == "escaped":
            out.append(show(body))
        elif kind == "code":
            out.append(_CODE.format(show(body)) if html else body)
        elif kind in ("strong", "star"):
            out.append(f"<b>{inline(body, html)}</b>" if html else inline(body, html))
        elif kind == "emph":
            out.append(f"<i>{inline(body, html)}</i>" if html else inline(body, html))
        else:
            label = re.sub(r"\\(.)", r"\1", body)
            out.append(f'<a href="{_xml(m["url"])}">{_xml(label)}</a>' if html else label)
    return "".join([*out, show(line[at:])])


def to_fragment(djot: str) -> str:
    """A body element: bold paragraphs for headings, lists for runs of items, paragraphs for other lines."""
    out, in_list = [_BODY], False
    for line in djot.split("\n"):
        item = _ITEM.match(line)
        if in_list and not item:
            out.append("</ul>")
        if item and not in_list:
            out.append("<ul>")
        in_list = bool(item)
        if item:
            out.append(f"<li>{inline(line[item.end() :], True)}</li>")
        elif head := _HEADING.match(line):
            out.append(_HEADING_TAG.format(inline(line[head.end() :], True)))
        elif line.strip():
            out.append(f"<p>{inline(line, True)}</p>")
    return "".join([*out, "</ul>" * in_list, "</body>"])


def to_plain(djot: str) -> str:
    """The visible text, line by line; items keep a bullet, links their label."""
    out = []
    for line in djot.split("\n"):
        mark = _HEADING.match(line) or _ITEM.match(line)
        text = inline(line[mark.end() :] if mark else line, False) if line.strip() else ""
        out.append(_BULLET + text if mark and not _HEADING.match(line) else text)
    return "\n".join(out)


def xhtml(djot: Column) -> Column:
    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _XML + to_fragment(t))

    return convert(djot)


def plain_text(djot: Column) -> Column:
    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else to_plain(t))

    return convert(djot)


def converted(df: DataFrame, djot: str = "djot") -> DataFrame:
    return df.withColumns({"xhtml": xhtml(F.col(djot)), "plain": plain_text(F.col(djot))})
