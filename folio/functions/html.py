"""HTML pages to Markdown, titles, keywords and links.

What regular expressions can tell safely is a Column; the document tree is walked with the standard
library's parser in an Arrow UDF, a page at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements and classes that hold no answers.
NOISE_TAGS = frozenset("script style noscript iframe object embed svg canvas form input button select textarea nav".split())
NOISE_CLASSES = frozenset("toc toolbar stats".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div section article header footer main aside ul ol li blockquote details summary figure figcaption address dl dt dd body html table".split())
MAX_COLSPAN, MAX_ROWSPAN = 50, 200


def _first(html: Column, tag: str) -> Column:
    inner = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(inner, r"(?s)<[^>]*>", " "), r"\s+", " ")), F.lit(""))


def title(html: Column, path: Column) -> Column:
    """The title element, else the first h1, else the file's stem."""
    return F.coalesce(_first(html, "title"), _first(html, "h1"), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))


def keywords(html: Column) -> Column:
    content = F.regexp_extract(html, r"""(?is)<meta[^>]*name\s*=\s*["']?keywords["']?[^>]*content\s*=\s*["']([^"']*)["']""", 1)
    return F.array_remove(F.transform(F.split(content, "[,，;；]"), lambda x: F.trim(x)), "")


def canonical(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"""(?is)<link[^>]*rel\s*=\s*["']?canonical["']?[^>]*href\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def hrefs(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*href\s*=\s*["']([^"']*)["']"""), F.lit(1)), lambda x: F.trim(x))


def internal_links(html: Column) -> Column:
    """Stems of relative links to HTML files, in order, each once."""
    local = F.filter(hrefs(html), lambda x: ~x.rlike(r"^(#|//|[A-Za-z][A-Za-z0-9+.\-]*:)"))
    paths = F.filter(F.transform(local, lambda x: F.regexp_replace(x, r"[?#].*$", "")), lambda x: F.lower(x).rlike(r"[^/]\.html?$"))
    return F.array_distinct(F.transform(paths, lambda x: F.url_decode(F.regexp_replace(F.regexp_replace(x, r"^.*/", ""), r"\.[^.]*$", ""))))


def strip_noise(html: Column) -> Column:
    """Text of the page: scripts, styles, navigation, comments and tags go, white space is squeezed."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "nav"):
        out = F.regexp_replace(out, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " "))


def decode(content: bytes) -> str:
    """UTF-8 with or without mark, else the charset that the page names, else GB18030, else UTF-8 with replacements."""
    head = content[:4096].lower()
    at = head.find(b"charset", max(0, head.find(b"<meta")))  # the name stands between the sign and the next mark
    named = re.split(rb"[\s\"'>/;]", head[at + 7 :].lstrip(b" \t\r\n=\"'"), maxsplit=1)[0].decode("ascii", "ignore") if at >= 0 and b"<meta" in head else ""
    named = named or "gb18030"
    for encoding in ("utf-8-sig", "gb18030" if named in ("gbk", "gb2312") else named, "gb18030"):
        try:
            return content.decode(encoding)
        except (LookupError, UnicodeDecodeError):
            continue
    return content.decode("utf-8", "replace")


# Attributes that may name an image's source, in their order, the mark of a language in a class, and what stands before a fold's label.
IMAGE_SOURCES = ("src", "data-src", "data-original")
CODE_LANGUAGE = re.compile(r"(?:^|\s)lang(?:uage)?-(\S+)")
FOLD_LABEL = r"^展开\s*[:：]\s*"



class _Node:
    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self, raw: bool = False) -> str:
        return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" and raw else c.text(raw) for c in self.children)

    def find(self, tags: tuple[str, ...], within: tuple[str, ...] = ()) -> list[_Node]:
        """Elements of these tags below, not looking inside elements of ``within``."""
        out = []
        for c in self.children:
            if isinstance(c, _Node):
                if c.tag in tags:
                    out.append(c)
                if c.tag not in within:
                    out += c.find(tags, within)
        return out


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("root", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs) -> None:
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.open[-1].children.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def _span(node: _Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "1").strip()
    return max(1, min(int(value), most)) if value.isdigit() else 1


def _cell(node: _Node) -> str:
    """One line; a line break after or before a hyphen or underscore joins what it parts."""
    text = re.sub(r"(?<=[-_])\s*\x00\s*|\s*\x00\s*(?=[-_])", "", "".join(_marked(node)))
    return re.sub(r"\s+", " ", text.replace("\x00", " ")).strip().replace("|", r"\|")


def _marked(node: _Node) -> Iterator[str]:
    for c in node.children:
        if isinstance(c, str):
            yield c
        elif c.tag == "br":
            yield "\x00"
        else:
            yield from _marked(c)


def table_grid(table: _Node) -> list[list[str]]:
    """Cells by row and column; a cell that spans several stands in each of them."""
    grid: dict[tuple[int, int], str] = {}
    rows = table.find(("tr",), within=("table", "tr"))
    for r, row in enumerate(rows):
        c = 0
        for cell in (x for x in row.children if isinstance(x, _Node) and x.tag in ("td", "th")):
            while (r, c) in grid:
                c += 1
            text, down, across = _cell(cell), _span(cell, "rowspan", MAX_ROWSPAN), _span(cell, "colspan", MAX_COLSPAN)
            grid.update({(i, j): text for i in range(r, min(r + down, len(rows))) for j in range(c, c + across)})
            c += across
    width = max((c for _, c in grid), default=-1) + 1
    return [[grid.get((r, c), "") for c in range(width)] for r in range(len(rows))]


def _line(node: _Node) -> str:
    return " ".join(node.text().split())


def pipe_table(grid: list[list[str]]) -> Iterator[str]:
    """Lines of a pipe table, the first row as its head."""
    for n, cells in enumerate(grid):
        yield f"| {' | '.join(cells)} |"
        if n == 0:
            yield f"| {' | '.join('---' for _ in cells)} |"


def _paragraph(*lines: str) -> str:
    return "\n".join(("", "", *lines, "", ""))


def _table(table: _Node) -> str:
    grid = table_grid(table)
    if not any(grid):
        return ""
    titles = filter(None, map(_line, table.find(("caption",), within=("table",))))
    title = " ".join(titles)
    return _paragraph(*([f"**{title}**", ""] if title else []), *pipe_table(grid))


def _language(node: _Node) -> str:
    """What the first class with a language mark names, on code inside first."""
    marks = " ".join(n.attrs.get("class", "") for n in (*node.find(("code",)), node))
    found = CODE_LANGUAGE.search(marks)
    return found.group(1) if found else ""


def _fence(node: _Node) -> str:
    """A fence longer than any run of its marks inside."""
    code = node.text(raw=True).translate({0xA0: " "}).strip("\n")
    inside = max(map(len, re.findall("`+", code)), default=0)
    fence = "`" * max(3, inside + 1)
    return _paragraph(fence + _language(node), code, fence) if code.strip() else ""


def _image(node: _Node) -> str:
    """The first attribute that names a source decides; an image that is only there as data is its alternative text."""
    named = (node.attrs.get(name, "") for name in IMAGE_SOURCES)
    listed = re.match(r"\s*([^\s,]*)", node.attrs.get("srcset", "")).group(1)
    source = next(filter(None, named), listed).strip()
    alt = node.attrs.get("alt", "")
    return f"![{alt}]({source})" if source and not source.lower().startswith("data:") else alt


def _render(node: _Node, depth: int = 0) -> str:
    out, after = [], []
    for c in node.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
            continue
        classes = set(c.attrs.get("class", "").split())
        if c.tag in NOISE_TAGS or classes & NOISE_CLASSES or c.attrs.get("id") == "toc" or c.tag in ("head", "title"):
            continue
        if c.tag == "pre" or "code-pre" in classes:
            (after if re.fullmatch(r"h[1-6]|p|summary|a|strong|b|em|i|span|code", node.tag) else out).append(_fence(c))
        elif c.tag == "table":
            out.append(_table(c))
        elif c.tag == "img":
            out.append(_image(c))
        elif c.tag == "br":
            out.append("\n")
        elif re.fullmatch(r"h[1-6]", c.tag):
            inner = _render(c, depth)
            first, _, rest = inner.strip().partition("\n")
            out.append(f"\n\n{'#' * int(c.tag[1])} {first.strip()}\n\n{rest}")
        elif c.tag == "summary":
            label = re.sub(FOLD_LABEL, "", _line(c))
            out.append(f"\n\n**{label}**\n\n" if label else "")
        elif c.tag == "li":
            out.append("\n" + "  " * max(0, depth - 1) + "- " + _render(c, depth).strip())
        elif c.tag in ("ul", "ol"):
            out.append("\n" + _render(c, depth + 1) + "\n")
        elif c.tag in ("strong", "b", "em", "i"):
            inner, mark = _render(c, depth).strip(), "**" if c.tag in ("strong", "b") else "*"
            out.append(f"{mark}{inner}{mark}" if inner else "")
        elif c.tag == "a" and c.attrs.get("href"):
            inner = _render(c, depth).strip()
            out.append(f"[{inner}]({c.attrs['href'].strip()})" if inner else "")
        elif c.tag == "code":
            out.append(f"`{c.text()}`" if c.text().strip() else "")
        else:
            inner = _render(c, depth)
            out.append(f"\n\n{inner.strip()}\n\n" if c.tag in BLOCKS else inner)
    return "".join(out + after)


def to_markdown(html: str | None) -> str:
    tree = _Tree()
    tree.feed((html or "").replace("\r\n", "\n").replace("\r", "\n"))
    tree.close()
    body = tree.root.find(("body",))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", _render(body[0] if body else tree.root))).strip()


@F.pandas_udf(StringType())
def html_to_markdown(pages: pd.Series) -> pd.Series:
    return pages.map(to_markdown)


@F.pandas_udf(StringType())
def decode_html(content: pd.Series) -> pd.Series:
    return content.map(lambda b: decode(bytes(b or b"")))
