"""Books in markup: HTML pages, EPUB and FB2, read from binary files into pieces and blocks.

A file is one row of Spark's binaryFile source and is parsed inside its task by the standard library, so a
collection of books is as parallel as it has files. Note links lose their own text only; inline markup keeps
document order; text inside nested text elements is given once.
"""

from __future__ import annotations

import base64
import binascii
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# What elements mean.
HTML_TEXT = ("p", "h1", "h2", "h3", "h4", "blockquote")
HTML_SKIPPED = ("table", "figure", "figcaption", "sup", "script", "style")
FB2_SKIPPED = ("table", "annotation", "image", "text-author")
FB2_CONTAINERS = ("cite", "epigraph", "poem", "stanza")
FB2_TEXT = ("p", "subtitle", "v")
#: Elements whose start ends an open paragraph, by the HTML standard.
ENDS_P = ("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Pieces(HTMLParser):
    """Text elements in order, with the ids seen since the last one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[tuple[str, list[str], bool]] = []
        self._skip = 0
        self._open: list[str] = []
        self._parts: list[str] = []
        self._ids: list[str] = []

    def _flush(self) -> None:
        text = " ".join(" ".join(self._parts).split())
        if text and self._open:
            self.pieces.append((text, self._ids, self._open[-1].startswith("h")))
            self._ids = []
        self._parts = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if not self._skip and tag in ENDS_P and self._open and self._open[-1] == "p":
            self.handle_endtag("p")
        if self._skip or tag in HTML_SKIPPED:
            self._skip += tag not in VOID
            return
        if tag in HTML_TEXT:
            self._flush()
            self._open.append(tag)
        name = dict(attrs).get("id")
        if name:
            self._ids = [*self._ids, name]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if not self._skip and (name := dict(attrs).get("id")):
            self._ids = [*self._ids, name]

    def handle_endtag(self, tag: str) -> None:
        if self._skip:
            self._skip -= tag not in VOID
        elif tag in HTML_TEXT and tag in self._open:
            self._flush()
            while self._open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self._skip and self._open:
            self._parts.append(data)


def html_pieces(html: str | None) -> list[tuple[str, list[str], bool]]:
    """(text, anchors, is_heading) of the text elements of a page; damaged markup gives what can be read."""
    parser = _Pieces()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return parser.pieces


def page_pieces(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A row for each piece of each page: seq from 0, text, anchors and is_heading."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *p) for k, h in zip(batch["k"], batch["h"]) for i, p in enumerate(html_pieces(h))]
            yield pd.DataFrame(rows, columns=[key, "seq", "text", "anchors", "is_heading"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, f"{key} {kind}, seq int, text string, anchors array<string>, is_heading boolean")


def _local(tag: object) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _text(element: ElementTree.Element) -> str:
    parts: list[str] = []

    def walk(node: ElementTree.Element) -> None:
        parts.append(node.text or "")
        for child in node:
            if not (_local(child.tag) == "a" and child.get("type") == "note"):
                walk(child)
            parts.append(child.tail or "")

    walk(element)
    return " ".join("".join(parts).split())


def _tolerant(content: bytes) -> ElementTree.Element | None:
    """The root of XML; a cut-off file gives what was complete, anything else None."""
    parser = ElementTree.XMLPullParser(["start"])
    root = None
    try:
        parser.feed(content)
        for _, element in parser.read_events():
            root = element if root is None else root
        parser.close()
    except ElementTree.ParseError:
        for _, element in parser.read_events():
            root = element if root is None else root
    return root


def parse_fb2(content: bytes, stem: str, language: str | None = None) -> dict:
    """title, author, language, cover and chapters [(title, [(kind, text)])]; ValueError for other files."""
    root = _tolerant(content)
    if root is None or _local(root.tag) != "FictionBook":
        raise ValueError(f"this file does not look like FB2: {stem}")
    found = {"title": "", "author": None, "language": "ru", "cover": None}
    for info in (i for d in root if _local(d.tag) == "description" for i in d if _local(i.tag) == "title-info"):
        for node in info:
            kind = _local(node.tag)
            if kind == "book-title":
                found["title"] = _text(node)
            elif kind == "author" and found["author"] is None:
                names = {_local(p.tag): _text(p) for p in node}
                found["author"] = " ".join(n for k in ("first-name", "middle-name", "last-name") if (n := names.get(k))) or None
            elif kind == "lang":
                found["language"] = (_text(node) or "ru").lower()[:2]
    page = next((e for e in root.iter() if _local(e.tag) == "coverpage"), None)
    links = [v for i in (page if page is not None else ()) if _local(i.tag) == "image" for k, v in i.attrib.items() if k.endswith("href")]
    if links and links[-1].startswith("#"):
        body = next((e.text or "" for e in root.iter() if _local(e.tag) == "binary" and e.get("id") == links[-1][1:]), None)
        try:
            found["cover"] = base64.b64decode(body) if body is not None else None
        except (ValueError, binascii.Error):
            found["cover"] = None
    lang = language or found["language"]
    found["language"] = lang if lang in ("ru", "en") else "ru"
    chapters: list[tuple[str, list[tuple[str, str]]]] = []

    def own(element: ElementTree.Element) -> Iterator[str]:
        for child in element:
            kind = _local(child.tag)
            if kind in FB2_CONTAINERS:
                yield from own(child)
            elif kind in FB2_TEXT and (text := _text(child)):
                yield text

    def walk(section: ElementTree.Element) -> None:
        title = next((_text(c) for c in section if _local(c.tag) == "title"), "")
        blocks = ([("heading", title)] if title else []) + [("paragraph", t) for t in own(section)]
        if blocks:
            chapters.append((title or T.OPENING[found["language"]], blocks))
        for child in section:
            if _local(child.tag) == "section":
                walk(child)

    main = next((b for b in root if _local(b.tag) == "body" and b.get("name") is None), None)
    for section in main if main is not None else ():
        if _local(section.tag) == "section":
            walk(section)
    return found | {"title": found["title"] or stem, "chapters": chapters}


def flatten_toc(points: list[tuple[str, str, list]]) -> list[tuple[str, str, str]]:
    """(title, document, anchor) of nested (title, href, children), parents first; untitled ones only lend
    their children."""
    flat: list[tuple[str, str, str]] = []
    for title, href, children in points:
        document, _, anchor = (href or "").partition("#")
        if (title or "").strip():
            flat.append((title.strip(), document, anchor))
        flat += flatten_toc(children)
    return flat


def parse_epub(content: bytes, stem: str, language: str | None = None) -> dict:
    """title, author, language, cover, toc and pieces (text, document, anchors, is_heading) in spine order."""
    try:
        box = zipfile.ZipFile(io.BytesIO(content))
        container = ElementTree.fromstring(box.read("META-INF/container.xml"))
        opf_name = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        opf = ElementTree.fromstring(box.read(opf_name))
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
        raise ValueError(f"this file does not look like EPUB: {stem}") from e
    base = posixpath.dirname(opf_name)
    path = lambda href: posixpath.normpath(posixpath.join(base, href))
    items = {e.get("id"): e for e in opf.iter() if _local(e.tag) == "item"}
    said: dict[str, list[str]] = {}
    for e in opf.iter():
        if _local(e.tag) in ("title", "creator", "language"):
            said.setdefault(_local(e.tag), []).append(e.text or "")
    read = lambda item: box.read(path(item.get("href"))) if item is not None and path(item.get("href")) in box.namelist() else None
    wanted = next((e.get("content") for e in opf.iter() if _local(e.tag) == "meta" and e.get("name") == "cover"), None)
    cover = items.get(wanted)
    if cover is None:
        cover = next((i for i in items.values() if "cover-image" in (i.get("properties") or "").split()), None)
    if cover is None:
        cover = next((i for i in items.values() if (i.get("media-type") or "").startswith("image/") and "cover" in i.get("href").lower()), None)
    spine = next((e for e in opf.iter() if _local(e.tag) == "spine"), None)
    toc: list[tuple[str, str, str]] = []
    ncx = read(items.get(spine.get("toc"))) if spine is not None else None
    if ncx:

        def points(node: ElementTree.Element) -> list:
            return [(next((t.text for l in p if _local(l.tag) == "navLabel" for t in l if _local(t.tag) == "text"), ""), next((c.get("src") for c in p if _local(c.tag) == "content"), ""), points(p)) for p in node if _local(p.tag) == "navPoint"]

        toc = flatten_toc([x for m in ElementTree.fromstring(ncx) if _local(m.tag) == "navMap" for x in points(m)])
    pieces = []
    listed = {d for _, d, _ in toc}
    for ref in spine if spine is not None else ():
        item = items.get(ref.get("idref"))
        raw = read(item)
        if raw is None:
            continue
        own = html_pieces(raw.decode("utf-8", "replace"))
        if item.get("href") not in listed and own and re.fullmatch(r"\d{1,4}", own[0][0].strip()):
            continue  # an endnote of its own
        pieces += [(t, item.get("href"), a, h) for t, a, h in own]
    lang = language or (said.get("language", [""])[0] or "ru").lower()[:2]
    return {"title": said.get("title", [""])[0] or stem, "author": said.get("creator", [""])[0] or None, "language": lang if lang in ("ru", "en") else "ru", "cover": read(cover), "toc": toc, "pieces": pieces}


def epub_chapters(book: dict) -> list[tuple[str, list[tuple[str, str]]]]:
    """Chapters of a parsed EPUB: cut where contents entries are found, the cursor moving forward only."""
    pieces, marks, at = book["pieces"], [], 0
    opening = T.OPENING[book["language"]]
    for title, document, anchor in book["toc"]:
        k = next((k for k in range(at, len(pieces)) if pieces[k][1] == document and (not anchor or anchor in pieces[k][2])), None)
        if k is not None:
            marks.append((k, title))
            at = k + 1
    texts = [p[0] for p in pieces]
    head = texts[: marks[0][0]] if marks else texts
    found = [(opening, [("paragraph", t) for t in head])] if head else []
    for (k, title), stop in zip(marks, [*(m for m, _ in marks[1:]), len(texts)]):
        found.append((title, [("heading", title), *(("paragraph", t) for t in texts[k:stop] if t.strip() != title.strip())]))
    return found


READERS: dict[str, Callable[[bytes, str], dict]] = {
    ".fb2": parse_fb2,
    ".epub": lambda content, stem: (book := parse_epub(content, stem)) | {"chapters": epub_chapters(book)},
}
BOOKS = "path string, title string, author string, language string, cover binary, problem string, chapters array<struct<title:string,blocks:array<struct<kind:string,text:string>>>>"


def read_books(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes, str], dict]] | None = None, unknown: str = "report") -> DataFrame:
    """A row for each file under path; what can't be read says why in `problem`.

    Files whose suffix has no reader are such rows, and are not opened; with unknown="raise" the result fails on them.
    """
    known = readers or READERS
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", "(\\.[^./]+)$", 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for where, content in zip(batch["path"], batch["content"]):
                stem, dot = posixpath.splitext(posixpath.basename(where))
                try:
                    b = known[dot.lower()](bytes(content), stem)
                    chapters = [{"title": t, "blocks": [{"kind": k, "text": x} for k, x in blocks]} for t, blocks in b["chapters"]]
                    rows.append((where, b["title"], b["author"], b["language"], b["cover"], None, chapters))
                except ValueError as e:
                    rows.append((where, stem, None, None, None, str(e), None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in BOOKS.split(", ")])

    problem = F.concat(F.lit("unknown format '"), suffix, F.lit(f"', known are: {', '.join(sorted(known))}"))
    others = files.where(~suffix.isin(*known)).select("path", F.regexp_extract("path", "([^/]*?)(\\.[^./]+)?$", 1).alias("title"), (F.raise_error(problem).cast("string") if unknown == "raise" else problem).alias("problem"))
    return files.where(suffix.isin(*known)).select("path", "content").mapInPandas(run, BOOKS).unionByName(others, allowMissingColumns=True)


def book_blocks(books: DataFrame) -> DataFrame:
    """doc_blocks of read_books(): one row a block, repaired; blocks that end up empty are gone."""
    chapters = books.select(F.col("path").alias("book_id"), "language", F.posexplode("chapters").alias("chapter_idx", "c"))
    rows = chapters.select("book_id", "language", "chapter_idx", T.clean_text(F.col("c.title")).alias("chapter_title"), F.posexplode("c.blocks").alias("block_idx", "b"))
    return rows.select("book_id", "language", "chapter_idx", "chapter_title", "block_idx", "b.kind", T.clean_text(F.col("b.text")).alias("text")).where(F.length("text") > 0)
