"""Conversion of files to Markdown, by format, with pluggable providers."""

from __future__ import annotations

import csv
import io
import json
import shutil
import subprocess
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from recollect import config
from recollect.functions.text import suffix
from recollect.session import Cut


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists, links, emphasis, code, quotes and tables; scripts, styles and navigation are left out."""

    SKIP = {"script", "style", "nav", "noscript", "template", "svg", "head"}
    BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "aside", "ul", "ol", "table", "blockquote", "pre", "figure", "form"}
    MARK = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip, self.pre, self.lists, self.links = 0, 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        if self.skip:
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "li":
            n = self.lists[-1] if self.lists else None
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + ("- " if n is None else f"{n}. "))
            if n is not None:
                self.lists[-1] += 1
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag == "tr":
            self.out.append("\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "img":
            a = dict(attrs)
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag in self.MARK and not self.pre:
            self.out.append(self.MARK[tag])
        if tag in self.BLOCK:
            self.out.append("\n\n")
        if tag in ("ul", "ol"):
            self.lists.append(1 if tag == "ol" else None)
        if tag == "pre":
            self.pre += 1
            self.out.append("```\n")
        if tag == "blockquote":
            self.out.append("> ")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag == "a":
            self.out.append(f"]({self.links.pop()})" if self.links else "]")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag in self.MARK and not self.pre:
            self.out.append(self.MARK[tag])
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag in self.BLOCK or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else " ".join(data.split()).join((" " if data[:1].isspace() else "", " " if data[-1:].isspace() else "")) if data.strip() else " ")

    def text(self) -> str:
        lines = [x.rstrip() if x.strip() else "" for x in "".join(self.out).replace("\r", "").split("\n")]
        out: list[str] = []
        for x in lines:
            if x or (out and out[-1]):
                out.append(x if x.startswith(("  ", "```")) else x.strip())
        return "\n".join(out).strip()


def html_markdown(html: str | None) -> str:
    if not html:
        return ""
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    return parser.text()


def _page(html: str | None) -> str | None:
    return None if html is None else html_markdown(html)


#: Without Arrow rows go to Python a hundred at a time, not 10,000, so a worker's memory stays small whatever the table. To Spark it is not deterministic, so
#: that what tests its result does not call it again.
html_to_markdown = F.udf(_page, StringType(), useArrow=False).asNondeterministic()


def markdown_pages(pages: DataFrame, html: str = "html", out: str = "markdown", row_bytes: int = 16_384) -> DataFrame:
    """``pages`` with their Markdown as ``out`` in place of ``html``; that of a null page is ''.

    A hundred rows can be long ones, so each page is followed by an empty row for every ``row_bytes`` of it, dropped again
    afterwards: rows that go to Python together hold a hundred times that and one page at most.
    """
    rest = [c for c in pages.columns if c != html]
    page = F.coalesce(html, F.lit(""))
    empty = F.array_repeat(F.lit(None).cast("string"), F.floor(F.octet_length(page) / row_bytes).cast("int"))
    rows = pages.select(*rest, F.explode(F.concat(F.array(page), empty)).alias(html))
    return rows.select(*rest, html_to_markdown(html).alias(out)).where(F.col(out).isNotNull())


def _table(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [[str(c).replace("\n", " ").replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
    return "\n".join(["| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * width, *rows[1:]]])


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _styles(z: zipfile.ZipFile) -> dict[str, int]:
    """Heading level of each paragraph style: its own outline level or the one of the style that it is based on."""
    if "word/styles.xml" not in z.namelist():
        return {}
    own, base = {}, {}
    for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
        key, outline, parent = s.get(f"{_W}styleId"), s.find(f"{_W}pPr/{_W}outlineLvl"), s.find(f"{_W}basedOn")
        name = (s.find(f"{_W}name").get(f"{_W}val") or "").lower() if s.find(f"{_W}name") is not None else ""
        if outline is not None:
            own[key] = int(outline.get(f"{_W}val")) + 1
        elif name.startswith("heading ") and name[8:].isdigit():
            own[key] = int(name[8:])
        elif name == "title":
            own[key] = 1
        if parent is not None:
            base[key] = parent.get(f"{_W}val")
    out = {}
    for key in {*own, *base}:
        at, seen = key, set()
        while at not in own and at in base and at not in seen:
            seen.add(at)
            at = base[at]
        if at in own and own[at] <= 9:
            out[key] = min(own[at], 6)
    return out


def _numbered(z: zipfile.ZipFile) -> dict[tuple[str, str], bool]:
    """Whether a list's level is numbered, by the list's id and level; others have bullets."""
    if "word/numbering.xml" not in z.namelist():
        return {}
    root = ElementTree.fromstring(z.read("word/numbering.xml"))
    kinds = {}
    for a in root.iter(f"{_W}abstractNum"):
        for level in a.iter(f"{_W}lvl"):
            form = level.find(f"{_W}numFmt")
            kinds[a.get(f"{_W}abstractNumId"), level.get(f"{_W}ilvl")] = form is not None and form.get(f"{_W}val") not in ("bullet", "none")
    out = {}
    for n in root.iter(f"{_W}num"):
        ref = n.find(f"{_W}abstractNumId")
        for (abstract, level), kind in kinds.items():
            if ref is not None and ref.get(f"{_W}val") == abstract:
                out[n.get(f"{_W}numId"), level] = kind
    return out


def _paragraph(p) -> str:
    """Text of a paragraph; deleted runs are left out, tabs and breaks are spaces and line ends."""
    marks = {f"{_W}tab": " ", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join((t.text or "") if t.tag == f"{_W}t" else marks.get(t.tag, "") for t in p.iter()).strip()


def word_markdown(data: bytes) -> str:
    """A text document's headings, lists, tables and paragraphs as Markdown, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body, styles, numbered = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body"), _styles(z), _numbered(z)
    out: list[str] = []
    counts: dict[tuple[str, str], int] = {}
    listed = False

    def block(el) -> None:
        nonlocal listed
        if el.tag == f"{_W}tbl":
            rows = [[" ".join(filter(None, map(_paragraph, c.iter(f"{_W}p")))) for c in r.findall(f"{_W}tc")] for r in el.findall(f"{_W}tr")]
            out.append(_table([r for r in rows if r]))
            listed = False
        elif el.tag == f"{_W}p":
            text = _paragraph(el)
            style, number = el.find(f"{_W}pPr/{_W}pStyle"), el.find(f"{_W}pPr/{_W}numPr")
            outline = el.find(f"{_W}pPr/{_W}outlineLvl")
            level = int(outline.get(f"{_W}val")) + 1 if outline is not None else styles.get(style.get(f"{_W}val")) if style is not None else None
            if not text:
                return
            if level and level <= 9:
                out.append("#" * min(level, 6) + " " + text.replace("\n", " "))
                listed = False
            elif number is not None and number.find(f"{_W}numId") is not None:
                depth = number.find(f"{_W}ilvl")
                key = number.find(f"{_W}numId").get(f"{_W}val"), depth.get(f"{_W}val") if depth is not None else "0"
                counts[key] = counts.get(key, 0) + 1
                for other in [k for k in counts if k[0] == key[0] and int(k[1]) > int(key[1])]:
                    del counts[other]  # a deeper level begins anew
                line = "  " * int(key[1]) + (f"{counts[key]}. " if numbered.get(key) else "- ") + text.replace("\n", " ")
                if listed:
                    out[-1] += "\n" + line
                else:
                    out.append(line)
                listed = True
            else:
                out.append(text)
                listed = False
        elif el.tag in (f"{_W}sdt", f"{_W}sdtContent"):
            for inner in el:
                block(inner)

    for el in body if body is not None else []:
        block(el)
    return "\n\n".join(x for x in out if x)


_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def slides_markdown(data: bytes) -> str:
    """Slides in order of number: titles as headings, paragraphs by depth as list items, tables as tables."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")]
        for name in sorted(names, key=lambda n: int("".join(c for c in n if c.isdigit()) or 0)):
            root = ElementTree.fromstring(z.read(name))
            for shape in root.iter():
                if shape.tag == f"{_P}sp":
                    kind = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                    title = kind is not None and kind.get("type") in ("title", "ctrTitle")
                    lines = []
                    for p in shape.iter(f"{_A}p"):
                        text = "".join(t.text or "" for t in p.iter(f"{_A}t")).strip()
                        props = p.find(f"{_A}pPr")
                        depth = int(props.get("lvl") or 0) if props is not None else 0
                        if text:
                            lines.append(text if title else "  " * depth + "- " + text)
                    if lines:
                        out.append("## " + " ".join(lines) if title else "\n".join(lines))
                elif shape.tag == f"{_A}tbl":
                    out.append(_table([["".join(t.text or "" for t in c.iter(f"{_A}t")) for c in r.findall(f"{_A}tc")] for r in shape.findall(f"{_A}tr")]))
    return "\n\n".join(out)


def _sheet(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter() if t.tag.endswith("}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        out = []
        for name in sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet")):
            rows = []
            for row in (e for e in ElementTree.fromstring(z.read(name)).iter() if e.tag.endswith("}row")):
                cells = []
                for c in row:
                    v = "".join(t.text or "" for t in c.iter() if t.tag.endswith(("}v", "}t")))
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                rows.append(cells)
            out.append(_table(rows))
    return "\n\n".join(x for x in out if x)


def builtin_convert(ext: str, data: bytes) -> str:
    """Markdown of the formats that need no library; '' for others."""
    decode = lambda: data.decode("utf-8", "replace")
    if ext in (".md", ".txt", ".rst", ".log", ".xml", ".yaml", ".yml"):
        return decode().strip()
    if ext in (".html", ".htm"):
        return html_markdown(decode())
    if ext in (".csv", ".tsv"):
        return _table(list(csv.reader(io.StringIO(decode()), delimiter="\t" if ext == ".tsv" else ",")))
    if ext == ".json":
        return "```json\n" + json.dumps(json.loads(decode()), indent=2, ensure_ascii=False) + "\n```"
    if ext == ".docx":
        return word_markdown(data)
    if ext == ".pptx":
        return slides_markdown(data)
    if ext == ".xlsx":
        return _sheet(data)
    return ""


def tesseract(data: bytes, lang: str = config.OCR_LANG, command: str = "tesseract", timeout: int = 240) -> str:
    """Text of an image by an external program that reads standard input; '' if it fails."""
    try:
        done = subprocess.run([command, "stdin", "stdout", "-l", lang], input=data, capture_output=True, timeout=timeout)
        return done.stdout.decode("utf-8", "replace").strip() if done.returncode == 0 else ""
    except (OSError, subprocess.SubprocessError):
        return ""


@dataclass
class Providers:
    """What conversion can call; what is None is not available. All take file contents and return text but ``pages``, which
    returns the images of a document's first pages. A file of providers is made on the driver, to see what there is, and once a task."""

    convert: Callable[[str, bytes], str] = builtin_convert
    ocr_image: Callable[[bytes], str] | None = None
    pages: Callable[[bytes, int], list[bytes]] | None = None
    caption: Callable[[bytes], str] | None = None
    transcribe: Callable[[bytes], str] | None = None


def installed() -> Providers:
    """The providers of programs that are there: ``tesseract``, where it is installed."""
    return Providers(ocr_image=tesseract if shutil.which("tesseract") else None)


KEYS = ["project", "rel_path", "size", "modified", "hash"]
_KEYS = "project string, rel_path string, size long, modified timestamp, hash string"


def _stage(rows: DataFrame, providers: Callable[[], Providers], call: Callable, name: str, place: int) -> DataFrame:
    """One kind of work over the files that need it: their text, where ``call(providers, suffix, content)`` finds any.

    ``rows`` have the keys, ``page``, ``ext`` and ``content``; a file whose call fails has no text of this kind.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = providers()
        for pdf in batches:
            texts = []
            for ext, content in zip(pdf["ext"], pdf["content"]):
                try:
                    texts.append((call(p, ext, bytes(content) if content is not None else b"") or "").strip())
                except Exception:  # one file's failure must not end the job
                    texts.append("")
            out = pdf[[*KEYS, "page"]].assign(place=place, method=name, text=texts)
            yield out[out["text"] != ""]

    return rows.select(*KEYS, "page", "ext", "content").mapInPandas(run, f"{_KEYS}, page int, place int, method string, text string")


def _page_images(rows: DataFrame, providers: Callable[[], Providers], most: int) -> DataFrame:
    """A row for each page's image in place of a document's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = providers()
        for pdf in batches:
            for i in range(len(pdf)):
                one = pdf.iloc[[i]]
                try:
                    images = list(p.pages(bytes(one["content"].iloc[0]), most))[:most]
                except Exception:
                    images = []
                if images:
                    yield pd.concat([one.assign(page=n, content=[image]) for n, image in enumerate(images, 1)])

    return rows.select(*KEYS, "page", "ext", "content").mapInPandas(run, f"{_KEYS}, page int, ext string, content binary")


def convert_files(files: DataFrame, providers: Callable[[], Providers] = installed, ocr: str = config.OCR_MODE, vision: str = config.VISION_MODE, pages: int = config.OCR_PAGES) -> DataFrame:
    """``files(project, rel_path, size, modified, hash, content)`` with ``method, chars, body`` in place of the content.

    Files are routed by format: each kind of work is a stage of its own over those that need it, so that a slow kind
    holds up no other. Pages of scanned documents are rows, dealt over all tasks. What was found comes together by file and
    place; a file without any text has none.
    """
    have = providers()
    ext = suffix(F.col("rel_path"))
    rows = files.select(*KEYS, F.lit(0).alias("page"), ext.alias("ext"), "content")
    sound, image = F.col("ext").isin(config.AUDIO_EXTS), F.col("ext").isin(config.IMAGE_EXTS)
    read = Cut(_stage(rows.where(~sound), providers, lambda p, e, c: p.convert(e, c), "text", 0), "read")
    found = read.df
    if have.ocr_image and ocr != "off":
        found = found.unionByName(_stage(rows.where(image), providers, lambda p, e, c: p.ocr_image(c), "recognised", 1))
        if have.pages:
            scans = rows.where("ext = '.pdf'")
            if ocr == "auto":  # those that have hardly a text of their own
                texts = read.df.where(F.length("text") >= config.OCR_LEAST_CHARS).select("rel_path")
                scans = scans.join(texts, "rel_path", "left_anti").select(*rows.columns)
            images = _page_images(scans, providers, pages).repartition("rel_path", "page")
            found = found.unionByName(_stage(images, providers, lambda p, e, c: p.ocr_image(c), "recognised", 1))
    if have.caption and vision in ("auto", "force"):
        found = found.unionByName(_stage(rows.where(image), providers, lambda p, e, c: p.caption(c), "described", 2))
    if have.transcribe:
        found = found.unionByName(_stage(rows.where(sound), providers, lambda p, e, c: p.transcribe(c), "heard", 1))
    title = F.create_map(*[F.lit(x) for kv in (("recognised", "## Recognised text\n\n"), ("described", "## Picture\n\n"), ("heard", "## Recording\n\n")) for x in kv])
    head = F.when(F.col("page") <= 1, F.coalesce(F.try_element_at(title, F.col("method")), F.lit("")))
    page = F.when(F.col("page") > 0, F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" -->\n")))
    shown = found.withColumn("text", F.concat(F.coalesce(head, F.lit("")), F.coalesce(page, F.lit("")), F.col("text")))
    parts = shown.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("place", "page", "method", "text"))).alias("parts"))
    bodies = parts.select("rel_path", F.array_join("parts.text", "\n\n").alias("body"), F.array_join(F.array_distinct("parts.method"), "+").alias("method"))
    out = files.select(*KEYS).join(bodies, "rel_path", "left")
    body = F.coalesce("body", F.lit(""))
    return out.select(*KEYS, F.coalesce("method", F.lit("none")).alias("method"), F.length(body).cast("long").alias("chars"), body.alias("body"))
