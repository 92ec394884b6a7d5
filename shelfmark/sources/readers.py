"""Document readers that run inside tasks, one file per call.

PDF and EPUB readers need their content only; each import is local so that a
worker without the optional package fails on that file alone.
"""

from __future__ import annotations

import io
import re
import subprocess
import tempfile
import zipfile
from html.parser import HTMLParser
from pathlib import Path
from xml.etree import ElementTree

from shelfmark.schemas import LOCAL_PAGE_BATCH, NATIVE_CHARS_PER_PAGE, SAMPLE_PAGES


def pdf_probe(content: bytes) -> dict:
    """Text density over up to five evenly spaced pages."""
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as doc:
        total = len(doc)
        picks = range(total) if total <= SAMPLE_PAGES else [int(i * (total / SAMPLE_PAGES)) for i in range(SAMPLE_PAGES)]
        sizes = [len(doc[i].get_text("text").strip()) for i in picks]
    average = sum(sizes) / len(sizes) if sizes else 0.0
    return {"avg_chars_per_page": round(average, 1), "sampled_pages": len(sizes), "total_pages": total,
            "classification": "native" if average >= NATIVE_CHARS_PER_PAGE else "scanned"}


def pdf_page_count(content: bytes) -> int:
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as doc:
        return len(doc)


def pdf_pages(content: bytes, first: int, stop: int) -> bytes:
    """Pages ``[first, stop)`` as a PDF of their own."""
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as doc, pymupdf.open() as part:
        part.insert_pdf(doc, from_page=first, to_page=stop - 1)
        return part.tobytes()


def pdf_markdown(content: bytes) -> tuple[str, int]:
    """Markdown of a text PDF in page batches, and its page count."""
    import pymupdf
    import pymupdf4llm

    with pymupdf.open(stream=content, filetype="pdf") as doc:
        total = len(doc)
        parts = [pymupdf4llm.to_markdown(doc, pages=list(range(at, min(at + LOCAL_PAGE_BATCH, total))),
                                         show_progress=False, use_ocr=False)
                 for at in range(0, total, LOCAL_PAGE_BATCH)]
    return "\n\n".join(parts), total


class _Markdown(HTMLParser):
    """Headings, paragraphs and line breaks of an XHTML chapter."""

    BLOCKS = {"p", "div", "li", "blockquote", "section", "h1", "h2", "h3", "h4", "h5", "h6"}
    SKIP = {"head", "script", "style"}

    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.skipping = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipping += 1
        elif tag in self.BLOCKS:
            self.parts.append("\n\n" + ("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else ""))
        elif tag == "br":
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skipping -= 1
        elif tag in self.BLOCKS:
            self.parts.append("\n\n")

    def handle_data(self, data):
        if not self.skipping:
            self.parts.append(re.sub(r"\s+", " ", data))


def epub_markdown(content: bytes) -> str:
    """Chapters of an EPUB in reading order, from the archive itself."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        package = container.find(".//{*}rootfile").attrib["full-path"]
        root = ElementTree.fromstring(book.read(package))
        base = str(Path(package).parent)
        files = {i.attrib["id"]: i.attrib["href"] for i in root.iterfind(".//{*}manifest/{*}item")}
        texts = []
        for ref in root.iterfind(".//{*}spine/{*}itemref"):
            href = files[ref.attrib["idref"]]
            parser = _Markdown()
            parser.feed(book.read(href if base == "." else f"{base}/{href}").decode("utf-8"))
            texts.append(re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", "".join(parser.parts))).strip())
    return "\n\n".join(t for t in texts if t) + "\n"


def epub_pandoc(content: bytes) -> str:
    """EPUB through pandoc, where the program is installed."""
    with tempfile.NamedTemporaryFile(suffix=".epub") as file:
        file.write(content)
        file.flush()
        done = subprocess.run(["pandoc", "-f", "epub", "-t", "markdown", "--wrap=none", file.name],
                              capture_output=True, text=True, timeout=300)
    if done.returncode != 0:
        raise RuntimeError(f"Pandoc error: {done.stderr.strip()}")
    return done.stdout


def markdown_epub(markdown: str, about: dict) -> bytes:
    """EPUB with metadata through pandoc."""
    flags: list[str] = []
    for key, value in about.items():
        for item in value if isinstance(value, list) else [value]:
            if item:
                flags += ["--metadata", f"{'subject' if key == 'subjects' else key}={item}"]
    with tempfile.TemporaryDirectory() as folder:
        source, target = Path(folder, "clean.md"), Path(folder, "book.epub")
        source.write_text(markdown, encoding="utf-8")
        subprocess.run(["pandoc", str(source), "-o", str(target), "--wrap=none", *flags],
                       check=True, capture_output=True, timeout=120)
        return target.read_bytes()
