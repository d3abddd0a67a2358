"""Pages as XHTML, and a book of them as an EPUB file with fixed bytes."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator
from html import escape
from itertools import groupby
from typing import BinaryIO

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions.canon import escape_xml


def xhtml(rows: DataFrame, page: list[str], lang: str) -> DataFrame:
    """(page, body): the page's blocks in order as headings, quotes and paragraphs, escaped; illustrations and null texts are left out."""
    tag = F.when(F.col("type") == "heading", "h2").when(F.col("type").isin("quote", "pull_quote"), "blockquote").otherwise("p")
    line = F.concat(F.lit("<"), tag, F.lit(">"), escape_xml(F.col("text")), F.lit("</"), tag, F.lit(">"))
    t = rows.where("text is not null and type is distinct from 'illustration'").select(*page, lang, "reading_order", "item", line.alias("line"))
    g = t.groupBy(*page).agg(F.min(lang).alias("lang"), F.array_sort(F.collect_list(F.struct("reading_order", "item", "line"))).alias("x"))
    opening = F.concat(F.lit('<body lang="'), escape_xml(F.coalesce("lang", F.lit("und"))), F.lit('">'))
    return g.select(*page, F.concat(opening, F.array_join(F.transform("x", lambda e: e["line"]), ""), F.lit("</body>")).alias("body"))


#: The markup of the container and of the package.
HEAD = '<?xml version="1.0" encoding="utf-8"?>\n'
CONTAINER = '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
XHTML = "http://www.w3.org/1999/xhtml"


class Epub:
    """An EPUB written member by member in fixed order, times and rights, so equal input gives equal bytes.

    Pages go to ``out`` as they come; only their names and languages are held until :meth:`close`, which adds the navigation document, the
    provenance as JSON and the package.
    """

    def __init__(self, out: BinaryIO, title: str, modified: str = "1980-01-01T00:00:00Z"):
        self.title, self.modified, self.pages, self.languages = title, modified, [], {}
        self.zip = zipfile.ZipFile(out, "w")
        self._write("mimetype", "application/epub+zip")
        self._write("META-INF/container.xml", HEAD + CONTAINER)

    def _write(self, name: str, text: str) -> None:
        info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
        info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
        self.zip.writestr(info, text.encode())

    def page(self, name: str, body: str, lang: str | None = None) -> None:
        """A chapter; ``body`` is markup, escaped already."""
        lang = lang or "und"
        self.languages.setdefault(lang)
        self.pages.append(name)
        self._write(f"{name}.xhtml", f'{HEAD}<html xmlns="{XHTML}" xml:lang="{escape(lang)}" lang="{escape(lang)}"><head><title>{escape(self.title)}</title></head>{body}</html>')

    def close(self, provenance: str = "{}") -> None:
        """``provenance``: canonical JSON of where the content is from."""
        t = escape(self.title)
        links = "".join(f'<li><a href="{n}.xhtml">{n}</a></li>' for n in self.pages)
        self._write("nav.xhtml", f'{HEAD}<html xmlns="{XHTML}" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{t}</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')
        self._write("provenance.json", provenance)
        items = "".join(f'<item id="c{i}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for i, n in enumerate(self.pages))
        items += '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="provenance" href="provenance.json" media-type="application/json"/>'
        spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(self.pages)))
        known = [x for x in self.languages if x != "und"] or ["und"]
        meta = f'<dc:identifier id="id">{t}</dc:identifier><dc:title>{t}</dc:title>' + "".join(f"<dc:language>{escape(x)}</dc:language>" for x in known) + f'<meta property="dcterms:modified">{self.modified}</meta>'
        self._write("book.opf", f'{HEAD}<package version="3.0" unique-identifier="id" xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata><manifest>{items}</manifest><spine>{spine}</spine></package>')
        self.zip.close()


def epub_bytes(title: str, pages: list[tuple[str, str]], provenance: str = "{}") -> bytes:
    """An EPUB of (name, body) pages."""
    out = io.BytesIO()
    e = Epub(out, title)
    for name, body in pages:
        e.page(name, body)
    e.close(provenance)
    return out.getvalue()


def books(pages: DataFrame, book: str, page: str, folder: str, lang: str | None = None) -> DataFrame:
    """(book, pages, path): one EPUB per book under ``folder``, a path or address that all executors reach.

    A book streams through one task page by page; only its compressed pages are held. It goes to a file beside its place that is moved
    there when whole, so a lost task leaves no half book. The provenance lists the pages with a hash of their bodies.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        files.create_dir(root, recursive=True)
        rows = ((r[0], r[1], r[2], r[3]) for b in batches for r in zip(b[book], b[page], b["body"], b[lang] if lang else [None] * len(b)))
        for name, group in groupby(rows, key=lambda r: r[0]):
            path, told, out = f"{root}/{name}.epub", [], io.BytesIO()
            e = Epub(out, str(name))
            for _, n, body, code in group:
                e.page(f"page-{n}", body, code)
                told.append((f"page-{n}", hashlib.sha256(body.encode()).hexdigest()))
            e.close(json.dumps({"book": str(name), "pages": [{"name": n, "sha256": h} for n, h in told]}, sort_keys=True, separators=(",", ":")))
            part = f"{path}.{TaskContext.get().taskAttemptId()}.part"
            with files.open_output_stream(part) as f:
                f.write(out.getbuffer())
            files.move(part, path)
            yield pd.DataFrame([(str(name), len(told), path)], columns=["book", "pages", "path"])

    columns = [book, page, "body"] + ([lang] if lang else [])
    return pages.select(*columns).repartition(book).sortWithinPartitions(book, page).mapInPandas(run, "book string, pages int, path string")
