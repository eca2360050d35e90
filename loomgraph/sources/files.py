"""Reading files into parsed documents, and comparing a snapshot with the files table."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions by parser.
MARKDOWN, HTML = ("md", "markdown", "mdx"), ("html", "htm")
CODE = ("ts", "tsx", "js", "jsx", "py", "rb", "go", "rs", "java", "kt", "c", "h", "cpp", "hpp", "cs", "php", "swift", "sh", "sql", "css", "scss", "vue", "svelte", "json", "yaml", "toml")
TEXT = ("txt", "log", "csv", "tsv", "rst", "org")
#: Names that the watcher passes over.
IGNORED = ("node_modules", ".git", ".DS_Store", "Thumbs.db")
PARSED = "path string, title string, text string, mime string, metadata map<string,string>"


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.title, self._skip, self._in_title = [], "", 0, False

    def handle_starttag(self, tag, attrs):
        self._skip += tag in ("script", "style")
        self._in_title = self._in_title or tag == "title"

    def handle_endtag(self, tag):
        self._skip -= tag in ("script", "style") and self._skip > 0
        if tag == "title":
            self._in_title = False

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        elif not self._skip:
            self.parts.append(data)


def parse_html(text: str, name: str) -> tuple[str, str]:
    """(title, text) of a page: no scripts or styles, white space as single spaces."""
    p = _Text()
    p.feed(text)
    p.close()
    return p.title.strip() or name, re.sub(r"\s+", " ", " ".join(p.parts)).strip()


def parse_markdown(text: str, name: str) -> tuple[str, str, dict[str, str]]:
    """(title, text, metadata): front matter leaves the text; the title is its own, the first heading, or the name."""
    meta: dict[str, str] = {}
    m = re.match(r"---\r?\n(.*?)\r?\n---\r?\n?", text, re.S)
    if m:
        for line in m.group(1).splitlines():
            k, sep, v = line.partition(":")
            if sep and k.strip():
                meta[k.strip()] = v.strip().strip("\"'")
        text = text[m.end() :]
    h = re.search(r"^#\s+(.+)$", text, re.M)
    return meta.get("title") or (h.group(1).strip() if h else name), text, meta


def parse_docx(data: bytes) -> str:
    """Paragraphs of a word-processing file."""
    xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8")
    paragraphs = re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)
    plain = ["".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", p, re.S)) for p in paragraphs]
    import html

    return html.unescape("\n\n".join(plain))


def extension(name: str) -> str:
    base = name.rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[1].lower() if "." in base[1:] else ""


def is_supported(name: str) -> bool:
    return extension(name) in {"", "pdf", "docx", *MARKDOWN, *HTML, *CODE, *TEXT}


#: Media types by extension.
MIME = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "html": "text/html", "htm": "text/html", "md": "text/markdown", "markdown": "text/markdown", "mdx": "text/markdown"}


def mime_of(path: Column) -> Column:
    """The media type of a file by its extension; code has a type of its own, everything else is plain text."""
    ext = F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)
    known = F.create_map(*[F.lit(x) for kv in (MIME | {e: f"text/x-{e}" for e in CODE}).items() for x in kv])
    return F.coalesce(F.try_element_at(known, ext), F.lit("text/plain"))


def parse(path: str, data: bytes) -> tuple[str, str, str, dict[str, str]]:
    """(title, text, mime, metadata) of a file by its extension; unsupported ones raise ValueError."""
    name, ext = path.rsplit("/", 1)[-1], extension(path)
    if ext == "docx":
        return name, parse_docx(data), "application/vnd.openxmlformats-officedocument.wordprocessingml.document", {}
    if ext == "pdf":
        raise ValueError("PDF needs a parser of its own: pass extracted pages to join_pages")
    text = data.decode("utf-8", "replace")
    if ext in MARKDOWN:
        title, body, meta = parse_markdown(text, name)
        return title, body, "text/markdown", meta
    if ext in HTML:
        title, body = parse_html(text, name)
        return title, body, "text/html", {}
    if ext in CODE:
        return name, text, f"text/x-{ext}", {}
    if ext in TEXT or not ext:
        return name, text, "text/plain", {}
    raise ValueError(f"unsupported file type: {ext}")


def read_documents(spark: SparkSession, path: str, parsers: dict | None = None) -> DataFrame:
    """Parsed documents (path, title, text, mime, metadata, hash, error) of all files below ``path``.

    ``parsers`` maps further extensions to functions of bytes that return text.  A file that
    can't be parsed has its message in ``error`` and a null text.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    more = parsers or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    ext = extension(p)
                    rows.append((p, *((p.rsplit("/", 1)[-1], more[ext](c), f"application/{ext}", {}) if ext in more else parse(p, c)), None))
                except Exception as e:  # one file's failure stays its own
                    rows.append((p, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "title", "text", "mime", "metadata", "error"])

    hashes = raw.select("path", F.sha2("content", 256).alias("hash"))
    return raw.mapInPandas(run, PARSED + ", error string").join(hashes, "path")


def join_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, pages array<struct<page, p_start, p_end>>) of rows (keys, page, text): pages joined by a blank line."""
    g = pages.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("ps"))
    lengths = F.transform("ps", lambda p: F.length(p["text"]))
    start = lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda s, x: s + x + 2)
    spans = F.transform("ps", lambda p, i: F.struct(p["page"].alias("page"), start(i).alias("p_start"), (start(i) + F.length(p["text"])).alias("p_end")))
    return g.select(*keys, F.array_join(F.transform("ps", lambda p: p["text"]), "\n\n").alias("text"), spans.alias("pages"))


def file_changes(snapshot: DataFrame, known: DataFrame) -> DataFrame:
    """(universe_id, abs_path, action) of a snapshot against the known files: new, changed, unchanged or removed.

    Unchanged means an equal hash of a file whose status is indexed.
    """
    s = snapshot.select("universe_id", "abs_path", F.col("hash").alias("h1"), F.lit(True).alias("here"))
    k = known.select("universe_id", "abs_path", F.col("hash").alias("h2"), "status", F.lit(True).alias("there"))
    same = F.coalesce((F.col("h1") == F.col("h2")) & (F.col("status") == "indexed"), F.lit(False))
    action = F.when(F.col("here").isNull(), "removed").when(F.col("there").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return s.join(k, ["universe_id", "abs_path"], "full").select("universe_id", "abs_path", action.alias("action"))
