"""Files as tables: texts of documents, and listing pages as a data source.

A file that can't be read is a row with its error, never a failed job.  Defined
results: an unknown kind, a broken archive and a document without text are
errors; an empty folder gives no rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .listing import table_rows

# Media types of documents.
KINDS = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.oasis.opendocument.text": "odt",
    "application/msword": "doc_legacy",
}
SUFFIXES = {"pdf": "pdf", "docx": "docx", "odt": "odt", "doc": "doc_legacy"}
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MOST_BYTES = 64 << 20  # of an unpacked part of an archive
PAGES = "array<struct<page_number:int,text:string>>"


def document_kind(media_type: Column, url: Column) -> Column:
    """Kind of a document by its media type, else by its address."""
    kind = F.lower(F.trim(F.split(F.coalesce(media_type, F.lit("")), ";")[0]))
    suffix = F.regexp_extract(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*", 0)), r"\.([a-z]+)$", 1)
    by = lambda value, table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[value]
    return F.coalesce(by(kind, KINDS), by(suffix, SUFFIXES), F.lit("unsupported"))


def _part(raw: bytes, name: str) -> ElementTree.Element:
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        if archive.getinfo(name).file_size > MOST_BYTES:
            raise ValueError(f"{name} is larger than {MOST_BYTES} bytes")
        return ElementTree.fromstring(archive.read(name))


def _docx(raw: bytes) -> str:
    """Paragraphs of the body, then the cells of its tables."""
    body = _part(raw, "word/document.xml").find(f"{WORD}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{WORD}t"))
    outside = [text(p) for p in body.findall(f"{WORD}p")]
    cells = [" ".join(text(p) for p in cell.iter(f"{WORD}p")) for table in body.findall(f"{WORD}tbl") for cell in table.iter(f"{WORD}tc")]
    return "\n".join([*outside, *cells])


def _odt(raw: bytes) -> str:
    return " ".join(t for t in _part(raw, "content.xml").itertext() if t)


def _pdf(raw: bytes, most: int) -> list[tuple[int, str]]:
    """Pages with text, by their numbers; needs pypdf."""
    from pypdf import PdfReader

    pages = enumerate(PdfReader(io.BytesIO(raw)).pages[:most], 1)
    return [(k, page.extract_text() or "") for k, page in pages]


def document_pages(raw: bytes | None, kind: str | None, most: int = 40) -> list[tuple[int, str]]:
    """(page number, text) of a document's pages that have text.

    A file without pages has one; page numbers are those of the file.
    """
    if raw is None:
        raise ValueError("no content")
    if kind == "pdf":
        pages = _pdf(raw, most)
    elif kind in ("docx", "odt"):
        pages = [(1, _docx(raw) if kind == "docx" else _odt(raw))]
    else:
        raise ValueError(f"documents of kind {kind} are not read")
    pages = [(k, " ".join(text.split())) for k, text in pages]
    pages = [(k, text) for k, text in pages if text]
    if not pages:
        raise ValueError("the document has no text")
    return pages


def document_texts(files: DataFrame, key: str, content: str, kind: str, most_pages: int = 40) -> DataFrame:
    """``key, kind, status`` (success or error), ``error, pages, text`` and the
    SHA-256 of the bytes for each file."""

    def run(batches):
        schema = pa.schema([("key", pa.string()), ("kind", pa.string()), ("status", pa.string()), ("error", pa.string()), ("pages", pa.list_(pa.struct([("page_number", pa.int32()), ("text", pa.string())]))), ("sha256", pa.string())])
        for batch in batches:
            for name, raw, of, digest in zip(*(batch.column(k) for k in range(4)), strict=True):
                row = {"key": name.as_py(), "kind": of.as_py(), "sha256": digest.as_py(), "status": "success", "error": None, "pages": []}
                try:
                    row["pages"] = [{"page_number": k, "text": t} for k, t in document_pages(raw.as_py(), row["kind"], most_pages)]
                except Exception as error:  # a bad file is a row
                    row |= {"status": "error", "error": f"{type(error).__name__}: {error}"[:240]}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    rows = files.select(F.col(key).cast("string"), F.col(content), F.col(kind), F.sha2(F.col(content), 256))
    found = rows.mapInArrow(run, f"key string, kind string, status string, error string, pages {PAGES}, sha256 string")
    text = F.array_join(F.transform("pages", lambda p: p["text"]), "\n")
    return found.select(F.col("key").alias(key), "kind", "status", "error", "pages", text.alias("text"), "sha256")


def read_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Texts of the documents in a folder, by their paths; Spark's scan leaves
    out files of no bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return document_texts(files.withColumn("kind", document_kind(F.lit(None).cast("string"), F.col("path"))), "path", "content", "kind")


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(None)
        self.files = files


class _ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.base = options["path"], options.get("base", "")
        self.each = int(options.get("files_per_task", "64"))

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}")
        found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.is_file and f.path.lower().endswith((".html", ".htm")))
        return [_Files(found[k : k + self.each]) for k in range(0, len(found), self.each)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        fs, _ = pafs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}")
        for file in partition.files if partition else []:
            try:
                with fs.open_input_stream(file) as stream:
                    html = stream.read().decode("utf-8", "replace")
                rows = [(file, k, r["published"], r["title"], r["url"], "success", None) for k, r in enumerate(table_rows(html, self.base))]
            except Exception as error:  # a bad file is a row
                rows = [(file, None, None, None, None, "error", f"{type(error).__name__}: {error}"[:240])]
            yield from rows


class ListingSource(DataSource):
    """``spark.read.format("listing").option("base", url).load(folder)``: a row for
    each announcement on the listing pages of a folder."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "file string, place int, published string, title string, url string, status string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options)
