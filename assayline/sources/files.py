"""Files: type by magic bytes, archives, the pages that a file of any kind gives."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayline.operators import layout

MAX_ENTRIES = 500
MAX_TOTAL = 200 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024
# Brands of a HEIF file.
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1")


def sniff(content: Column) -> Column:
    """The kind of a file by its first bytes; text if the first 512 are printable or tab, line feed or return."""

    def starts(at: int, hexed: str) -> Column:
        return F.hex(F.substring(content, at + 1, len(hexed) // 2)) == hexed

    head = F.hex(F.substring(content, 1, 512))
    brand = F.decode(F.substring(content, 9, 4), "ISO-8859-1")
    printable = head.rlike("^(?:09|0A|0D|[2-689A-F][0-9A-F]|7[0-9A-E])+$")
    return (
        F.when(starts(0, "25504446"), "pdf").when(starts(0, "504B0304"), "zip").when(starts(0, "FFD8FF"), "jpeg").when(starts(0, "89504E470D0A1A0A"), "png")
        .when(starts(4, "66747970") & brand.isin(*HEIF_BRANDS), "heic").when(printable, "text").otherwise("unknown")
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content and kind of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "content", sniff(F.col("content")).alias("kind"))


def _natural(name: str) -> list:
    return [(0, int(x), "") if x.isdigit() else (1, 0, x.lower()) for x in re.findall(r"\d+|\D+", name)]


def _listed(archive: zipfile.ZipFile, most_bytes: int) -> list[zipfile.ZipInfo]:
    """Files that count, in natural order; of several with one name the last."""
    own = {i.filename: i for i in archive.infolist() if not i.is_dir() and not re.search(r"(^|/)(__MACOSX|\.DS_Store)", i.filename) and i.file_size < most_bytes}
    return sorted(own.values(), key=lambda i: _natural(i.filename))


def _problem(archive: zipfile.ZipFile, most_files: int, most_bytes: int) -> str | None:
    """Why an archive is not read: by what its files really hold, not by what it declares. A chunk is held at a time."""
    infos, total = _listed(archive, most_bytes), 0
    if len(infos) > most_files:
        return "too_many_files"
    for info in infos:
        with archive.open(info) as file:
            while chunk := file.read(1 << 20):
                total += len(chunk)
                if total > most_bytes:
                    return "too_large"
    return None


def expand_archives(files: DataFrame, most_files: int = MAX_ENTRIES, most_bytes: int = MAX_TOTAL) -> DataFrame:
    """path, entry, name, content, kind, error of every file of every archive (path, content): in natural order of names,
    without folders and system files, each by its own first bytes; an archive that is damaged, or holds too many or too
    large files, gives one row with an error. An archive, and files of BATCH_BYTES or one larger file, are in memory."""
    columns = ["path", "entry", "name", "content", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                        error = _problem(archive, most_files, most_bytes)
                        for n, info in enumerate(() if error else _listed(archive, most_bytes)):
                            rows.append((path, n, info.filename, archive.read(info), None))
                            size += info.file_size
                            if size >= BATCH_BYTES:
                                yield pd.DataFrame(rows, columns=columns)
                                rows, size = [], 0
                except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError):  # damaged, encrypted or unknown
                    error = "unreadable"
                if error:
                    rows.append((path, -1, None, None, error))
            yield pd.DataFrame(rows, columns=columns)
            rows, size = [], 0

    found = files.select("path", "content").mapInPandas(run, "path string, entry int, name string, content binary, error string")
    return found.select("path", "entry", "name", "content", F.when(F.col("error").isNull(), sniff(F.col("content"))).alias("kind"), "error")


IMAGES = ("jpeg", "png", "heic")
#: Members of an archive that are data about pages.
NO_PAGE = r"(?i)\.(json|xml|html?)$"


def route_files(files: DataFrame, pdf_pages: DataFrame, ocr_pages: DataFrame) -> DataFrame:
    """path, page, entry, method, text and error: the pages of every file (path, content, kind), numbered through, or one
    row with the error that keeps it from being read.

    A text is one page; a PDF has the pages of its text layer, or, where that layer is as good as empty, those that were
    recognised; a photo is the page that was recognised. An archive gives its text files, else its PDFs, else its photos.
    ``pdf_pages`` and ``ocr_pages`` (path, entry, page, text; entry -1 where the file is no archive's) hold what decoding
    and recognition have made of the files: a file that is not in ``ocr_pages`` can't be recognised.

    Errors: unsupported, no_pages (an archive without a readable file), scanned, photo, and those of expand_archives. One
    unreadable PDF makes its archive unreadable. Defined cases: a file without content is unsupported; a PDF without
    pages counts as scanned.
    """
    alone = files.where("kind is null or kind <> 'zip'").select("path", F.lit(-1).alias("entry"), F.col("path").alias("name"), "content", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.lit(None).cast("string").alias("error"))
    every = alone.unionByName(expand_archives(files.where("kind = 'zip'")))
    packed = F.col("entry") >= 0
    sort = F.when((F.col("kind") == "text") & ~(packed & F.col("name").rlike(NO_PAGE)), 0).when(F.col("kind") == "pdf", 1).when(F.col("kind").isin(*IMAGES), 2)
    text = F.when(sort == 0, F.make_valid_utf8(F.col("content").cast("string")))
    # an archive without files has no other row
    mark = files.where("kind = 'zip'").select("path", F.lit(-2).alias("entry"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("sort"), F.lit(None).cast("string").alias("text"))
    members = every.select("path", "entry", "error", sort.alias("sort"), text.alias("text")).unionByName(mark)
    layer = pdf_pages.groupBy("path", "entry").agg(F.count("*").alias("n_pdf"), F.sum(layout.readable_chars(F.col("text"))).alias("chars"))
    seen = ocr_pages.groupBy("path", "entry").agg(F.count("*").alias("n_ocr"))
    sized = members.join(layer, ["path", "entry"], "left").join(seen, ["path", "entry"], "left")
    # from here on one sort by path decides what each file gives; texts move once
    whole = Window.partitionBy("path")
    known = sized.withColumns({"best": F.min("sort").over(whole), "problem": F.max("error").over(whole), "packed": F.max(F.col("entry") == -2).over(whole)})
    chosen = F.coalesce(F.col("sort") == F.col("best"), F.lit(False))
    scan = chosen & (F.col("sort") == 1) & F.coalesce(layout.looks_scanned(F.col("chars"), F.col("n_pdf")), F.lit(True))
    by_ocr = scan | (chosen & (F.col("sort") == 2))
    failed = F.when(by_ocr & F.col("n_ocr").isNull(), F.when(scan, "scanned").otherwise("photo"))
    pages = F.when(~chosen, 0).when(F.col("sort") == 0, 1).when(by_ocr, F.coalesce("n_ocr", F.lit(0))).otherwise(F.col("n_pdf"))
    told = known.withColumns({"chosen": chosen, "by_ocr": by_ocr, "failed": failed, "pages": pages})
    unread = F.when(F.col("best").isNull(), F.when(F.col("packed"), "no_pages").otherwise("unsupported"))
    in_order = whole.orderBy("entry")
    told = told.withColumns({
        "problem": F.coalesce("problem", unread, F.min("failed").over(whole)), "method": F.when(F.max("by_ocr").over(whole), "ocr").otherwise("text"),
        "before": F.sum("pages").over(in_order) - F.col("pages"), "number": F.row_number().over(in_order),
    })
    fine = F.col("problem").isNull()
    kept = told.where((fine & F.col("chosen")) | (~fine & (F.col("number") == 1)))
    source = F.when(fine & (F.col("sort") > 0), F.when(F.col("by_ocr"), 2).otherwise(1))
    decoded = pdf_pages.select("path", "entry", "page", F.col("text").alias("read"), F.lit(1).alias("source")).unionByName(ocr_pages.select("path", "entry", "page", F.col("text").alias("read"), F.lit(2).alias("source")))
    joined = kept.withColumn("source", source).join(decoded, ["path", "entry", "source"], "left")
    shown = lambda c: F.when(fine, c)
    return joined.select(
        "path", shown(F.col("before") + F.coalesce("page", F.lit(1))).cast("int").alias("page"), shown(F.col("entry")).alias("entry"), shown(F.col("method")).alias("method"),
        shown(F.when(F.col("source").isNull(), F.col("text")).otherwise(F.col("read"))).alias("text"), F.col("problem").alias("error"),
    )
