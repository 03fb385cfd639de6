"""Files as documents: listing, exclusion, classification and text.

Everything that can be decided from the path or the size is decided on the
listing, where Spark has not opened any file; only the content of files that
are going to be scanned is read.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions.arrays import let
from veilscan.functions.scalars import file_name, lacks_text_layer
from veilscan.functions.storage import materialize
from veilscan.sources.mail import MAIL_STORES, MESSAGE_FILES
from veilscan.sources.office import office_text

PROBE_BYTES = 8192

# --- fixed values: directories that are not descended into -------------------
BUILTIN_SKIP_DIRS = (
    "AppData", "$Recycle.Bin", "System Volume Information", "node_modules", ".Trash", ".cache",
)
# --- fixed values: file types by extension -----------------------------------
OFFICE = {".docx": "docx", ".xlsx": "xlsx", ".xlsm": "xlsx", ".pptx": "pptx"}
IMAGES = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp")
UNREADABLE_DOCS = (
    ".doc", ".dot", ".xls", ".xlsb", ".xlt", ".ppt", ".pps", ".odt", ".ods", ".odp", ".msg", ".pages",
    ".numbers", ".key", ".wpd", ".wps", ".one", ".mdb", ".accdb",
)
TEXT = (
    ".txt", ".text", ".csv", ".tsv", ".log", ".md", ".markdown", ".json", ".xml", ".yaml", ".yml", ".html",
    ".htm", ".ini", ".cfg", ".conf", ".toml", ".sql", ".rtf", ".eml", ".vcf", ".ics", ".env", ".properties",
)
BINARY = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp", ".heic", ".ico", ".svgz", ".mp3", ".mp4",
    ".mov", ".avi", ".mkv", ".wav", ".flac", ".zip", ".gz", ".tar", ".bz2", ".xz", ".7z", ".rar", ".dmg",
    ".iso", ".exe", ".dll", ".so", ".dylib", ".bin", ".dat", ".db", ".sqlite", ".class", ".pyc", ".o", ".a",
    ".woff", ".woff2", ".ttf", ".otf",
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"\.[^.]*$", 0))


def local_path(path: Column) -> Column:
    """A path without the ``file:`` scheme."""
    return F.regexp_replace(path, "^file:(?://)?(?=/)", "")


def _outermost(roots: Sequence[str]) -> list[str]:
    """Roots that are inside no other root: nothing is listed twice."""
    clean = list(dict.fromkeys(r.rstrip("/") or "/" for r in roots))
    return [r for r in clean if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in clean)]


#: Entries of a folder in one batch.
LISTED_TOGETHER = 10_000
_ENTRIES = "path string, kind string, modificationTime timestamp, length bigint, error string"
LISTING = "path string, modificationTime timestamp, length bigint, error string"


def _entry(path: str, kind: str, seconds: float = 0.0, length: int = 0, error: str | None = None) -> tuple:
    return path, kind, datetime.fromtimestamp(seconds, timezone.utc), length, error


def _local_entries(path: str) -> Iterator[tuple]:
    """What a folder of the local file system holds; links are not followed,
    and an entry that cannot be looked at is an error of its own."""
    try:
        with os.scandir(path) as found:
            for entry in found:
                name = entry.path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                try:
                    about = entry.stat(follow_symlinks=False)
                    if stat.S_ISDIR(about.st_mode):
                        yield _entry(name, "dir")
                    elif stat.S_ISREG(about.st_mode):
                        yield _entry(name, "file", about.st_mtime, about.st_size)
                except OSError as problem:
                    yield _entry(name, "error", error=str(problem))
    except OSError as problem:
        yield _entry(path, "error", error=str(problem))


def _stored_entries(path: str) -> Iterator[tuple]:
    """The same for a folder of another file system."""
    try:
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        for info in fs.get_file_info(pyarrow.fs.FileSelector(inner)):
            name = f"{path.rstrip('/')}/{info.base_name}"
            if info.type == pyarrow.fs.FileType.Directory:
                yield _entry(name, "dir")
            elif info.type == pyarrow.fs.FileType.File:
                yield _entry(name, "file", info.mtime.timestamp() if info.mtime else 0.0, info.size)
    except (OSError, ValueError) as problem:
        yield _entry(path, "error", error=str(problem))


def _root_entry(path: str) -> tuple:
    """A root may be a file or a folder, or a link to one; it must be there."""
    if "://" not in path:
        about = os.stat(path)
        return _entry(path, "dir") if stat.S_ISDIR(about.st_mode) else _entry(path, "file", about.st_mtime, about.st_size)
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    info = fs.get_file_info(inner)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pyarrow.fs.FileType.Directory:
        return _entry(path, "dir")
    return _entry(path, "file", info.mtime.timestamp() if info.mtime else 0.0, info.size)


def _opened(list_entries):
    """What folders hold, a chunk of entries at a time: a task never has all
    files of a folder in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "kind", "modificationTime", "length", "error"]
        for batch in batches:
            for path in batch["path"]:
                entries = iter(list_entries(path))
                while chunk := list(islice(entries, LISTED_TOGETHER)):
                    yield pd.DataFrame(chunk, columns=names)

    return run


def _entries(path: str) -> Iterator[tuple]:
    return _stored_entries(path) if "://" in path else _local_entries(path)


def list_tree(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """All files below ``roots`` at any depth and whatever their names: path,
    modificationTime, length, error. A root may be one file; one that is missing
    fails. Links below a root are not followed. What cannot be listed is a row
    with an error.

    Folders are rows that tasks open, one level of the tree after the other, so
    no list of them is ever on the driver; only the roots come from there.
    """
    start = spark.createDataFrame([(local_root(r),) for r in _outermost(roots)], "path string")
    found = materialize(start.mapInPandas(_opened(lambda path: [_root_entry(path)]), _ENTRIES))
    levels = [found]
    while not (folders := levels[-1].where("kind = 'dir'").select("path")).isEmpty():
        levels.append(materialize(folders.repartition("path").mapInPandas(_opened(_entries), _ENTRIES)))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.where("kind <> 'dir'").select("path", "modificationTime", "length", "error")


def local_root(root: str) -> str:
    return re.sub("^file:(?://)?(?=/)", "", root)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents by path, one file at a time."""
    for batch in batches:
        at = batch.schema.get_field_index("path"), batch.schema.get_field_index("error")
        for row in range(len(batch)):
            one = batch.slice(row, 1)
            path, error, content = one.column(at[0])[0].as_py(), one.column(at[1])[0].as_py(), None
            if error is None:
                try:
                    content = _content(path)
                except (OSError, ValueError) as problem:
                    error = str(problem)
            columns = list(one.columns)
            columns[at[1]] = pa.array([error], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([content], pa.binary())], [*one.schema.names, "content"])


def _content(path: str) -> bytes:
    if "://" in path:
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_input_stream(inner) as stream:
            return stream.read()
    with open(path, "rb") as stream:
        return stream.read()


def with_content(files: DataFrame) -> DataFrame:
    """Listed files with their ``content``; one that cannot be read, or has
    vanished since, has an ``error`` instead. Filter the listing first: every
    row that is left is opened."""
    return files.mapInArrow(_contents, T.StructType([*files.schema, T.StructField("content", T.BinaryType())]))


def read_files(spark: SparkSession, roots: Sequence[str], where: Column | str | None = None) -> DataFrame:
    """All files below ``roots`` with their contents; with ``where``, a
    condition on path, modificationTime and length, only those that meet it.

    A filter above the result would come too late: it cannot pass the reading,
    so files that it drops would be opened first. Listings that failed stay.
    """
    listed = list_tree(spark, roots)
    if where is not None:
        condition = F.expr(where) if isinstance(where, str) else where
        listed = listed.where(F.col("error").isNotNull() | condition)
    return with_content(listed)


def clean_excludes(patterns: Sequence[str]) -> list[str]:
    """Blank patterns would exclude everything: they are dropped."""
    return [p.lower() for p in patterns if p.strip()]


def _glob_to_java(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1:end].replace("[", r"\[").replace("&&", r"&\&")
            out.append(f"[{body}]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def _glob_hit(name: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | name.rlike(_glob_to_java(p))
    return hit


def _substring_hit(path: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | path.contains(p)
    return hit


def _dirs_below(parent: Column, root: str) -> Column:
    """Names of the directories between ``root`` and a file."""
    rest = F.substring(parent, len(root.rstrip("/")) + 2, 1 << 30)
    return F.filter(F.split(rest, "/"), lambda d: d != "")


def exclude_paths(
    files: DataFrame,
    patterns: Sequence[str],
    roots: Sequence[str],
    *,
    scan_all: bool = False,
    mail: bool = False,
) -> DataFrame:
    """Drop pruned subtrees, mark excluded files in ``excluded``.

    A pattern is a glob on a name or a substring of a path, case-insensitive.
    One that matches a directory prunes what is below it, uncounted; one that
    matches only the file leaves it in, as skipped.  ``.git`` and (unless
    ``scan_all`` or ``mail``) the built-in list prune as well.  A root that is
    itself a file is never excluded.
    """
    wanted = clean_excludes(patterns)
    path = F.col("path")
    parent = F.regexp_extract(path, "(?s)^(.*)/[^/]*\\z", 1)
    lower_parent, lower_name = F.lower(parent), F.lower(file_name(path))
    kept = F.lit(False)
    file_root = F.lit(False)
    for root in dict.fromkeys(r.rstrip("/") or "/" for r in roots):
        inside = path.startswith(root.rstrip("/") + "/")
        below = _dirs_below(parent, root)
        root_name = root.rsplit("/", 1)[-1]
        pruned = F.array_contains(below, ".git") | F.lit(root_name == ".git")
        if wanted:
            pruned = (
                pruned
                | _substring_hit(lower_parent, wanted)
                | _glob_hit(F.lit(root_name.lower()), wanted)
                | F.exists(below, lambda d: _glob_hit(F.lower(d), wanted))
            )
        if not scan_all and not mail:
            skip = F.array(*[F.lit(d.lower()) for d in BUILTIN_SKIP_DIRS])
            pruned = pruned | F.arrays_overlap(F.transform(below, F.lower), skip)
        kept = kept | (path == root) | (inside & ~pruned)
        file_root = file_root | (path == root)
    hit = (_glob_hit(lower_name, wanted) | _substring_hit(F.lower(path), wanted)) if wanted else F.lit(False)
    return files.where(kept).withColumn("excluded", ~file_root & hit)


def skip_builtin_dirs(files: DataFrame, roots: Sequence[str], scan_all: bool = False) -> DataFrame:
    """Only the built-in directory list."""
    return exclude_paths(files, (), roots, scan_all=scan_all).drop("excluded")


def too_large(length: Column, max_mb: int) -> Column:
    return length > max_mb * 1024 * 1024


def limit_size(files: DataFrame, max_mb: int = 50) -> DataFrame:
    """Files up to ``max_mb``; the filter reaches the file source, so larger
    ones are never opened."""
    return files.where(F.col("length") <= max_mb * 1024 * 1024)


_KINDS = {
    **dict.fromkeys(TEXT, "text"),
    **dict.fromkeys(BINARY, "binary"),
    **dict.fromkeys(UNREADABLE_DOCS, "unreadable_doc"),
    **dict.fromkeys(IMAGES, "image"),
    ".pdf": "pdf",
    **OFFICE,
    **dict.fromkeys(MAIL_STORES + MESSAGE_FILES, "mail_store"),
}


def classify_file(path: Column) -> Column:
    """What a file is, by name: ``docx``/``xlsx``/``pptx``, ``pdf``, ``image``,
    ``unreadable_doc``, ``binary``, ``mail_store``, ``text``, or ``sniff``
    (look inside)."""
    kinds = F.create_map(*[F.lit(part) for pair in _KINDS.items() for part in pair])
    return F.coalesce(F.try_element_at(kinds, extension(path)), F.lit("sniff"))


def _probe(content: Column) -> Column:
    return F.substring(content, 1, PROBE_BYTES)


def utf16_order(content: Column) -> Column:
    """``LE`` / ``BE`` for UTF-16 text, else null: a byte order mark decides,
    or NUL bytes in nearly all of one half of the byte pairs."""
    view = F.decode(_probe(content), "ISO-8859-1")

    def build(v: Column) -> Column:
        pairs = F.floor(F.length(v) / 2)
        even = F.substring(v, F.lit(1), (pairs * 2).cast("int"))
        # drop every second byte, then count the NULs that are left
        first = F.regexp_replace(even, r"(?s)(.).", "$1")
        second = F.regexp_replace(even, r"(?s).(.)", "$1")
        nul_even = pairs - F.length(F.translate(first, "\x00", ""))
        nul_odd = pairs - F.length(F.translate(second, "\x00", ""))
        return (
            F.when(v.startswith("ÿþ"), "LE")
            .when(v.startswith("þÿ"), "BE")
            .when(pairs < 8, F.lit(None).cast("string"))
            .when((nul_odd * 10 >= pairs * 8) & (nul_even * 20 <= pairs), "LE")
            .when((nul_even * 10 >= pairs * 8) & (nul_odd * 20 <= pairs), "BE")
        )

    return let(view, build)


def looks_like_text(view: Column) -> Column:
    """No NUL and less than 5% control bytes among the first 8 KB, given as a
    string of which every character counts."""

    def build(v: Column) -> Column:
        control = F.length(F.regexp_replace(v, r"[^\x01-\x08\x0B\x0E-\x1F]", ""))
        return (F.length(v) == 0) | (
            ~v.contains("\x00") & (F.floor(control * 100 / F.greatest(F.length(v), F.lit(1))) < 5)
        )

    return let(view, build)


def decode_text(content: Column, decoded16: Column, order: Column) -> Column:
    """Bytes to scan: UTF-16 in its decoded form, everything else unchanged."""
    return F.when(order.isNotNull(), F.encode(decoded16, "UTF-8")).otherwise(content)


def extract_text(
    files: DataFrame, *, ocr_text: DataFrame | None = None, keep: Sequence[str] = (), ocr: bool = False
) -> DataFrame:
    """Add ``status``, ``text`` (bytes), ``ocr`` and ``error`` to files with
    ``path, length, content, kind, excluded, oversize`` and, if there is one, an
    ``error`` of reading.

    ``ocr_text`` (``path, text, ocr``) supplies the text of PDFs and images that
    was extracted elsewhere; that of other kinds is not replaced. A PDF without
    text, or with a text layer too thin to be one, is ``needs_ocr``; so is an
    image without text when ``ocr`` was asked for, else it is skipped.
    """
    kind = F.col("kind")
    if "error" not in files.columns:
        files = files.withColumn("error", F.lit(None).cast("string"))
    columns = ["path", "length", *keep, "kind", "excluded", "oversize", "error"]
    pictured = kind.isin("pdf", "image")
    documents = _document_texts(files.where(~pictured), columns)
    # only PDFs and images meet the supplied text, and their contents do not
    out = documents.unionByName(_supplied_texts(files.where(pictured).select(columns), ocr_text))
    skipped = F.col("excluded") | F.col("oversize")
    image_gap = F.lit("needs_ocr" if ocr else "skipped")
    status = (
        F.when(F.col("excluded"), "skipped")
        .when(F.col("oversize"), "oversize")
        .when(F.col("error").isNotNull(), "error")
        .when(kind == "mail_store", "mail_store")
        .when(pictured & (F.col("text").isNull() | (~F.col("ocr") & lacks_text_layer(F.col("text").cast("string")))),
              F.when(kind == "pdf", "needs_ocr").otherwise(image_gap))
        .when(pictured, "scanned")
        .when(kind == "unreadable_doc", "unreadable_doc")
        .when((kind == "binary") | F.col("not_text"), "skipped")
        .otherwise("scanned")
    )
    return out.select("path", "length", *keep, status.alias("status"), "text", "ocr", F.when(~skipped, F.col("error")).alias("error"))


def _document_texts(files: DataFrame, columns: list[str]) -> DataFrame:
    """Text of all but PDFs and images. Office files and UTF-16 text pass
    Python; the others stay in the JVM."""
    content, kind = F.col("content"), F.col("kind")
    order = F.when(kind.isin("text", "sniff"), utf16_order(content))
    job = F.when(kind.isin("docx", "xlsx", "pptx"), kind).otherwise(F.concat(F.lit("utf16"), order))
    files = files.select(*columns, "content", job.alias("job"))
    shown = [*columns[:-1]]

    def finished(rows: DataFrame, text: Column, error: Column) -> DataFrame:
        sniffed = F.decode(_probe(text), "ISO-8859-1")
        return rows.select(
            *shown,
            F.coalesce(F.col("error"), error).alias("error"),
            text.alias("text"),
            F.lit(False).alias("ocr"),
            F.coalesce((kind == "sniff") & ~looks_like_text(sniffed), F.lit(False)).alias("not_text"),
        )

    in_python = files.where(F.col("job").isNotNull()).withColumn("extracted", office_text(F.col("job"), content))
    plain = F.when(kind.isin("text", "sniff"), content)
    return finished(in_python, F.col("extracted.text").cast("binary"), F.col("extracted.error")).unionByName(
        finished(files.where(F.col("job").isNull()), plain, F.lit(None).cast("string"))
    )


def _supplied_texts(files: DataFrame, ocr_text: DataFrame | None) -> DataFrame:
    none = F.lit(None).cast("string")
    if ocr_text is None:
        files = files.withColumn("given", none).withColumn("given_ocr", F.lit(False))
    else:
        supplied = ocr_text.select(F.col("path"), F.col("text").alias("given"), F.col("ocr").alias("given_ocr"))
        files = files.join(supplied, "path", "left")
    return files.select(
        *[c for c in files.columns if c not in ("given", "given_ocr")],
        F.col("given").cast("binary").alias("text"),
        F.coalesce("given_ocr", F.lit(False)).alias("ocr"),
        F.lit(False).alias("not_text"),
    )
