"""Canonical documents: JSON of several tables in fixed order, with a receipt.

A document is an object of sections in the order given; a section is an object
(one row) or an array of rows in order. publish_document writes the rows in the
tasks, in ordered parts, and joins the parts' bytes; encode sends them through the
driver's Python one partition at a time, to any function that takes bytes.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.encoding import canonical_json
from lodestone.tables import shared_folder


class TooLarge(ValueError):
    """The document has more bytes than it may."""


@dataclass(frozen=True)
class Receipt:
    """A document's size and SHA-256."""

    size: int
    sha256: str


@dataclass(frozen=True)
class Section:
    """Rows of a document: in the order of some columns, as an array, or the one row as an object."""

    name: str
    rows: DataFrame
    order: tuple[str, ...] = ()
    single: bool = False

    def texts(self) -> Iterator[str]:
        body = canonical_json(F.struct(*self.rows.columns)).alias("_json")
        ordered = self.rows.orderBy(*self.order) if self.order else self.rows
        for row in ordered.select(body).toLocalIterator():
            yield row["_json"]


def encode(sections: list[Section], write: Callable[[bytes], None], most_bytes: int) -> Receipt:
    """Write a document and return its receipt; TooLarge as soon as it would pass most_bytes, with nothing more written."""
    if len({s.name for s in sections}) < len(sections):
        raise ValueError("a section is named twice")
    digest, size = hashlib.sha256(), 0

    def put(text: str) -> None:
        nonlocal size
        data = text.encode()  # strings of tables are valid UTF-8; unpaired surrogates raise here
        if size + len(data) > most_bytes:
            raise TooLarge(f"more than {most_bytes} bytes")
        size += len(data)
        digest.update(data)
        write(data)

    for k, section in enumerate(sections):
        put(("{" if k == 0 else ",") + json.dumps(section.name) + ":")
        texts = section.texts()
        if section.single:
            found = list(texts)
            if len(found) != 1:
                raise ValueError(f"{section.name} has {len(found)} rows, not one")
            put(found[0])
            continue
        put("[")
        for i, text in enumerate(texts):
            put(("," if i else "") + text)
        put("]")
    put("}\n" if sections else "{}\n")
    return Receipt(size, digest.hexdigest())


def encode_all(documents: dict[str, list[Section]], write: Callable[[str, bytes], None], most_bytes: int) -> dict[str, Receipt]:
    """Several documents, each with its own bound, by name in order."""
    return {name: encode(sections, lambda data, name=name: write(name, data), most_bytes) for name, sections in documents.items()}


def report(rows: DataFrame, pretty: bool = False) -> str:
    """One row as JSON text, compact or indented by two."""
    text = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j")).first()["j"]
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False) if pretty else text


def publish_document(sections: list[Section], path: str, most_bytes: int) -> Receipt:
    """Write the document that encode() gives to a file system that Spark reaches, under its name only once it is whole.

    Rows are made to text, ordered and written by the tasks, in parts of the
    shared folder. The parts' lengths tell the size before anything is put
    together; then the driver's JVM passes their bytes on, through the digest and
    into the file. A text that is no UTF-8 fails the job that writes it.
    """
    if len({s.name for s in sections}) < len(sections):
        raise ValueError("a section is named twice")
    spark = sections[0].rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts = shared_folder(spark)
    pieces: list[tuple[bytes, list, bool]] = []  # a mark, and the files after it, of which the last row's comma goes
    for k, section in enumerate(sections):
        mark = ("{" if k == 0 else ",") + json.dumps(section.name) + ":"
        files = _written_parts(section, f"{parts}/{k}")
        if section.single and sum(n for _, n in files) == 0:
            raise ValueError(f"{section.name} has no row")
        pieces.append(((mark if section.single else mark + "[").encode(), files, section.single))
    ends = [b"" if single else b"]" for _, _, single in pieces]
    size = sum(len(mark) + max(0, sum(n for _, n in files) - 1) + len(end) for (mark, files, _), end in zip(pieces, ends, strict=True)) + 2
    if size > most_bytes:
        raise TooLarge(f"{size} bytes, more than {most_bytes}")
    to, aside = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}._{uuid.uuid4().hex}"))
    fs = to.getFileSystem(conf)
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    stream = jvm.java.security.DigestOutputStream(fs.create(aside, False), digest)
    copy = jvm.org.apache.commons.io.IOUtils.copyLarge
    try:
        try:
            for (mark, files, _), end in zip(pieces, ends, strict=True):
                stream.write(bytearray(mark))
                for i, (file, n) in enumerate(files):
                    source = file.getFileSystem(conf).open(file)
                    try:
                        copy(source, stream, 0, n - (i == len(files) - 1))
                    finally:
                        source.close()
                stream.write(bytearray(end))
            stream.write(bytearray(b"}\n"))
        finally:
            stream.close()
        replace(spark, aside, to)
    except Exception:
        fs.delete(aside, False)
        raise
    for _, files, _ in pieces:
        for file, _ in files[:1]:
            file.getFileSystem(conf).delete(file.getParent(), True)
    return Receipt(size, bytes(digest.digest()).hex())


def _written_parts(section: Section, folder: str) -> list[tuple[object, int]]:
    """Write a section's rows as texts with a comma after each; the files that hold any, in order, with their lengths."""
    spark = section.rows.sparkSession
    if section.single and (n := section.rows.limit(2).count()) != 1:
        raise ValueError(f"{section.name} has {'no row' if not n else 'several rows'}, not one")
    rows = section.rows.orderBy(*section.order) if section.order else section.rows
    rows.select(F.validate_utf8(canonical_json(F.struct(*rows.columns))).alias("value")).write.option("lineSep", ",").text(folder)
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(top)
    files = sorted((x.getPath().getName(), x.getPath(), x.getLen()) for x in found if x.getPath().getName().startswith("part-") and x.getLen())
    return [(file, n) for _, file, n in files]


def replace(spark: SparkSession, source: object, to: object) -> None:
    """Rename a file over another, which is there, as it was or as it will be, at any time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    qualified = to.makeQualified(to.getFileSystem(conf).getUri(), to.getFileSystem(conf).getWorkingDirectory())
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf).rename(source, qualified, how)
