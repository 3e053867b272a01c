"""Word files: blocks with their runs, embedded images, and files written back with changed runs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Namespaces of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RUN = "struct<run_index:int,raw_start:int,raw_end:int,text:string,is_italic:boolean,is_bold:boolean>"
BLOCK = f"doc_id string, block_id string, block_ord int, block_type string, raw_text string, runs array<{RUN}>, metadata map<string,string>"
BODY = "word/document.xml"
#: Characters that a Word file can't hold.
NO_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def _flag(run: ET.Element, name: str) -> bool:
    flag = run.find(f"{W}rPr/{W}{name}")
    return flag is not None and flag.get(f"{W}val", "true") not in ("0", "false", "off")


def _text(run: ET.Element) -> str:
    out = []
    for x in run:
        out.append((x.text or "") if x.tag == f"{W}t" else "\t" if x.tag == f"{W}tab" else "\n" if x.tag in (f"{W}br", f"{W}cr") else "")
    return "".join(out)


def _set_text(run: ET.Element, text: str) -> None:
    """The run's content becomes one piece of text; its formatting stays."""
    for x in [x for x in run if x.tag in (f"{W}t", f"{W}tab", f"{W}br", f"{W}cr")]:
        run.remove(x)
    t = ET.SubElement(run, f"{W}t")
    t.text = text
    t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def _parts(archive: zipfile.ZipFile) -> Iterator[tuple[str, str, ET.Element]]:
    """(block prefix, part name, root) of the body, then of each section's header and footer, each part once."""
    names = set(archive.namelist())
    body = ET.fromstring(archive.read(BODY))
    yield "", BODY, body
    links = {}
    if "word/_rels/document.xml.rels" in names:
        links = {x.get("Id"): f"word/{x.get('Target')}" for x in ET.fromstring(archive.read("word/_rels/document.xml.rels"))}
    seen: set[str] = set()
    for s, section in enumerate(body.iter(f"{W}sectPr")):
        for kind in ("header", "footer"):
            for ref in section.findall(f"{W}{kind}Reference"):
                part = links.get(ref.get(f"{R}id"), "")
                if part in names and part not in seen:
                    seen.add(part)
                    yield f"sec_{s}_{kind}", part, ET.fromstring(archive.read(part))


def _paragraphs(prefix: str, root: ET.Element) -> Iterator[tuple[str, str, dict[str, str], ET.Element]]:
    """(block id, block type, metadata, paragraph): paragraphs, then the cells of tables; a cell that spans several counts once."""
    top = root.find(f"{W}body") if not prefix else root
    top = root if top is None else top
    kind = prefix.rsplit("_", 1)[-1] if prefix else "paragraph"
    for i, p in enumerate(top.findall(f"{W}p")):
        yield (f"{prefix}_p_{i}" if prefix else f"p_{i}"), kind, {"para_index": str(i)}, p
    cell, mark = (f"{kind}_table_cell", f"{prefix.rsplit('_', 1)[0]}_{kind[0]}tbl") if prefix else ("table_cell", "tbl")
    for t, table in enumerate(top.findall(f"{W}tbl")):
        for r, row in enumerate(table.findall(f"{W}tr")):
            for c, tc in enumerate(row.findall(f"{W}tc")):
                for p, para in enumerate(tc.findall(f"{W}p")):
                    yield f"{mark}_{t}_r_{r}_c_{c}_p_{p}", cell, {"table": str(t), "row": str(r), "col": str(c)}, para


def blocks_of(content: bytes) -> list[dict]:
    """The blocks of one file in order of reading; a file that is no Word file has none."""
    out: list[dict] = []
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        parts = list(_parts(archive))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return out
    for prefix, _, root in parts:
        for block_id, kind, meta, para in _paragraphs(prefix, root):
            runs, at = [], 0
            for i, run in enumerate(para.findall(f"{W}r")):
                text = _text(run)
                runs.append({"run_index": i, "raw_start": at, "raw_end": at + len(text), "text": text, "is_italic": _flag(run, "i"), "is_bold": _flag(run, "b")})
                at += len(text)
            style = para.find(f"{W}pPr/{W}pStyle")
            name = style.get(f"{W}val", "") if style is not None else ""
            meta = meta | {"style_name": name, "has_italic": str(any(r["is_italic"] for r in runs)).lower(), "is_footnote_style": str("footnote" in name.lower()).lower()}
            out.append({"block_id": block_id, "block_ord": len(out), "block_type": kind, "raw_text": "".join(r["text"] for r in runs), "runs": runs, "metadata": meta})
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all Word files of a path; one file is one row of the scan, so files spread over tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"doc_id": d} | b for d, c in zip(pdf["doc_id"], pdf["content"]) for b in blocks_of(c)]
            yield pd.DataFrame(rows, columns=["doc_id", "block_id", "block_ord", "block_type", "raw_text", "runs", "metadata"])

    return _files(spark, path).mapInPandas(run, BLOCK)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, content) of every embedded image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, c in zip(pdf["doc_id"], pdf["content"]):
                if zipfile.is_zipfile(io.BytesIO(c)):
                    z = zipfile.ZipFile(io.BytesIO(c))
                    rows += [(d, n, z.read(n)) for n in z.namelist() if n.startswith("word/media/") and not n.endswith("/")]
            yield pd.DataFrame(rows, columns=["doc_id", "name", "content"])

    return _files(spark, path).mapInPandas(run, "doc_id string, name string, content binary")


def spliced(runs: list[dict], replacements: list[tuple[int, int, str]]) -> list[str]:
    """The runs' texts after disjoint replacements (start, end, text) in raw places.

    The first run that a span touches gets its replacement and so gives it its looks; runs inside are
    emptied, the last keeps what follows. An empty span changes nothing.
    """
    texts = [r["text"] for r in runs]
    for start, end, new in sorted(replacements, reverse=True):
        first = True
        for i in range(len(runs)):
            a, b = runs[i]["raw_start"], runs[i]["raw_end"]
            if max(a, start) >= min(b, end):
                continue
            left, right = max(start - a, 0), min(end, b) - a
            texts[i] = texts[i][:left] + (new if first else "") + texts[i][right:]
            first = False
    return texts


def made(paragraphs: Iterable[list[dict]]) -> bytes:
    """A new file of paragraphs, each a list of runs (text, is_italic, is_bold); characters that XML can't hold are left out."""
    document = ET.Element(f"{W}document")
    body = ET.SubElement(document, f"{W}body")
    for runs in paragraphs:
        p = ET.SubElement(body, f"{W}p")
        for run in runs:
            r = ET.SubElement(p, f"{W}r")
            looks = [tag for tag, flag in (("b", "is_bold"), ("i", "is_italic")) if run[flag]]
            if looks:
                form = ET.SubElement(r, f"{W}rPr")
                for tag in looks:
                    ET.SubElement(form, f"{W}{tag}")
            for piece in re.split(r"([\t\n\r])", re.sub(NO_XML, "", run["text"] or "")):
                if piece in ("\t", "\n", "\r"):
                    ET.SubElement(r, f"{W}tab" if piece == "\t" else f"{W}br")
                elif piece:
                    t = ET.SubElement(r, f"{W}t")
                    t.text = piece
                    t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr(BODY, ET.tostring(document, encoding="UTF-8", xml_declaration=True))
    return out.getvalue()


def rebuilt(content: bytes, changes: dict[str, list[tuple[int, int, str]]], images: dict[str, bytes] | None = None) -> bytes:
    """The file with replacements by block and images by member name; everything else is kept."""
    source = zipfile.ZipFile(io.BytesIO(content))
    new: dict[str, bytes] = dict(images or {})
    for prefix, part, root in _parts(source):
        changed = False
        for block_id, _, _, para in _paragraphs(prefix, root):
            if block_id in changes:
                runs, at, items = [], 0, para.findall(f"{W}r")
                for run in items:
                    text = _text(run)
                    runs.append({"text": text, "raw_start": at, "raw_end": at + len(text)})
                    at += len(text)
                for run, before, after in zip(items, runs, spliced(runs, changes[block_id])):
                    if before["text"] != after:
                        _set_text(run, after)
                        changed = True
        if changed:
            new[part] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for name in source.namelist():
            target.writestr(name, new.get(name, source.read(name)))
    return out.getvalue()


def rewrite(spark: SparkSession, path: str, changes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, content): the files of a path with ``changes`` (doc_id, block_id, start, end, pseudonym) applied."""
    by_doc = changes.groupBy("doc_id").agg(F.collect_list(F.struct("block_id", "start", "end", "pseudonym")).alias("changes"))
    files = _files(spark, path).join(by_doc, "doc_id", "left")
    if images is not None:
        files = files.join(images.groupBy("doc_id").agg(F.collect_list(F.struct("name", "content")).alias("images")), "doc_id", "left")
    else:
        files = files.withColumn("images", F.lit(None).cast("array<struct<name:string,content:binary>>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, c, ch, im in zip(pdf["doc_id"], pdf["content"], pdf["changes"], pdf["images"]):
                by: dict[str, list[tuple[int, int, str]]] = {}
                for x in ch if ch is not None else []:
                    by.setdefault(x["block_id"], []).append((x["start"], x["end"], x["pseudonym"]))
                pictures = {x["name"]: bytes(x["content"]) for x in (im if im is not None else [])}
                rows.append((d, rebuilt(c, by, pictures) if by or pictures else c))
            yield pd.DataFrame(rows, columns=["doc_id", "content"])

    return files.select("doc_id", "content", "changes", "images").mapInPandas(run, "doc_id string, content binary")


def write_files(files: DataFrame, folder: str, source: str) -> int:
    """Each file under its path below ``source`` into a folder that all executors share; returns how many were written.

    A folder of a mounted file system is written to directly, any other (hdfs:, s3a: and so on) by Arrow's file systems.
    """
    root = source.split("*", 1)[0].rsplit("/", 1)[0] if "*" in source or source.endswith(".docx") else source.rstrip("/")
    root = root.split(":", 1)[-1].lstrip("/")
    target_of = lambda d: d.split(":", 1)[-1].lstrip("/").removeprefix(root).lstrip("/")

    if ":" not in folder or folder.startswith("file:"):
        base = folder.removeprefix("file://").removeprefix("file:")

        def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pathlib import Path

            for pdf in batches:
                for d, c in zip(pdf["doc_id"], pdf["content"]):
                    target = Path(base) / target_of(d)
                    target.parent.mkdir(parents=True, exist_ok=True)
                    target.write_bytes(bytes(c))
                yield pd.DataFrame({"n": [len(pdf)]})

    else:
        from pyarrow import fs

        def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            there, base = fs.FileSystem.from_uri(folder)
            for pdf in batches:
                for d, c in zip(pdf["doc_id"], pdf["content"]):
                    target = f"{base.rstrip('/')}/{target_of(d)}"
                    there.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    with there.open_output_stream(target) as out:
                        out.write(bytes(c))
                yield pd.DataFrame({"n": [len(pdf)]})

    return files.mapInPandas(put, "n int").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
