"""Readers of PDFs, TEI, layout JSON, reports and the registry."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

COORD = "struct<page:int,x:double,y:double,w:double,h:double>"
TEI = f"struct<title:string,authors:array<string>,year:int,doi:string,abstract:string,sections:array<struct<heading:string,level:int,path:array<string>,coords:array<{COORD}>>>,paragraphs:array<struct<text:string,sentences:array<string>,section:string,section_path:array<string>,coords:array<{COORD}>,page:int>>,figures:array<struct<type:string,label:string,caption:string,coords:array<{COORD}>,page:int>>,references:array<struct<title:string,authors:array<string>,raw:string>>>"
BOX = "struct<l:double,t:double,r:double,b:double,coord_origin:string>"
PROV = f"array<struct<page_no:int,bbox:{BOX}>>"
LAYOUT = f"struct<texts:array<struct<text:string,orig:string,label:string,prov:{PROV}>>,pictures:array<struct<children:array<struct<text:string>>,prov:{PROV}>>,tables:array<struct<prov:{PROV}>>>"
AUDIT = "metadata struct<title:string,author:string,subject:string,keywords:string,creator:string,producer:string,creation_date:string,modification_date:string>, num_pages int, pages array<struct<page_no:int,blocks:array<struct<block_no:int,x0:double,y0:double,x1:double,y1:double,text:string>>>>"
#: Records of texts of so many characters are held at once; a record in Python is many times its text.
HELD_CHARS = 1 << 20
_NS = "{http://www.tei-c.org/ns/1.0}"


def pdf_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content and file_hash of the PDFs in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(root)
    return files.select("path", "content", F.sha2("content", 256).alias("file_hash"))


def tei_texts(spark: SparkSession, root: str) -> DataFrame:
    """path and xml of stored TEI files; the service that makes them is outside the engine."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", "*.xml").text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def _plain(text: str | None) -> str:
    return " ".join((text or "").replace("\xa0", " ").split())


def _all_text(node: ElementTree.Element | None) -> str:
    return _plain("".join(node.itertext())) if node is not None else ""


def _paragraph(node: ElementTree.Element, whole: bool) -> str:
    """A paragraph's text; without `whole` only what elements begin with, not what follows an element inside."""
    if whole:
        return _plain(" ".join(node.itertext()))
    return _plain(" ".join(_all_text(x) if x.tag.endswith("formula") else x.text or "" for x in node.iter()))


def _coords(node: ElementTree.Element, attribute: bool) -> list[dict]:
    out = []
    for c in node.iter(_NS + "coordinates"):
        try:
            page, *box = (c.get(k, "0") for k in ("page", "x", "y", "width", "height"))
            out.append({"page": int(page), **dict(zip("xywh", map(float, box), strict=True))})
        except ValueError:
            continue
    for part in (node.get("coords") or "").split(";") if attribute else []:
        try:
            page, *box = part.split(",")
            out.append({"page": int(page), **dict(zip("xywh", map(float, box), strict=True))})
        except ValueError:
            continue
    return out


def _page(coords: list[dict]) -> int | None:
    return coords[0]["page"] if coords else None


def _first_of(records: list[dict], *fields: str) -> list[dict]:
    """The first record of each key, cleaned and in lower case."""
    kept: dict[tuple, dict] = {}
    for r in records:
        kept.setdefault(tuple(tuple(_plain(x).lower() for x in v) if isinstance(v := r[f], list) else _plain(str(v)).lower() for f in fields), r)
    return list(kept.values())


class _Reader:
    """The record of a TEI document from its elements, each as it ends; none outlives the outermost one that is read as a whole."""

    #: Elements that are read as a whole; what is inside stays until they end.
    WHOLE = {_NS + t for t in ("p", "head", "figure", "biblStruct", "abstract", "title", "date")}

    def __init__(self, coords_attribute: bool, whole: bool):
        self.attribute, self.whole = coords_attribute, whole
        self.title = self.abstract = self.doi = self.year = None
        self.authors: list[str] = []
        # divs of the body by number, 0 the body itself: [number of the one around, level, heading or None before its head, coords]
        self.divs: list[list] = []
        self.paragraphs: list[tuple[int, dict]] = []
        self.figures: list[tuple[int, dict]] = []
        self.references: list[dict] = []

    def read(self, xml: str) -> dict:
        stack: list[ElementTree.Element] = []
        tags: list[str] = []
        own: list[int] = []  # for each open element the number of its div, -1 where it isn't in the line of divs
        begun: list[int] = []
        count = held = 0
        for event, node in ElementTree.iterparse(io.StringIO(xml), ("start", "end")):
            name = node.tag.removeprefix(_NS) if node.tag.startswith(_NS) else ""
            if event == "start":
                count += 1
                around = own[-1] if own else -1
                number = -1
                if name == "body" and tags and tags[-1] == "text" and not self.divs or name == "div" and around >= 0:
                    number = len(self.divs)
                    self.divs.append([around, self.divs[around][1] + 1 if number else 0, None, []])
                stack.append(node)
                tags.append(name)
                own.append(number)
                begun.append(count)
                held += node.tag in self.WHOLE
                continue
            stack.pop(), tags.pop(), own.pop()
            self.ended(name, node, tags, own[-1] if own else -1, begun.pop())
            held -= node.tag in self.WHOLE
            if not held and stack:
                stack[-1].remove(node)
        return self.record()

    def ended(self, name: str, node: ElementTree.Element, tags: list[str], div: int, begun: int) -> None:
        """tags: names of the elements around; div: the number of the div or body that the element is a child of, or -1."""
        header = "teiHeader" in tags
        if name == "p" and div >= 0:
            if text := _paragraph(node, self.whole):
                coords = _coords(node, self.attribute)
                self.paragraphs.append((div, {"text": text, "sentences": [x.strip() for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()], "coords": coords, "page": _page(coords)}))
        elif name == "head" and div > 0 and self.divs[div][2] is None:
            self.divs[div][2:] = _all_text(node), _coords(node, self.attribute)
        elif name == "figure":
            coords = _coords(node, self.attribute)
            self.figures.append((begun, {"type": node.get("type") or "figure", "label": _all_text(node.find(_NS + "label")), "caption": _all_text(node.find(_NS + "figDesc")), "coords": coords, "page": _page(coords)}))
        elif name == "biblStruct" and tags[-1:] == ["listBibl"]:
            title = node.find(f".//{_NS}analytic/{_NS}title")
            title = node.find(f".//{_NS}monogr/{_NS}title") if title is None else title
            self.references.append({"title": _all_text(title), "authors": [x for a in node.iter(_NS + "author") if (x := _all_text(a))], "raw": _all_text(node)})
        if header:
            self.ended_in_header(name, node, tags)

    def ended_in_header(self, name: str, node: ElementTree.Element, tags: list[str]) -> None:
        if name == "title" and tags[-3:] == ["teiHeader", "fileDesc", "titleStmt"] and self.title is None:
            self.title = _all_text(node)
        elif name == "biblStruct" and tags[-3:] == ["teiHeader", "fileDesc", "sourceDesc"]:
            for person in (a.find(_NS + "persName") for a in node.iterfind(f"{_NS}analytic/{_NS}author")):
                if person is not None:
                    names = [*person.iterfind(_NS + "forename"), *([last] if (last := person.find(_NS + "surname")) is not None else [])]
                    self.authors.append(_plain(" ".join(_all_text(x) for x in names)))
            for x in node.iterfind(_NS + "idno"):
                if self.doi is None and (x.get("type") or "").strip().lower() == "doi":
                    self.doi = _all_text(x) or None
        elif name == "date" and self.year is None:
            found = re.search(r"(?:19|20)[0-9]{2}", node.get("when") or _all_text(node))
            self.year = int(found[0]) if found else None
        elif name == "abstract" and tags[-2:] == ["teiHeader", "profileDesc"] and not self.abstract:
            inside = list(node.iter(_NS + "p"))
            self.abstract = _plain(" ".join(_paragraph(p, self.whole) for p in inside)) if inside else _all_text(node)

    def path(self, div: int) -> list[str]:
        """Headings from the outermost div to this one, which may be none's."""
        out = []
        while div > 0:
            out += [self.divs[div][2]] * bool(self.divs[div][2])
            div = self.divs[div][0]
        return out[::-1]

    def record(self) -> dict:
        # a div's own paragraphs come before those of the divs inside it, wherever they stand
        sections = [{"heading": d[2], "level": d[1], "path": self.path(k), "coords": d[3]} for k, d in enumerate(self.divs) if d[2]]
        paragraphs = [p | {"section": path[-1] if path else None, "section_path": path} for div, p in sorted(self.paragraphs, key=lambda x: x[0]) for path in [self.path(div)]]
        figures = [f for _, f in sorted(self.figures, key=lambda x: x[0])]
        authors = {a.lower(): a for a in reversed(self.authors) if a}
        return {
            "title": self.title or "", "authors": list(reversed(authors.values())), "year": self.year, "doi": self.doi, "abstract": self.abstract or "",
            "sections": _first_of(sections, "heading", "path"),
            "paragraphs": _first_of(paragraphs, "text", "page", "section"),
            "figures": _first_of(figures, "type", "label", "caption", "page"),
            "references": _first_of(self.references, "title", "raw"),
        }


def parse_tei(xml: str, coords_attribute: bool = True, whole: bool = True) -> dict:
    """The record of one TEI document, read element by element. Repeated sections, paragraphs, figures and references go, the first of each stays.
    whole=False takes of a paragraph only what its elements begin with."""
    return _Reader(coords_attribute, whole).read(xml)


def parsed_tei(texts: DataFrame, coords_attribute: bool = True, whole: bool = True) -> DataFrame:
    """texts(path, xml[, error]) with tei, a struct, and error, null where the text was read.

    A null or empty xml, such as that of a file whose service failed, keeps the error that it came with or gets one; none stops another.
    """

    def one(path: str, xml: str | None, before: str | None) -> tuple[str, dict | None, str | None]:
        if xml is None or not xml.strip():
            return path, None, before or "no text"
        try:
            return path, parse_tei(xml, coords_attribute, whole), None
        except ElementTree.ParseError as e:
            return path, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, xml, before in zip(*batch.select(["path", "xml", "error"]).columns, strict=True):
                text = xml.as_py()
                rows.append(one(path.as_py(), text, before.as_py()))
                held += len(text or "")
                if held >= HELD_CHARS:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    error = F.col("error") if "error" in texts.columns else F.lit(None).cast("string").alias("error")
    schema = T.StructType.fromDDL(f"path string, tei {TEI}, error string")
    kind = to_arrow_schema(schema)
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind.field(k).type) for k in range(3)], schema=kind)
    return texts.select("path", "xml", error).mapInArrow(run, schema)


def layout_artifacts(trees: DataFrame, tree: str = "json") -> DataFrame:
    """trees with figures, tables, formulas and text_blocks of a layout tree in JSON; records need a page and a box."""

    def coords(prov):  # noqa: ANN001, ANN202
        good = F.filter(prov, lambda p: p["page_no"].isNotNull() & p["bbox"].isNotNull())
        return F.transform(good, lambda p: F.struct(p["page_no"].alias("page"), p["bbox"]["l"].alias("x"), p["bbox"]["b"].alias("y"), (p["bbox"]["r"] - p["bbox"]["l"]).alias("w"), (p["bbox"]["t"] - p["bbox"]["b"]).alias("h"), p["bbox"]["coord_origin"].alias("coord_origin")))

    rows = trees.withColumn("_t", F.from_json(tree, LAYOUT))
    caption = lambda p: F.coalesce(F.get(F.filter(F.transform(p["children"], lambda c: F.coalesce(c["text"], F.lit(""))), lambda t: t != ""), F.lit(0)), F.lit(""))
    out = {
        "figures": F.transform("_t.pictures", lambda p: F.struct(caption(p).alias("caption"), coords(p["prov"]).alias("coords"))),
        "tables": F.transform("_t.tables", lambda p: F.struct(coords(p["prov"]).alias("coords"))),
        "formulas": F.transform(F.filter("_t.texts", lambda t: F.coalesce(t["label"], F.lit("")).contains("formula")), lambda t: F.struct(F.coalesce(F.nullif(t["text"], F.lit("")), t["orig"]).alias("text"), coords(t["prov"]).alias("coords"))),
        "text_blocks": F.transform("_t.texts", lambda t: F.struct(t["text"].alias("text"), t["label"].alias("label"), coords(t["prov"]).alias("coords"))),
    }
    return rows.withColumns({k: F.coalesce(v, F.array().cast(dict(rows.select(v.alias(k)).dtypes)[k])) for k, v in out.items()}).drop("_t")


def with_formula_regions(trees: DataFrame, tree: str = "json") -> DataFrame:
    """Trees that have a text labelled as formula: the ones worth an expensive pass."""
    return trees.where(F.exists(F.from_json(tree, LAYOUT)["texts"], lambda t: F.coalesce(t["label"], F.lit("")).contains("formula")))


def audit_blocks(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(papers, blocks) of stored PDF audits, `<paper_id>.json`, one document a file: papers(paper_id, metadata, num_pages) and
    blocks(paper_id, page_no, block_no, x0, y0, x1, y1, text), as plans.papers.audit_documents() takes them.

    The schema is given, so nothing is read to infer it; a file is one split, read by the tasks from any store that Spark reads, and of the top-level
    fields only those that a query uses are parsed. A file that is no JSON has a row in papers with null fields, and no blocks.
    """
    rows = spark.read.schema(AUDIT).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(root)
    rows = rows.withColumn("paper_id", F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.json", 1))
    papers = rows.select("paper_id", "metadata", "num_pages")
    blocks = rows.select("paper_id", F.explode("pages").alias("p")).select("paper_id", "p.page_no", F.explode("p.blocks").alias("b")).select("paper_id", "page_no", "b.*")
    return papers, blocks


def quality_reports(spark: SparkSession, root: str) -> DataFrame:
    """Stored quality reports, one row each, with paper_id from the file name."""
    rows = spark.read.option("multiLine", True).option("pathGlobFilter", "*_quality.json").json(root)
    return rows.withColumn("paper_id", F.regexp_extract(F.col("_metadata.file_name"), r"(.*)_quality\.json", 1))


def registry_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A registry file, an object keyed by paper id, as rows of schema; one that doesn't exist has none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.map_values(F.from_json("value", f"map<string,struct<{schema}>>"))).alias("r")).select("r.*")
