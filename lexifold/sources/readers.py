"""Readers: every one gives a DataFrame and leaves the files to Spark's own sources."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.pipeline import stage
from ..ship import ship


def globs(text: str) -> list[str]:
    """The lines of a list of paths or patterns."""
    return [x.strip() for x in text.split("\n") if x.strip()]


def file_list(spark: SparkSession, paths: str) -> DataFrame:
    """(path, size_bytes, modified_at, extension, content = path): contents are never read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(globs(paths))
    return f.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), F.col("path").alias("content"))


def find_files(files: DataFrame, search: str) -> DataFrame:
    """Files whose name holds every blank-separated term, any case."""
    name = F.lower(F.substring_index("path", "/", -1))
    for term in search.lower().split():
        files = files.where(F.contains(name, F.lit(term)))
    return files


def numbered_lines(df: DataFrame, content: str = "content") -> DataFrame:
    """One row a line; outline is its number, from 1, with six digits."""
    lines = F.split(F.regexp_replace(content, r"\r?\n$", ""), r"\r?\n")
    rest = [c for c in df.columns if c not in (content, "outline")]
    return df.select(*rest, F.posexplode(lines).alias("__i", content)).select(*rest, F.lpad((F.col("__i") + 1).cast("string"), 6, "0").alias("outline"), content)


def text_lines(spark: SparkSession, paths: str, dataset: str = "", lang: str = "auto") -> DataFrame:
    """Lines of text files of any size, numbered within their file (from 1, six digits or more).

    Files are read in splits. Lines of a split come one after the other, so a
    line's place in its split is the difference of two running numbers; the
    lines of all splits before it in the file are a sum over a small table.
    """
    lines = spark.read.text(globs(paths)).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__n"), F.col("value").alias("content"))
    splits = lines.groupBy("source", "__split").agg(F.min("__n").alias("__first"), F.count("*").alias("__lines"))
    before = F.sum("__lines").over(Window.partitionBy("source").orderBy("__split")) - F.col("__lines")
    known = splits.select("source", "__split", (before - F.col("__first") + 1).alias("__add"))
    number = (F.col("__n") + F.col("__add")).cast("string")
    outline = F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)
    return lines.join(known, ["source", "__split"]).select("source", outline.alias("outline"), F.regexp_replace("content", r"\r$", "").alias("content"), F.lit(dataset).alias("dataset_name"), F.lit(lang).alias("lang"))


def inline_lines(spark: SparkSession, content: str, delimiter: str = "\n", dataset: str = "", lang: str = "auto") -> DataFrame:
    """(pos, content): the parts of a string at a literal delimiter, empty ones left out."""
    d = spark.range(1).select(F.posexplode(F.split(F.lit(content), r"\Q" + delimiter + r"\E")).alias("pos", "content")).where("content <> ''")
    return d.withColumn("dataset_name", F.lit(dataset)).withColumn("lang", F.lit(lang))


def lines_of(df: DataFrame, delimiter: str = "\n", content: str = "content") -> DataFrame:
    """As inline_lines, of each record's own text: its other columns, pos and the part."""
    rest = [c for c in df.columns if c not in (content, "pos")]
    return df.select(*rest, F.posexplode(F.split(content, r"\Q" + delimiter + r"\E")).alias("pos", content)).where(F.col(content) != "")


def json_records(df: DataFrame, content: str = "content") -> DataFrame:
    """(record variant): the records of JSON texts that are an object, an array, or an object with `results`."""
    v = F.try_parse_json(content)
    d = df.select(v.alias("v")).where("v is not null")
    inner = F.try_variant_get("v", "$.results", "array<variant>")
    many = F.try_variant_get("v", "$", "array<variant>")
    return d.select(F.explode(F.coalesce(inner, many, F.array("v"))).alias("record"))


def json_fields(records: DataFrame, fields: dict) -> DataFrame:
    """The named fields (name -> type) of records as columns."""
    return records.select(*[F.try_variant_get("record", f"$.{k}", t).alias(k) for k, t in fields.items()])


# fixed values: the field codes of EndNote records
ENDNOTE = {
    "%0": "item_type", "%A": "authors", "%+": "institutions", "%J": "journal", "%D": "pdate", "%T": "title", "%N": "issue",
    "%K": "tags", "%X": "content", "%P": "pages", "%@": "issn", "%L": "cn_publishing_number", "%W": "catalog",
}


def endnote(df: DataFrame, content: str = "content") -> DataFrame:
    """(record, fields map<string,array<string>>): records between blank lines, `code value` lines.

    A line without a code goes on with the field before; a value with ; has
    several parts (but not content's); repeated fields gather their values.
    """
    records = F.filter(F.split(F.concat(F.regexp_replace(content, r"\r", ""), F.lit("\n")), r"\n[ \t]*\n"), lambda r: r.rlike(r"\S"))
    r = df.select(F.posexplode(records).alias("record", "text"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    code = F.create_map(*[F.lit(x) for kv in ENDNOTE.items() for x in kv])

    def entry(line, field):
        values = F.when(F.contains(line, F.lit(";")) & (field != "content"), F.filter(F.split(line, ";"), lambda v: v != "")).otherwise(F.array(line))
        return F.struct(field.alias("field"), values.alias("values"))

    def step(acc, line):
        coded = F.contains(line, F.lit(" "))
        field = F.when(coded, F.coalesce(F.try_element_at(code, F.upper(F.substring_index(line, " ", 1))), F.lit("content"))).otherwise(acc["field"])
        value = F.when(coded, F.regexp_replace(line, r"^\S+ ", "")).otherwise(line)
        return F.struct(field.alias("field"), F.array_append(acc["out"], entry(value, field)).alias("out"))

    zero = F.struct(F.lit("content").alias("field"), F.array().cast("array<struct<field:string,values:array<string>>>").alias("out"))
    parsed = F.aggregate(lines, zero, step)["out"]
    names = F.array_distinct(F.transform(parsed, lambda e: e["field"]))
    fields = F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.flatten(F.transform(F.filter(parsed, lambda e: e["field"] == n), lambda e: e["values"])).alias("value"))))
    return r.select("record", fields.alias("fields"))


def markdown_sections(df: DataFrame, content: str = "content") -> DataFrame:
    """One row for each section that isn't empty: outline (its heading), heading_level, pagenum (the heading's number), content.

    Text before the first heading is left out; without headings the whole is "Full Document".
    """
    rest = [c for c in df.columns if c not in (content, "outline", "pagenum", "heading_level")]
    heads = F.regexp_extract_all(content, F.lit(r"(?m)^(#{1,6})[ \t]+(.+)$"), F.lit(0))
    parts = F.slice(F.split(content, r"(?m)^#{1,6}[ \t]+.+$", -1), 2, 1 << 30)
    zipped = F.arrays_zip(heads.alias("h"), parts.alias("t"))
    d = df.select(*rest, F.col(content).alias("__c"), F.posexplode_outer(F.when(F.size(heads) > 0, zipped)).alias("__i", "__s"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    out = d.select(
        *rest, F.coalesce(F.trim(F.regexp_replace("__s.h", r"^#{1,6}[ \t]+", "")), F.lit("Full Document")).alias("outline"),
        F.coalesce(F.length(F.regexp_extract("__s.h", r"^(#{1,6})", 1)), F.lit(0)).alias("heading_level"), (F.coalesce("__i", F.lit(0)) + 1).cast("string").alias("pagenum"),
        strip(F.coalesce("__s.t", "__c")).alias(content),
    )
    return out.where(F.col(content) != "")


def _cells(sheet: bytes, strings: list[str]):
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    for row in ElementTree.fromstring(sheet).iter(ns + "row"):
        out = []
        for c in row.iter(ns + "c"):
            v, kind = c.find(ns + "v"), c.get("t")
            text = "".join(x.text or "" for x in c.iter(ns + "t")) if kind == "inlineStr" else "" if v is None else strings[int(v.text)] if kind == "s" else v.text or ""
            at = re.match(r"[A-Z]+", c.get("r", ""))
            if at:
                n = 0
                for letter in at[0]:
                    n = n * 26 + ord(letter) - 64
                out += [""] * (n - 1 - len(out))
            out.append(text)
        yield out


def xlsx_rows(data: bytes):
    """(sheet number, {heading: value}) of every row below the first of each sheet."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        strings = ["".join(t.text or "" for t in si.iter(ns + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(ns + "si")] if "xl/sharedStrings.xml" in names else []
        for i, name in enumerate(sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))):
            rows = list(_cells(z.read(name), strings))
            for row in rows[1:]:
                yield i, {k: v for k, v in zip(rows[0], row) if k and v != ""}


def docx_text(data: bytes) -> str:
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(ns + "t")) for p in body.iter(ns + "p"))


def office_files(spark: SparkSession, paths: str, kind: str) -> DataFrame:
    """docx: (source, content), a row a file. xlsx: (source, sheet, row map), a row a row. A file must fit one task."""
    ship(spark)
    files = spark.read.format("binaryFile").load(globs(paths)).select("path", "content")

    def docx(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([docx_text(x) for x in b.column("content").to_pylist()], pa.string())], ["source", "content"])

    def xlsx(batches):
        for b in batches:
            rows = [(p, i, r) for p, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()) for i, r in xlsx_rows(data)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([list(r[2].items()) for r in rows], pa.map_(pa.string(), pa.string()))], ["source", "sheet", "row"])

    return files.mapInArrow(docx, "source string, content string") if kind == "docx" else files.mapInArrow(xlsx, "source string, sheet int, row map<string,string>")


def pdf_pages(files: DataFrame, extract, done: DataFrame | None = None, page_range: str = "", least: int = 10) -> DataFrame:
    """(source, source_page, pagenum, content) of documents (path, content binary).

    extract(bytes) -> iterable of (page from 0, label, text) is the caller's
    extractor. With `done` (path, source_page), pages up to a file's last known
    one are left out; so are pages outside the range and those shorter than least.
    """
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            rows = [(p, *x) for p, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()) for x in extract(data)]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], ["path", "page", "pagenum", "content"])

    from ..functions.arrays import page_range as pages_of
    from ..operators.snapshots import resume_pages

    pages = files.select("path", "content").mapInArrow(run, "path string, page int, pagenum string, content string").where(F.char_length("content") >= least)
    if page_range:
        pages = pages.where(F.array_contains(pages_of(F.lit(page_range)), F.col("page")))
    if done is not None:
        pages = resume_pages(pages, done)
    return pages.select(F.col("path").alias("source"), F.col("page").alias("source_page"), F.coalesce("pagenum", (F.col("page") + 1).cast("string")).alias("pagenum"), "content")


#: fields of a library record that go by another name here
ZOTERO = {"abstractNote": "abstract_note", "publicationTitle": "publication", "DOI": "doi", "ISBN": "isbn", "ISSN": "issn", "shortTitle": "short_title", "seriesTitle": "series_title", "libraryCatalog": "library_catalog"}


def zotero_items(df: DataFrame, content: str = "content") -> DataFrame:
    """JSON items of a reference library as records; items without a title are left out."""
    from ..functions.dates import partial_date

    plain = ["title", "itemType", "date", "url", "volume", "issue", "pages", "publisher", "place", "language", "series", "extra", "journalAbbreviation", *ZOTERO]
    schema = "key string, version bigint, data struct<" + ", ".join(f"{c}: string" for c in plain) + ", creators: array<struct<creatorType:string,firstName:string,lastName:string,name:string>>, tags: array<struct<tag:string>>>"
    d = df.select(F.from_json(content, schema).alias("j")).select("j.key", "j.data.*").where("trim(coalesce(title, '')) <> ''")
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))

    def person(p):
        last = text(F.coalesce(p["lastName"], p["name"]))
        first = text(p["firstName"])
        return F.when((first != "") & p["creatorType"].isin("author", "editor"), F.concat(last, F.lit(", "), first)).otherwise(last)

    authors = F.filter(F.transform(F.coalesce("creators", F.array().cast("array<struct<creatorType:string,firstName:string,lastName:string,name:string>>")), person), lambda a: a != "")
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<struct<tag:string>>")), lambda t: F.trim(t["tag"])), lambda t: t != "")
    named = [F.nullif(text(F.col(k)), F.lit("")).alias(v) for k, v in ZOTERO.items() if v not in ("publication",)]
    return d.select(
        F.col("key").alias("id"), text(F.col("title")).alias("title"), F.array_join(authors, " & ").alias("author"), authors.alias("authors"), partial_date("date").alias("pdate"),
        F.coalesce(F.nullif(text(F.col("publicationTitle")), F.lit("")), F.nullif(text(F.col("journalAbbreviation")), F.lit(""))).alias("publication"),
        *named, *[F.nullif(text(F.col(c)), F.lit("")).alias(c) for c in ("url", "volume", "issue", "pages", "publisher", "place", "series", "extra")],
        F.coalesce(F.nullif(text(F.col("language")), F.lit("")), F.lit("en")).alias("language"), F.col("itemType").alias("item_type"), tags.alias("tags"),
    )


def paged(spark: SparkSession, fetch, total: int, limit: int = 100) -> DataFrame:
    """(page, content): fetch(start, limit) -> list of JSON texts, the caller's transport, called once a page on the executors."""
    ship(spark)

    def run(batches):
        for b in batches:
            rows = [(p, x) for p in b.column("id").to_pylist() for x in fetch(p * limit, limit)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["page", "content"])

    pages = -(-total // limit)
    return spark.range(0, pages, 1, max(1, min(pages, 200))).mapInArrow(run, "page long, content string")


def any_cell_contains(df: DataFrame, keyword: str) -> DataFrame:
    """Rows of which some cell holds the keyword."""
    return df.where(F.exists(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]), lambda x: F.contains(x, F.lit(keyword))))


def tag_guesses(tag: Column) -> Column:
    """A tag word and the singulars that it may be the plural of."""
    return F.array_distinct(F.filter(F.array(tag, F.when(F.endswith(tag, F.lit("ies")), F.regexp_replace(tag, "ies$", "y")), F.when(F.endswith(tag, F.lit("es")), F.regexp_replace(tag, "es$", "")), F.when(F.endswith(tag, F.lit("s")), F.regexp_replace(tag, "s$", ""))), lambda x: x.isNotNull()))


@stage("MarkdownSections")
def _markdown_stage(df: DataFrame) -> DataFrame:
    """Sections of Markdown contents."""
    return markdown_sections(df)
