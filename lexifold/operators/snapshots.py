"""Sinks and maintenance: every job computes a new snapshot; none writes over what it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import has
from ..functions.dates import year_of_path
from ..functions.text import no_other_characters, strip_accents


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old without the keys of new, and new. A key that new has twice must be settled before."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def save_paragraphs(old: DataFrame, new: DataFrame) -> DataFrame:
    """upsert with contents freed of control and other odd characters; rows without an id get one from their content."""
    made = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "source_page", "content") if c in new.columns]), 256)
    new = new.withColumn("content", no_other_characters("content")).withColumn("id", F.coalesce(F.col("id").cast("string"), made))
    return upsert(old.withColumn("id", F.col("id").cast("string")), new.dropDuplicates(["id"]))


def delete(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def new_terms(existing: DataFrame, df: DataFrame, keywords: str = "keywords") -> DataFrame:
    """(term): keywords longer than one character that aren't there yet."""
    return all_terms(df, keywords).where(F.char_length("term") > 1).join(existing.select("term"), "term", "left_anti")


def all_terms(df: DataFrame, keywords: str = "keywords") -> DataFrame:
    """(term): the distinct keywords that aren't empty."""
    return df.select(F.explode(keywords).alias("term")).where("term <> ''").distinct()


def unused_datasets(datasets: DataFrame, bridge: DataFrame) -> DataFrame:
    """Data sets without a file."""
    return datasets.join(bridge.select(F.col("dataset").alias("name")), "name", "left_anti")


def orphaned_files(files: DataFrame, bridge: DataFrame) -> DataFrame:
    return files.join(bridge.select(F.col("file_id").alias("id")), "id", "left_anti")


def mark_offline(files: DataFrame, present: DataFrame) -> DataFrame:
    """files with `offline`: whether its path is not among those present."""
    here = present.select("path").distinct().withColumn("here", F.lit(True))
    return files.join(here, "path", "left").withColumn("offline", F.col("here").isNull()).drop("here")


def author_from_path(paragraphs: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """paragraphs with author, where it is empty, from the pattern's group (or whole match) in the file's path."""
    group = 1 if "(" in pattern.replace("(?", "") else 0
    got = files.select(F.col("id").alias("source"), F.regexp_extract("path", "(?i)" + pattern, group).alias("__a")).where("__a <> ''")
    empty = F.coalesce(F.col("author"), F.lit("")) == ""
    return paragraphs.join(got, "source", "left").withColumn("author", F.when(empty, F.coalesce("__a", "author")).otherwise(F.col("author"))).drop("__a")


def pdate_from_path(paragraphs: DataFrame, files: DataFrame) -> DataFrame:
    """paragraphs with pdate, where the file's path holds a year, as its first day."""
    got = files.select(F.col("id").alias("source"), year_of_path("path").alias("__d")).where("__d is not null")
    return paragraphs.join(got, "source", "left").withColumn("pdate", F.coalesce("__d", "pdate")).drop("__d")


def embedding_pending(paragraphs: DataFrame, embeddings: DataFrame, min_length: int = 10) -> DataFrame:
    """Paragraphs longer than min_length without an embedding."""
    return paragraphs.where(F.char_length("content") > min_length).join(embeddings.select("id").distinct(), "id", "left_anti")


def normal_name(c) -> F.col:
    """Without accents, ". " as a blank, white space settled, lower case."""
    t = F.regexp_replace(F.regexp_replace(strip_accents(c), r"\. +", " "), r"\s+", " ")
    return F.lower(F.trim(t))


def same_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right, kind): names that are equal when normalised (MATCH), or word by word equal or initials (POTENTIAL).

    Both kinds are equi-joins: on the normal form, and on the number of words
    with their first letters, which initials share with what they stand for.
    """

    def form(df, side):
        n = normal_name("name")
        w = F.split(n, " ")
        return df.select(F.col("name").alias(side), n.alias(f"n_{side}"), w.alias(f"w_{side}"), F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), " ").alias("letters"))

    pairs = form(left, "left").join(form(right, "right"), "letters")
    near = F.forall(F.arrays_zip("w_left", "w_right"), lambda p: (p["w_left"] == p["w_right"]) | ((F.char_length(p["w_left"]) == 1) & F.startswith(p["w_right"], p["w_left"])) | ((F.char_length(p["w_right"]) == 1) & F.startswith(p["w_left"], p["w_right"])))
    kind = F.when(F.col("n_left") == F.col("n_right"), "MATCH").when((F.size("w_left") > 1) & near, "POTENTIAL")
    return pairs.select("left", "right", kind.alias("kind")).where("kind is not null")


def move_datasets(bridge: DataFrame, old: str, new: str) -> DataFrame:
    """The bridge with data set `old`, and all below it, renamed to `new`."""
    c = F.col("dataset")
    moved = F.when((c == old) | F.startswith(c, F.lit(old + "--")), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 20))).otherwise(c)
    return bridge.withColumn("dataset", moved).distinct()


def choose_datasets(datasets: DataFrame, contains: str = "", regex: str = "") -> DataFrame:
    """Names that hold a string (any case) and meet a pattern (any case)."""
    if contains:
        datasets = datasets.where(F.contains(F.lower("name"), F.lit(contains.lower())))
    return datasets.where(F.col("name").rlike("(?i)" + regex)) if regex else datasets


def export_flat(df: DataFrame) -> DataFrame:
    """One string column a leaf: structs and maps' listed keys dotted, arrays and maps as JSON text."""
    from pyspark.sql import types as T

    def leaves(field, path, c):
        if isinstance(field.dataType, T.StructType):
            return [x for f in field.dataType.fields for x in leaves(f, f"{path}.{f.name}", c[f.name])]
        if isinstance(field.dataType, (T.ArrayType, T.MapType)):
            return [F.to_json(c).alias(path)]
        return [c.cast("string").alias(path)]

    return df.select(*[x for f in df.schema.fields for x in leaves(f, f.name, F.col(f"`{f.name}`"))])


def write_xlsx(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A small table as one sheet, built on the driver; more rows than `most` are refused, not cut."""
    import zipfile
    from xml.sax.saxutils import escape

    rows = export_flat(df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; export them as CSV or JSON")
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v or "")}</t></is></c>'
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [export_flat(df).columns, *rows])
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


def write(df: DataFrame, path: str, kind: str = "json") -> None:
    """csv and json by Spark, in parts; parquet as it is."""
    if kind == "csv":
        export_flat(df).write.option("header", True).csv(path)
    else:
        getattr(df.write, kind)(path)


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the last by order."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_keyword(df: DataFrame, word: str) -> DataFrame:
    return df.where(has("keywords", word))


def resume_pages(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages (path, page) after the last one that `done` (path, source_page) has of their file."""
    last = done.groupBy("path").agg(F.max("source_page").alias("__last"))
    return pages.join(last, "path", "left").where(F.col("page") > F.coalesce("__last", F.lit(-1))).drop("__last")
