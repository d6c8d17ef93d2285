"""Record schemas and the folding of unknown fields into the open map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAGRAPH = (
    "id string, source string, source_page int, author string, pdate timestamp_ntz, outline string, content string, "
    "pagenum string, lang string, extdata map<string,string>, keywords array<string>"
)
FILE_METADATA = "id string, path string, extension string, size_bytes bigint, extdata map<string,string>, created_at timestamp, modified_at timestamp"
FILE_DATASET = "dataset_id string, file_id string"
DATASET = "id string, order_weight int, name string, tags array<string>"
TERMS = "term string"
TEXT_EMBEDDINGS = "id string, source string, chunk_id int, embedding array<float>"
HISTORY = "id string, user string, queries string, created_at timestamp"
TASK = "id string, name string, pipeline string, concurrent int, resume_next boolean"
BIB_ITEM = (
    "id string, item_type string, title string, authors array<string>, abstract_note string, publication string, date timestamp_ntz, volume string, "
    "issue string, pages string, doi string, url string, isbn string, issn string, archive string, archive_location string, library_catalog string, "
    "call_number string, language string, short_title string, series string, series_title string, publisher string, place string, cover string, "
    "notes string, tags array<string>, related string, file_attachments array<string>, extra map<string,string>, modified timestamp_ntz"
)

CORE = [f.strip().split(" ")[0] for f in PARAGRAPH.replace("map<string,string>", "map").split(",")]
UUID = r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def clean_content(content) -> Column:
    """NUL characters are dropped."""
    return F.replace(F.col(content) if isinstance(content, str) else content, F.lit("\x00"), F.lit(""))


def clean_keywords(keywords) -> Column:
    """Trimmed, lower-cased, without empty or repeated ones; sorted, as their order has no meaning."""
    k = F.col(keywords) if isinstance(keywords, str) else keywords
    return F.array_sort(F.array_distinct(F.filter(F.transform(k, lambda x: F.lower(F.trim(x))), lambda x: F.coalesce(x != "", F.lit(False)))))


def fold_extra(df: DataFrame) -> DataFrame:
    """The paragraph table of df: known columns as they are, all others as entries of extdata.

    A null field gives no entry. Entries of an extdata column that is already
    there lose to a column of the same name.
    """
    known = [c for c in CORE if c != "extdata"]
    other = [c for c in df.columns if c not in CORE and c != "dataset_name"]
    types = dict(x.strip().split(" ", 1) for x in PARAGRAPH.replace("map<string,string>", "map<string;string>").split(","))
    text = lambda c: F.col(f"`{c}`").cast("string") if not dict(df.dtypes)[c].startswith(("array", "struct", "map")) else F.to_json(f"`{c}`")
    empty = F.create_map().cast("map<string,string>")
    extra = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("key"), text(c).alias("value")) for c in other]), lambda e: e["value"].isNotNull())) if other else empty
    if "extdata" in df.columns:
        names = F.array(*[F.lit(c) for c in other]) if other else F.array().cast("array<string>")
        old = F.map_filter(F.coalesce("extdata", empty), lambda k, v: ~F.array_contains(F.filter(names, lambda n: F.map_contains_key(extra, n)), k)) if other else F.coalesce("extdata", empty)
        extra = F.map_concat(old, extra)
    cols = [(F.col(c) if c in df.columns else F.lit(None)).cast(types[c].replace(";", ",")).alias(c) for c in known]
    return df.select(*cols, extra.alias("extdata")).select(*CORE)
