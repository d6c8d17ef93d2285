"""Paragraphs that run over pages, as windows over lines.

Lines of all pages of a source are rows in page order. What separates two of
them is a flag of a line and the one before it; paragraphs are running counts of
flags; lengths are running sums, by which long paragraphs are cut at the ends of
sentences. Everything is a column expression: one sort by source, page and line,
another for the sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.pipeline import stage

# fixed values: marks that end a sentence
SENTENCE_ENDS = ".!?。！？…:："
# fixed values: whole lines that belong to the page and not to its text
FURNITURE = [r"\d+", r"\d+\s*of\s*\d+", r"page\s*\d+", r"-\s*\d+\s*-", r"[©®&]\s*\d{4}.*", r"[-—•*]"]


def is_furniture(line: Column) -> Column:
    return (F.char_length(line) <= 100) & line.rlike(f"(?i)^({'|'.join(FURNITURE)})$")


def breaks(before: Column, line: Column) -> Column:
    """Whether a line begins a paragraph: after the end of a sentence if it starts like one, or if short after a long one."""
    starts = line.rlike(r"^[\p{Lu}\x{4E00}-\x{9FFF}]")
    return before.isNull() | (starts & before.rlike(f"[{SENTENCE_ENDS}]$")) | ((F.char_length(before) > 100) & (F.char_length(line) < 20))


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


@stage("CrossPageReparagraphizer")
def cross_page(df: DataFrame, min_paragraph_length: int = 50, max_paragraph_length: int = 2000, short_line_threshold: int = 30, short_line_batch: int = 5) -> DataFrame:
    """(source, source_page, pagenum, content): paragraphs with the page and label they begin on.

    Of lines in a row that are short every short_line_batch-th ends a paragraph.
    A paragraph longer than max_paragraph_length is cut before the sentences that
    begin beyond each multiple of it (within a longer sentence, at ends of lines);
    what is shorter than min_paragraph_length is dropped. Null contents have no lines.
    """
    label = F.col("pagenum") if "pagenum" in df.columns else F.lit(None).cast("string")
    page = F.col("source_page").cast("int")
    tie = F.col("id") if "id" in df.columns else F.md5("content")
    pages = df.select("source", page.alias("source_page"), F.coalesce(label, (F.coalesce(page, F.lit(0)) + 1).cast("string")).alias("pagenum"), tie.alias("tie"), F.posexplode(F.split("content", "\n")).alias("line", "text"))
    lines = pages.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where((F.col("text") != "") & ~is_furniture(F.col("text")))

    order = ["source_page", "tie", "line"]
    w = Window.partitionBy("source").orderBy(*order)
    short = F.char_length("text") < short_line_threshold
    flags = lines.withColumn("begins", breaks(F.lag("text").over(w), F.col("text"))).withColumn("shorts", F.sum(_flag(short)).over(w))
    # short lines in a row: those so far without those before the row began
    before = F.max(F.when(F.col("begins") | ~short, F.col("shorts") - _flag(short))).over(w)
    flags = flags.withColumn("closes", short & ((F.col("shorts") - before) % short_line_batch == 0))
    counted = flags.withColumn("new", F.col("begins") | F.coalesce(F.lag("closes").over(w), F.lit(False))).withColumn("paragraph", F.sum(_flag(F.col("new"))).over(w))

    sentence = F.regexp_extract_all("text", F.lit(f"[^{SENTENCE_ENDS}]*[{SENTENCE_ENDS}]+|[^{SENTENCE_ENDS}]+$"), F.lit(0))
    pieces = counted.select("source", *order[:2], "pagenum", "line", "new", "paragraph", F.posexplode(sentence).alias("piece", "text"))
    order = [*order, "piece"]
    w = Window.partitionBy("source").orderBy(*order)
    size = F.char_length("text") + _flag(F.col("piece") == 0)
    end = F.sum(size).over(w)
    first = F.col("new") & (F.col("piece") == 0)
    opens = first | F.lag("text").over(w).rlike(f"[{SENTENCE_ENDS}]$")
    placed = pieces.withColumn("at", end - size).withColumn("opens", opens)
    base, begun = F.max(F.when(first, F.col("at"))).over(w), F.max(F.when(F.col("opens"), F.col("at"))).over(w)
    at = F.when(F.col("at") - begun > max_paragraph_length, F.col("at")).otherwise(begun) - base
    parts = placed.withColumn("part", F.floor(at / max_paragraph_length))

    text = F.concat(F.when(F.col("piece") == 0, " ").otherwise(""), F.col("text")).alias("text")
    whole = parts.groupBy("source", "paragraph", "part").agg(F.array_sort(F.collect_list(F.struct(*order, "pagenum", text))).alias("p"))
    content = F.regexp_replace(F.array_join(F.transform("p", lambda x: x["text"]), ""), r"^\s+|\s+$", "")
    done = whole.select("source", F.col("p")[0]["source_page"].alias("source_page"), F.col("p")[0]["pagenum"].alias("pagenum"), content.alias("content"))
    return done.where(F.char_length("content") >= min_paragraph_length)
