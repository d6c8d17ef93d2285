"""HTML: fields by tag inside the JVM, general selectors by a streaming parser, and crawling over a page table."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..operators.graph import written
from ..ship import ship

# fixed values: named entities that are replaced
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def plain(c) -> Column:
    """Text without tags, entities replaced, white space settled."""
    t = F.regexp_replace(col(c), r"(?s)<[^>]*>", " ")
    for a, b in ENTITIES.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def inner(html, tag: str) -> Column:
    """array: what stands between each opening tag of that name and the next closing one."""
    return F.regexp_extract_all(col(html), F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"), F.lit(1))


def title(html) -> Column:
    return plain(F.get(inner(html, "title"), 0))


def paragraphs_of(html) -> Column:
    """array of the plain texts of p elements that aren't empty."""
    return F.filter(F.transform(inner(html, "p"), plain), lambda x: x != "")


def links(html) -> Column:
    """array of the href values of a elements, in order."""
    return F.regexp_extract_all(col(html), F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))


def resolve_link(base, href) -> Column:
    """An absolute address without its fragment: of an absolute, host-relative or path-relative link."""
    b, h = col(base), F.regexp_replace(col(href), "#.*$", "")
    host = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    path = F.regexp_extract(F.regexp_replace(b, "[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+(/.*)?$", 1)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    return (
        F.when(h == "", F.regexp_replace(b, "#.*$", "")).when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(F.startswith(h, F.lit("//")), F.concat(scheme, h)).when(F.startswith(h, F.lit("/")), F.concat(host, h)).otherwise(F.concat(host, folder, h))
    )


def crawl(pages: DataFrame, start: list[str], depth: int, scope: str = "", list_link: str = ".*", detail_link: str = ".*") -> DataFrame:
    """(url, depth): pages reached from the start over links, breadth first, each at its least depth.

    pages: url, html. Links must begin with scope; those that meet list_link
    lead on, those that meet detail_link are results. Of pages with one address
    that with the least text counts. The table of links is written once, and what
    a round has found is written before the next one, so that no round does the
    work of those before it again; it ends when a round finds nothing.
    """
    spark = pages.sparkSession
    known = pages.select(F.regexp_replace("url", "#.*$", "").alias("url"), "html").groupBy("url").agg(F.min("html").alias("html"))
    out = known.select("url", F.explode(links("html")).alias("h")).select("url", resolve_link("url", "h").alias("to"))
    leads = F.col("to").rlike(list_link) | F.col("to").rlike(detail_link)
    # links to pages there are, that can be followed at all
    out = written(out.where(F.startswith("to", F.lit(scope)) & leads).distinct().join(known.select(F.col("url").alias("to")), "to", "left_semi"))
    seen = spark.createDataFrame([(u,) for u in start], "url string").withColumn("depth", F.lit(0)).join(known.select("url"), "url", "left_semi")
    frontier = seen
    for d in range(1, depth + 1):
        found = frontier.select("url").join(out, "url").select(F.col("to").alias("url")).distinct().join(seen, "url", "left_anti")
        found = written(found.withColumn("depth", F.lit(d)))
        if found.isEmpty():
            break
        seen = seen.unionByName(found)
        frontier = found.where(F.col("url").rlike(list_link))
    return seen.where(F.col("url").rlike(detail_link) | (F.col("depth") == 0))


class _Select(HTMLParser):
    """Texts, inner HTML and attributes of the elements that simple selectors choose: tag, .class, #id, [attr], and blanks for descent."""

    VOID = set("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, selector: str):
        super().__init__(convert_charrefs=True)
        self.steps = [self._step(s) for s in selector.split()]
        self.stack: list = []
        self.found: list = []
        self.skip = 0

    @staticmethod
    def _step(s):
        import re

        tag = re.match(r"[\w*-]*", s)[0]
        return tag if tag not in ("", "*") else None, re.findall(r"\.([\w-]+)", s), re.findall(r"#([\w-]+)", s), re.findall(r"\[([\w-]+)(?:=[\"']?([^\]\"']*)[\"']?)?\]", s)

    def _fits(self, step, tag, attrs):
        name, classes, ids, wanted = step
        own = (attrs.get("class") or "").split()
        return (name is None or name == tag) and all(c in own for c in classes) and all(attrs.get("id") == i for i in ids) and all(a in attrs and (not v or attrs[a] == v) for a, v in wanted)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        for e in self.found:
            if e["open"]:
                e["html"].append(self.get_starttag_text())
        level = self.stack[-1][1] if self.stack else 0
        hit = False
        if level < len(self.steps) and self._fits(self.steps[level], tag, attrs):
            level += 1
            hit = level == len(self.steps)
        elif level == len(self.steps) and self._fits(self.steps[-1], tag, attrs):
            hit = True
        element = {"text": [], "html": [], "attrs": attrs, "open": True} if hit else None
        if element:
            self.found.append(element)
        if tag in ("script", "style"):
            self.skip += 1
        if tag in self.VOID:
            if element:
                element["open"] = False
        else:
            self.stack.append((tag, level, element))

    def handle_endtag(self, tag):
        if tag not in [t for t, _, _ in self.stack]:
            return
        while self.stack:
            t, _, element = self.stack.pop()
            if t in ("script", "style"):
                self.skip = max(0, self.skip - 1)
            if element:
                element["open"] = False
            if t == tag:
                break
        for e in self.found:
            if e["open"]:
                e["html"].append(f"</{tag}>")

    def handle_data(self, data):
        for e in self.found:
            if e["open"]:
                e["html"].append(data)
                if not self.skip:
                    e["text"].append(data)


def select(html: str, selector: str, attr: str = "text") -> list[str]:
    """Of each chosen element its text, its html, or an attribute."""
    p = _Select(selector)
    p.feed(html or "")
    p.close()
    if attr == "text":
        return [" ".join("".join(e["text"]).split()) for e in p.found]
    if attr == "html":
        return ["".join(e["html"]) for e in p.found]
    return [e["attrs"][attr] for e in p.found if e["attrs"].get(attr) is not None]


def extract(df: DataFrame, field: str, assignments: dict, paragraph_selector: str = "") -> DataFrame:
    """df with fields from HTML: name -> "selector//attr" (text by default), one row for each element of paragraph_selector.

    Several hits are joined: content by line ends, keywords stay a list, others by blanks.
    """
    ship(df.sparkSession)
    rules = {k: (v.split("//", 1) + ["text"])[:2] for k, v in assignments.items()}
    keep = [c for c in df.columns if c not in rules]
    from pyspark.sql import types as T

    schema = T.StructType([*df.select(*keep).schema.fields, *[T.StructField(k, T.ArrayType(T.StringType()) if k == "keywords" else T.StringType()) for k in rules]])

    def run(batches):
        for batch in batches:
            index, values = [], {k: [] for k in rules}
            for i, html in enumerate(batch.column(field).to_pylist()):
                for part in select(html, paragraph_selector, "html") if paragraph_selector else [html or ""]:
                    index.append(i)
                    for k, (selector, attr) in rules.items():
                        got = select(part, selector, attr) if selector else [" ".join("".join(select(f"<x>{part}</x>", "x")).split())]
                        values[k].append(got if k == "keywords" else ("\n" if k == "content" else " ").join(got))
            rows = batch.select(keep).take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(v, pa.list_(pa.string()) if k == "keywords" else pa.string()) for k, v in values.items()]], [*keep, *rules])

    return df.mapInArrow(run, schema)


def cached(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """pages (url) with html where the cache (key = sha1 of the address, html) has it; null means: still to fetch."""
    return pages.withColumn("key", F.sha1(F.col("url").cast("binary"))).join(cache.select("key", "html"), "key", "left")
