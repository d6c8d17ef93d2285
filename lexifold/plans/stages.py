"""Reducers, sources, sinks and outside services as pipeline stages.

Source stages ignore the rows they are given unless they read a field of them;
outside services take their transport, a function of a list of requests, from
the context's constants under "transport:<stage name>".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import unit
from ..operators import bibliography, counts, external, graph, learning, library, ordered, pages, records, snapshots, vectors  # noqa: F401
from ..sources import html, paged, readers
from . import search
from .pipeline import Context, stage

# reducers


@stage("Counter")
def _counter(df: DataFrame, key: str) -> DataFrame:
    """Rows of each value."""
    return counts.counter(df, key)


@stage("NgramCounter")
def _ngrams(df: DataFrame, n: int, lr: bool = False, ctx: Context = None) -> DataFrame:
    """Character runs up to n; with lr also their neighbours, kept as ngram_lefts and ngram_rights."""
    if lr and ctx is not None:
        ctx.named["ngram_lefts"], ctx.named["ngram_rights"] = counts.ngram_neighbours(df, n)
    return counts.ngrams(df, n + 2 if lr else n)


@stage("TermFreq")
def _term_freq(df: DataFrame, field: str = "tokens") -> DataFrame:
    """Occurrences and records of each token, the most frequent first."""
    return counts.term_freq(df, field).orderBy(F.col("n").desc(), "term")


@stage("TFIDFWordFetch")
def _tfidf(df: DataFrame, min_df: float = 0.0, field: str = "tokens") -> DataFrame:
    """Tokens by tf-idf, the greatest first."""
    return counts.tfidf(df, field, min_df).orderBy(F.col("score").desc(), "term")


@stage("PMILREntropyWordFetcher")
def _pmi(df: DataFrame, max_len: int = 4, min_freq: float = 0.0001, min_pmi: float = 1.0, min_entropy: float = 1.0, stop: str = "[a-zA-Z0-9一二三四五六七八九十]") -> DataFrame:
    """Words found by cohesion and neighbour entropy, the most frequent first."""
    return counts.pmi_words(df, max_len, min_freq, min_pmi, min_entropy, stop).orderBy(F.col("n").desc(), "word")


@stage("WordsBagVectorize")
def _bag(df: DataFrame, dims: int = 100000, field: str = "tokens") -> DataFrame:
    """vec: a sparse count vector."""
    return df.join(counts.bag_of_words(df, dims, field), "id", "left")


@stage("GenerateCooccurance")
def _cooccurrence(df: DataFrame, method: str = "token", field: str = "tokens", threshold: float = 0.0, max_tokens: int = 0) -> DataFrame:
    """Edges (a, b, w): token pairs of records, or cosines of all pairs of vectors."""
    if method == "vec_cos":
        return vectors.pairwise_cosine(df.select("id", F.col(field).alias("v")), threshold).withColumnRenamed("cosine", "w")
    return counts.cooccurrence(df, field, max_tokens).withColumnRenamed("n", "w")


@stage("GraphicClustering")
def _graph(df: DataFrame, topk: int = 1000) -> DataFrame:
    """Components of the heaviest edges (a, b, w)."""
    return graph.components(graph.top_edges(df, topk))


@stage("CosSimClustering")
def _cos_clusters(df: DataFrame, min_community_size: int = 10, threshold: float = 0.75, field: str = "vec") -> DataFrame:
    """cluster: the component of vectors at least as similar as the threshold, -1 for small ones."""
    found = graph.clusters(vectors.pairwise_cosine(df.select("id", F.col(field).alias("v")), threshold), min_community_size)
    alone = F.col("id") if min_community_size <= 1 else F.lit(-1)
    return df.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("cluster", F.coalesce("cluster", alone))


@stage("CosSimFSClassifier")
def _few_shot(df: DataFrame, label: str = "label", field: str = "vec", auto_update: bool = False, ctx: Context = None) -> DataFrame:
    """label of unlabelled rows by the nearest centroid; with auto_update each row then counts for its centroid, in order."""
    if auto_update:
        order = [c for c in (ctx.order if ctx else Context().order) if c in df.columns]
        return ordered.classify_online(df, label, field, order)
    known = F.coalesce(F.col(label).cast("string"), F.lit("")) != ""
    rows = df.withColumn("__known", known)
    code = rows.where("__known").select(label).distinct()
    codes = code.select(label, F.xxhash64(label).alias("__code"))
    shots = rows.where("__known").join(codes, label).select(F.col("__code").alias("label"), F.col(field).alias("v"))
    got = vectors.classify(rows.where("not __known").select("id", F.col(field).alias("v")), shots).select("id", F.col("label").alias("__code"))
    named = got.join(codes.withColumnRenamed(label, "__label"), "__code", "left").select("id", "__label")
    return rows.join(named, "id", "left").withColumn(label, F.when(F.col("__known"), F.col(label)).otherwise(F.coalesce("__label", F.lit("")))).drop("__known", "__label")


@stage("KmeansClustering")
def _kmeans(df: DataFrame, k: int = 10, field: str = "vec") -> DataFrame:
    """cluster, x, y."""
    return df.join(learning.kmeans(df.select("id", F.col(field).alias("v")), k), "id")


@stage("LDA")
def _lda(df: DataFrame, num_topics: int = 10, field: str = "tokens", ctx: Context = None) -> DataFrame:
    """topic of each row; the topics' terms are kept as lda_topics."""
    rows, topics = learning.topics(df, num_topics, field)
    if ctx is not None:
        ctx.named["lda_topics"] = topics
    return df.join(rows, "id")


@stage("DrawClusters")
def _scatter(df: DataFrame, notation: str = "id") -> DataFrame:
    return learning.scatter(df, notation)


# sources


@stage("TextDataSource")
def _text(df: DataFrame, content: str, dataset_name: str = "", lang: str = "auto") -> DataFrame:
    return readers.text_lines(df.sparkSession, content, dataset_name, lang)


def _defaults(df: DataFrame, **values) -> DataFrame:
    """A record's own fields come before the stage's arguments, which fill what is missing or null."""
    for name, value in values.items():
        own = F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
        df = df.withColumn(name, own)
    return df


@stage("LinesDataSource")
def _lines(df: DataFrame, content: str = "", delimiter: str = "\n", dataset_name: str = "", lang: str = "auto") -> DataFrame:
    """The parts of `content`; without it those of each record's content, with the record's other fields."""
    if not content:
        return _defaults(readers.lines_of(df, delimiter), dataset_name=dataset_name, lang=lang)
    return readers.inline_lines(df.sparkSession, content, delimiter, dataset_name, lang)


@stage("FilePatternDataSource")
def _patterns(df: DataFrame, content: str) -> DataFrame:
    return readers.file_list(df.sparkSession, content)


@stage("BiblioDataSource")
def _biblio(df: DataFrame, content: str, input_format: str = "endnote") -> DataFrame:
    """Records of reference files: endnote or bibtex."""
    texts = df.sparkSession.read.text(readers.globs(content), wholetext=True).withColumnRenamed("value", "content")
    return bibliography.parse_bibtex(texts) if input_format == "bibtex" else readers.endnote(texts)


@stage("JSONDataSource")
def _json(df: DataFrame, content: str = "") -> DataFrame:
    """The records of a JSON text; without it those of each record's content."""
    return readers.json_records(df.sparkSession.range(1).select(F.lit(content).alias("content")) if content else df)


@stage("ExcelDataSource")
def _excel(df: DataFrame, content: str) -> DataFrame:
    return readers.office_files(df.sparkSession, content, "xlsx")


@stage("WordDataSource")
def _word(df: DataFrame, content: str) -> DataFrame:
    return readers.office_files(df.sparkSession, content, "docx")


@stage("WebPageListingDataSource")
def _listing(df: DataFrame, content: str, scopes: str = "", list_link: str = ".*", detail_link: str = ".*", list_depth: int = 1) -> DataFrame:
    """Pages (url, html) reached from the addresses in content: url, depth, title and text."""
    found = html.crawl(df, readers.globs(content), list_depth, scopes, list_link, detail_link)
    return found.join(df.select("url", "html"), "url").select("url", "depth", html.title("html").alias("outline"), html.plain(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " ")).alias("content"))


@stage("DBQueryDataSource")
def _db_query(
    df: DataFrame, query: str = "", limit: int = 0, skip: int = 0, sort: str = "", groups: str = "", datasets: list = (), sources: list = (), langs: list = (), authors: list = (), outlines: list = (), ids: list = (),
    source_page: int = 0, has_embedding: bool = None, vector: list = (), ctx: Context = None,
) -> DataFrame:
    """A search over the context's tables paragraphs and, where known, files, file_datasets, embeddings and keyword_index.

    groups: a column, of whose values the first row each is taken, or none. All
    filters of a search can be given; lists as text have a value a line.
    """
    tables = search.Tables(ctx.named["paragraphs"], *(ctx.named.get(x) for x in ("files", "file_datasets", "embeddings", "keyword_index")))
    lists = {k: tuple(v) for k, v in (("datasets", datasets), ("sources", sources), ("langs", langs), ("authors", authors), ("outlines", outlines), ("ids", ids), ("vector", vector))}
    return search.search(tables, search.Filters(q=query, limit=limit, offset=skip, sort=sort, group_by="" if groups == "none" else groups, source_page=source_page, has_embedding=has_embedding, **lists))


@stage("CalibreDataSource")
def _books(df: DataFrame, content: str = "", dataset_name: str = "", lang: str = "auto", formats: str = "epub,pdf", ctx: Context = None) -> DataFrame:
    """Records of the books of a library, whose tables the context holds as library:<table>; content: its folder."""
    tables = {k.removeprefix("library:"): v for k, v in ctx.named.items() if k.startswith("library:")}
    rows = library.book_records(tables, [x.strip() for x in formats.lower().split(",")], content.rstrip("/"))
    return rows.withColumn("dataset", F.lit(dataset_name)).withColumn("lang", F.lit(lang))


@stage("PDFDataSource")
def _pdf(df: DataFrame, page_range: str = "", dataset_name: str = "", lang: str = "auto", clean: bool = False, remove_garbled: bool = True, reparagraph: bool = False, min_paragraph_length: int = 50, max_paragraph_length: int = 2000, ctx: Context = None) -> DataFrame:
    """Pages of documents (path, content binary); known pages of `pdf_done` in the context are left out.

    In this order, as asked for: texts are cleaned (and garbled pages dropped),
    paragraphs are made of the lines of all pages, and with lang "auto" the
    language of each row is told.
    """
    rows = readers.pdf_pages(df, ctx.constants["transport:PDFDataSource"], ctx.named.get("pdf_done"), page_range)
    if clean:
        rows = records.text_cleaner(rows, remove_garbled)
    if reparagraph:
        rows = pages.cross_page(rows, min_paragraph_length, max_paragraph_length)
    rows = rows.withColumn("dataset_name", F.lit(dataset_name)).withColumn("lang", F.lit(lang))
    return records.language_detect(rows, ctx) if lang == "auto" else rows


@stage("MinerUDataSource")
def _mineru(df: DataFrame, ctx: Context = None) -> DataFrame:
    """Sections of documents that the transport turns into Markdown."""
    asked = external.map_batches(df, "path", "content", ctx.constants["transport:MinerUDataSource"], on_error="raise")
    return readers.markdown_sections(asked)


@stage("ZoteroDataSource")
def _zotero(df: DataFrame, total: int, limit: int = 100, ctx: Context = None) -> DataFrame:
    return readers.zotero_items(readers.paged(df.sparkSession, ctx.constants["transport:ZoteroDataSource"], total, limit))


@stage("AMapCityCodeQuery")
def _city(df: DataFrame, content: str) -> DataFrame:
    return readers.any_cell_contains(df, content)


@stage("ExtractHTMLParagraphs")
def _extract(df: DataFrame, field: str = "html", assignments: dict = None, paragraph_selector: str = "") -> DataFrame:
    return html.extract(df, field, assignments or {"content": ""}, paragraph_selector)


@stage("RecordDataSource")
def _record_source(df: DataFrame, source: str, fields: str = "", params: dict = None, ctx: Context = None) -> DataFrame:
    """What the context's function source:<source> fetches for each record; the record's fields come before params."""
    return paged.of_records(df, ctx.constants[f"source:{source}"], fields, params)


# sinks


@stage("SaveParagraph")
def _save(df: DataFrame, path: str, existing: str = "") -> DataFrame:
    """The snapshot of `existing` with these rows, written to path."""
    old = df.sparkSession.read.parquet(existing) if existing else df.limit(0)
    snapshots.save_paragraphs(old, df).write.parquet(path)
    return df.sparkSession.read.parquet(path)


@stage("DeleteParagraph")
def _delete(df: DataFrame, path: str, existing: str) -> DataFrame:
    """The snapshot of `existing` without the ids of these rows, written to path."""
    snapshots.delete(df.sparkSession.read.parquet(existing), df).write.parquet(path)
    return df.sparkSession.read.parquet(path)


@stage("Export")
def _export(df: DataFrame, path: str, output_format: str = "csv") -> DataFrame:
    if output_format == "xlsx":
        snapshots.write_xlsx(df, path)
    else:
        snapshots.write(df, path, output_format)
    return df


@stage("BibItemSave")
def _bib_save(df: DataFrame, path: str, existing: str) -> DataFrame:
    bibliography.save_items(df.sparkSession.read.parquet(existing), df).write.parquet(path)
    return df.sparkSession.read.parquet(path)


@stage("BibItemDeduplicate")
def _bib_dedup(df: DataFrame, keep: str = "latest", fields: list = ("publisher",), tags: list = ("tags",), by: str = "modified") -> DataFrame:
    return bibliography.merge_duplicates(df, list(fields), list(tags), keep=keep, by=by)


# outside services


def _ask(df, request, name, ctx, field, answer=None, kind=None, on_error="text"):
    asked = external.map_batches(df.withColumn("__request", request), "__request", field, ctx.constants[f"transport:{name}"], kind, on_error=on_error).drop("__request")
    return asked.withColumn(field, F.when(F.startswith(field, F.lit("Error: ")), F.col(field)).otherwise(answer(F.col(field)))) if answer else asked


def _chat(name, style):
    def f(df: DataFrame, model: str = "", system_prompt: str = "", temperature: float = 0.7, max_tokens: int = 1000, result_field: str = "llm_response", ctx: Context = None) -> DataFrame:
        request = external.chat_request("content", model, system_prompt, temperature, max_tokens, style)
        return _ask(df, request, name, ctx, result_field, lambda c: external.chat_answer(c, style))

    f.__doc__ = f"Completions in {style} form; a failure's text stands in the field."
    stage(name)(f)


for _name, _style in (("OpenAILikeCompletion", "openai"), ("ClaudeCompletion", "claude"), ("OllamaCompletion", "ollama")):
    _chat(_name, _style)


def _search(name, style):
    def f(df: DataFrame, search_fields: list = ("content",), result_field: str = "search_results", ctx: Context = None) -> DataFrame:
        return _ask(df, external.search_request("content", list(search_fields), style), name, ctx, result_field, on_error="null")

    f.__doc__ = "Answers of a search service; a failure leaves the field empty."
    stage(name)(f)


for _name, _style in (("AzureCognitiveSearch", "azure"), ("TencentCloudSearch", "tencent"), ("AWSCloudSearch", "aws")):
    _search(_name, _style)


def _translate(name, request, most: int, joiner: str = " "):
    def f(df: DataFrame, to_lang: str = "en", ctx: Context = None) -> DataFrame:
        constants = ctx.constants if ctx else {}
        asked = df.withColumn("__requests", F.transform(external.split_chunks("content", most), lambda c: request(c, to_lang, constants)))
        done = external.map_parts(asked, "__requests", "content", constants[f"transport:{name}"], joiner).select(*df.columns)
        if to_lang not in ("zhs", "zht"):
            return done
        from ..operators.phrases import Phrases

        # services answer in either script: the one asked for is made by a table, the context's where it has one
        table = ctx.named.get("traditional" if to_lang == "zhs" else "simplified")
        if table is None:
            pairs = dict(records.SIMPLIFIED.split())
            table = pairs if to_lang == "zhs" else {v: k for k, v in pairs.items()}
        return Phrases(df.sparkSession, table).replaced(done, "content")

    f.__doc__ = f"content in another language, asked for in pieces of at most {most} characters; a row that can't be translated is dropped."
    stage(name)(f)


def _body(**fields):
    return F.to_json(F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in fields.items()]))


_translate("RemoteTranslation", lambda t, to, c: _body(text=t, to_lang=to), 5000)
_translate("GoogleTranslation", lambda t, to, c: _body(q=t, target=to), 5000)
_translate("YoudaoTranslation", lambda t, to, c: _body(q=t, to=to, sign=external.sign_sha256(t, c.get("app", ""), c.get("salt", ""), c.get("time", ""), c.get("secret", ""))), 5000)
_translate("BaiduTranslation", lambda t, to, c: _body(q=t, to=to, sign=external.sign_md5(t, c.get("app", ""), c.get("salt", ""), c.get("secret", ""))), 2000)


@stage("GPTTranslation")
def _gpt(df: DataFrame, prompt: str = "{content}", test: bool = False, ctx: Context = None) -> DataFrame:
    """content by a prompt with {field}s; with test the prompt itself."""
    return df.withColumn("content", external.prompt(prompt)) if test else _ask(df, external.prompt(prompt), "GPTTranslation", ctx, "content", on_error="drop")


_NER = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType())]))


@stage("AutoNER")
def _ner(df: DataFrame, ctx: Context = None) -> DataFrame:
    """ner: array<struct<text,label>> by the transport of the row's language ("transport:AutoNER:<lang>", else "transport:AutoNER")."""
    langs = [k.split(":")[2] for k in ctx.constants if k.startswith("transport:AutoNER:")]
    out = None
    for lang in [*langs, None]:
        rows = df.where(F.col("lang") == lang) if lang else df.where(~F.coalesce(F.col("lang").isin(*langs), F.lit(False))) if langs else df
        f = ctx.constants.get(f"transport:AutoNER:{lang}" if lang else "transport:AutoNER")
        part = external.map_batches(rows, "content", "ner", f, _NER, on_error="null") if f else rows.withColumn("ner", F.lit(None).cast(_NER))
        out = part if out is None else out.unionByName(part)
    return out


def _named_ner(name):
    def f(df: DataFrame, ctx: Context = None) -> DataFrame:
        if transport := ctx.constants.get(f"transport:{name}"):
            return external.map_batches(df, "content", "ner", transport, _NER, on_error="null")
        return records.gazetteer(df, ctx=ctx)

    f.__doc__ = "ner by the stage's transport, or without one by the context's gazetteer."
    stage(name)(f)


for _name in ("HanLPModel", "HanlpNerZh", "HanlpNerJa", "SpaCyNER"):
    _named_ner(_name)


@stage("TextEmbedding")
def _embedding(df: DataFrame, field: str = "vec", ctx: Context = None) -> DataFrame:
    """A vector of content by the transport, unit length."""
    got = external.map_batches(df, "content", field, ctx.constants["transport:TextEmbedding"], T.ArrayType(T.DoubleType()), on_error="raise")
    return got.withColumn(field, unit(field))


def _places(name, rule):
    def f(df: DataFrame, field: str = "location", ctx: Context = None) -> DataFrame:
        return _ask(df, rule(F.col("content")), name, ctx, field, on_error="null")

    f.__doc__ = "What a map service answers for content; a failure leaves the field empty."
    stage(name)(f)


for _name in ("AMapGeoCode", "BingMapGeoCode", "AMapPOISearch"):
    _places(_name, lambda c: c)
_places("OSMPOISearch", lambda c: F.array_join(F.flatten(F.transform(F.split(c, r"\s+"), readers.tag_guesses)), " "))
