"""Stages that work on each record: all are column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, dates, geo, text
from ..plans.expressions import compile_condition, compile_value
from ..plans.pipeline import Context, stage


@stage("Passthrough")
def passthrough(df: DataFrame) -> DataFrame:
    return df


@stage("FilterOut")
def filter_out(df: DataFrame, cond: str = "true", ctx: Context = None) -> DataFrame:
    """Rows that meet cond go."""
    return df.where(~compile_condition(df, cond, ctx.variables if ctx else None))


@stage("FieldAssignment")
def field_assign(df: DataFrame, field: str, value: str = "", delete_field: bool = False, ctx: Context = None) -> DataFrame:
    """field gets the value of an expression, or is removed: as a column, or from extdata."""
    if delete_field:
        if field in df.columns:
            return df.drop(field)
        return df.withColumn("extdata", F.map_filter("extdata", lambda k, v: k != field)) if "extdata" in df.columns else df
    return df.withColumn(field, compile_value(df, value, ctx.variables if ctx else None))


@stage("FieldIncresement")
def field_increment(df: DataFrame, field: str, inc_value: str = "1", ctx: Context = None) -> DataFrame:
    """field plus an expression; strings and arrays are joined."""
    return df.withColumn(field, compile_value(df, f"{field} + ({inc_value})", ctx.variables if ctx else None))


@stage("ConditionalAssignment")
def conditional_assign(df: DataFrame, cond: str, field: str, ctx: Context = None) -> DataFrame:
    """field by the first line `condition => value` that holds; else it stays."""
    out: Column | None = None
    names = ctx.variables if ctx else None
    for line in filter(None, (x.strip() for x in cond.split("\n"))):
        test, value = line.split("=>", 1)
        test, value = compile_condition(df, test, names), compile_value(df, value, names)
        out = F.when(test, value) if out is None else out.when(test, value)
    keep = F.col(field) if field in df.columns else F.lit(None)
    return df.withColumn(field, out.otherwise(keep) if out is not None else keep)


@stage("ArrayField")
def array_field(df: DataFrame, field: str, push: bool = True, elements: str = "", ctx: Context = None) -> DataFrame:
    """Elements (an expression, or lines of them) are put behind an array, or their first occurrences taken out."""
    names = ctx.variables if ctx else None
    out = F.col(field) if field in df.columns else F.array().cast("array<string>")
    for line in filter(None, (x.strip() for x in elements.split("\n"))):
        v = compile_value(df, line, names)
        out = arrays.push(out, v) if push else arrays.remove_first(out, v)
    return df.withColumn(field, out)


@stage("ArrayAggregation")
def array_flatten(df: DataFrame, field: str, new_field: str = "") -> DataFrame:
    """One level of nesting less."""
    return df.withColumn(new_field or field, F.flatten(field))


@stage("KeywordsReplacement")
def keyword_replace(df: DataFrame, from_tag: str, to_tag: str, arr: str = "keywords") -> DataFrame:
    return df.withColumn(arr, arrays.replace_keyword(arr, from_tag, to_tag))


@stage("RegexReplace")
def regex_replace(df: DataFrame, pattern: str, replacement: str = "", plain: bool = False) -> DataFrame:
    return df.withColumn("content", F.replace("content", F.lit(pattern), F.lit(replacement)) if plain else F.regexp_replace("content", pattern, re.sub(r"\\(\d)", r"$\1", replacement)))


def _formatted(source: str, pattern: str, match: str) -> Column:
    """match with {0}, {1} .. as the groups of the first match."""
    parts = re.split(r"\{(\d+)\}", match)
    out = [F.lit(p) if i % 2 == 0 else F.regexp_extract(source, pattern, int(p)) for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*out) if out else F.lit("")


@stage("RegexFilter")
def regex_filter(df: DataFrame, pattern: str, target: str, source: str = "content", match: str = "{0}", continuous: bool = False, filter_out: bool = False, ctx: Context = None) -> DataFrame:
    """target from the first match; without one the value before it in order (continuous), or the row goes (filter_out).

    Before the first match the carried value is "".
    """
    hit = F.coalesce(F.col(source).rlike(pattern), F.lit(False))
    value = F.when(hit, _formatted(source, pattern, match))
    if continuous:
        order = [c for c in (ctx.order if ctx else Context().order) if c in df.columns]
        by = "source" if "source" in df.columns else F.lit(0)
        w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(target, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit("")))
    if filter_out:
        return df.where(hit).withColumn(target, _formatted(source, pattern, match))
    return df.withColumn(target, F.coalesce(value, F.col(target) if target in df.columns else F.lit(None)))


@stage("RegexMatches")
def regex_matches(df: DataFrame, regex: str, field: str = "content") -> DataFrame:
    """One row for each match: the whole of it, its one group, or an array of its groups."""
    groups = re.compile(regex).groups
    if groups < 2:
        return df.withColumn(field, F.explode(F.regexp_extract_all(field, F.lit(regex), F.lit(groups))))
    zipped = F.arrays_zip(*[F.regexp_extract_all(field, F.lit(regex), F.lit(i + 1)).alias(f"g{i}") for i in range(groups)])
    return df.withColumn(field, F.explode(F.transform(zipped, lambda s: F.array(*[s[f"g{i}"] for i in range(groups)]))))


@stage("SplitParagraph")
def split_paragraph(df: DataFrame, delimeter: str = "\n") -> DataFrame:
    """One row for each part that isn't empty. The delimiter is taken literally."""
    return df.withColumn("content", F.explode(F.filter(F.split("content", r"\Q" + delimeter + r"\E"), lambda x: x != "")))


@stage("FilterPunctuations")
def filter_punctuations(df: DataFrame) -> DataFrame:
    return df.withColumn("content", text.filter_punctuation("content"))


def _guessed(df: DataFrame, ctx: Context | None):
    """(df with __guess and __share, the language): by script, else by the context's table language_model, else by common words."""
    from . import bayes

    model = ctx.named.get("language_model") if ctx else None
    df, n = text.with_script_counts(df)
    script = text.script_language("content", n)
    if model is None:
        df = df.withColumn("__guess", text.detect_language("content")).withColumn("__share", F.lit(None).cast("double"))
    else:
        df = bayes.LANGUAGES.score(df, model, "content", "__guess", "__share")
    share = F.coalesce(text.script_share("content", n), F.col("__share"), F.lit(0.5))
    return df, F.coalesce(script, F.col("__guess"), F.lit("en")), share, [f"__n_{k}" for k in n]


@stage("LanguageDetect")
def language_detect(df: DataFrame, ctx: Context = None) -> DataFrame:
    """lang where it is empty or "auto": by script, and for other texts by likelihood (see bayes; the model is the context's table language_model)."""
    columns = df.columns
    df, found, _, _ = _guessed(df, ctx)
    known = F.col("lang").isNotNull() & ~F.col("lang").isin("", "auto")
    return df.withColumn("lang", F.when(known, F.col("lang")).otherwise(found)).select(*columns)


@stage("PDFLanguageDetect")
def pdf_language_detect(df: DataFrame, ctx: Context = None) -> DataFrame:
    """lang as in LanguageDetect; lang_confidence: the share of the script's characters, or of the language's likelihood (0.5 without a model)."""
    df, found, share, n = _guessed(df, ctx)
    return df.withColumn("lang_confidence", share).withColumn("lang", found).drop("__guess", "__share", *n)


# fixed values: frequent traditional characters, each followed by its simplified form
SIMPLIFIED = (
    "萬万 與与 專专 業业 東东 兩两 嚴严 喪丧 個个 豐丰 臨临 為为 麗丽 舉举 義义 烏乌 樂乐 喬乔 習习 鄉乡 書书 買买 亂乱 爭争 雲云 亞亚 產产 親亲 億亿 僅仅 從从 倉仓 儀仪 們们 價价 眾众 優优 會会 傘伞 偉伟 傳传 傷伤 倫伦 偽伪 "
    "體体 傭佣 側侧 僑侨 債债 傾倾 償偿 兒儿 黨党 蘭兰 關关 興兴 養养 獸兽 內内 岡冈 冊册 寫写 軍军 農农 馮冯 沖冲 決决 況况 凍冻 淨净 涼凉 減减 幾几 鳳凤 憑凭 凱凯 擊击 劃划 劉刘 則则 剛刚 創创 刪删 別别 劇剧 勸劝 "
    "辦办 務务 動动 勵励 勞劳 勢势 勝胜 區区 醫医 華华 協协 單单 賣卖 盧卢 衛卫 卻却 廠厂 廳厅 歷历 壓压 厭厌 廁厕 縣县 參参 雙双 發发 變变 敘叙 疊叠 葉叶 號号 嘆叹 嚇吓 嗎吗 啟启 吳吴 員员 聽听 國国 圖图 圓圆 聖圣 場场 塊块 "
    "堅坚 壇坛 墳坟 墜坠 壟垄 壯壮 聲声 處处 備备 復复 夠够 頭头 誇夸 奪夺 奮奋 婦妇 媽妈 嬰婴 孫孙 學学 寧宁 寶宝 實实 寵宠 審审 憲宪 對对 尋寻 導导 將将 爾尔 塵尘 嘗尝 層层 歲岁 島岛 幣币 師师 帳帐 幫帮 廣广 莊庄 慶庆 應应"
)


@stage("TradToSimpChinese")
def simplified(df: DataFrame, table: dict = None, ctx: Context = None) -> DataFrame:
    """Phrases and characters by a table (traditional -> simplified), the longest first; lang zht becomes zhs.

    The table is the argument, else a table (phrase, value) of the context under
    "traditional", else that of some two hundred frequent characters.
    """
    from .phrases import Phrases

    given = table or (ctx.named.get("traditional") if ctx else None)
    done = Phrases(df.sparkSession, given if given is not None else dict(SIMPLIFIED.split())).replaced(df, "content")
    return done.withColumn("lang", F.when(F.col("lang") == "zht", "zhs").otherwise(F.col("lang")))


CHINESE = ("zh", "zhs", "zht", "chs", "ja")


@stage("WordCut")
def word_cut(df: DataFrame, for_search: bool = False, field: str = "keywords", ctx: Context = None) -> DataFrame:
    """Lower-cased words and accent-free copies; for search also stems and transliterations.

    Chinese and Japanese are cut along the most probable path through the words
    of the context's table "segmentation" (made by segment.fit); without one
    into characters and neighbouring pairs.
    """
    from ..functions.stems import stem
    from ..functions.transliterate import to_latin
    from . import segment

    words = text.tokens("content", (lambda low: stem(low, F.col("lang"))) if for_search else None)
    if for_search:
        words = F.concat(words, F.transform(words, lambda w: to_latin(w)))
    model = ctx.named.get("segmentation") if ctx else None
    if model is not None:
        own = F.when(F.col("lang").isin(*CHINESE), F.col("content"))
        df = segment.cut(df.withColumn("__cut", own), model, "__cut", "__cut")
        cut = F.filter("__cut", lambda w: w.rlike(r"[\p{L}\p{N}]"))
    else:
        ch = F.filter(arrays.chars("content"), lambda c: c.rlike(r"[\p{L}\p{N}]"))
        pairs = F.zip_with(F.slice(ch, F.lit(1), F.greatest(F.size(ch) - 1, F.lit(0))), F.slice(ch, F.lit(2), F.greatest(F.size(ch) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
        cut = F.concat(ch, pairs)
    cut = F.when(F.col("lang").isin(*CHINESE), F.coalesce(cut, F.array().cast("array<string>"))).otherwise(words)
    old = F.coalesce(F.col(field), F.array().cast("array<string>")) if field in df.columns else F.array().cast("array<string>")
    out = F.concat(old, cut)
    return df.withColumn(field, F.array_distinct(out) if field == "keywords" else out).drop("__cut")


@stage("WordStemmer")
def word_stemmer(df: DataFrame, append: bool = True, field: str = "tokens") -> DataFrame:
    from ..functions.stems import stem

    stems = stem(F.col(field), F.col("lang"))
    return df.withColumn(field, F.concat(field, stems) if append else stems)


@stage("LatinTransliterate")
def latin_transliterate(df: DataFrame, append: bool = True, field: str = "tokens") -> DataFrame:
    from ..functions.transliterate import to_latin

    latin = F.transform(field, to_latin)
    return df.withColumn(field, F.concat(field, latin) if append else latin)


@stage("FilterStopWords")
def filter_stop_words(df: DataFrame, stopwords: str = "", field: str = "tokens", table: dict = None) -> DataFrame:
    """Stop words of the row's language (a table language -> list; the common words by default) and given ones go."""
    stop = {k: list(v) for k, v in (table or {k: v.split() for k, v in text.COMMON.items()}).items()}
    stop["*"] = [*stop.get("*", []), *stopwords.split()]
    return df.withColumn(field, text.remove_stop_words(field, stop, "lang"))


@stage("DatasetFromField")
def dataset_from_field(df: DataFrame, pattern: str) -> DataFrame:
    """dataset_name from a pattern with {field}s; rows that lack one of them keep theirs."""
    parts = re.split(r"\{(\w+)\}", pattern)
    missing = [p for p in parts[1::2] if p not in df.columns]
    old = F.col("dataset_name") if "dataset_name" in df.columns else F.lit(None).cast("string")
    if missing:
        return df.withColumn("dataset_name", old)
    out = F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)])
    return df.withColumn("dataset_name", F.coalesce(out, old))


@stage("Limit")
def limit(df: DataFrame, limit: int = 0, ctx: Context = None) -> DataFrame:
    """The first rows in order; 0: none."""
    order = [c for c in (ctx.order if ctx else Context().order) if c in df.columns]
    return df.orderBy(*order).limit(limit)


@stage("AccumulateParagraphs")
def accumulate(df: DataFrame, sort: str = "") -> DataFrame:
    """All rows by several keys, -key downwards, missing ones as empty text."""
    keys = []
    for k in filter(None, (x.strip() for x in sort.split(","))):
        name = k.lstrip("+-")
        if name in df.columns:
            c = F.coalesce(F.col(name).cast("string"), F.lit("")) if dict(df.dtypes)[name] == "string" else F.col(name)
            keys.append(c.desc_nulls_last() if k.startswith("-") else c.asc_nulls_first())
    return df.orderBy(*keys) if keys else df


@stage("TimeExtractor")
def time_extractor(df: DataFrame, base_date: str = "2024-06-15 12:00:00") -> DataFrame:
    """pdate from the first date or time in content; rows without any get base_date."""
    return df.withColumn("pdate", F.coalesce(dates.extract_time("content", base_date), F.lit(base_date).cast("timestamp_ntz")))


@stage("TextCleaner")
def text_cleaner(df: DataFrame, remove_garbled: bool = True, garbled_threshold: float = 0.3, fix_ocr_errors: bool = True, remove_hyphens: bool = True, fix_german_umlauts: bool = False) -> DataFrame:
    if remove_garbled:
        df = df.where(~text.is_garbled("content", garbled_threshold))
    return df.withColumn("content", text.clean_text("content", fix_ocr_errors, remove_hyphens, fix_german_umlauts))


@stage("NERAsTokens")
def ner_as_tokens(df: DataFrame, field: str = "tokens") -> DataFrame:
    """array<struct<text,label>> as text/label."""
    return df.withColumn(field, F.transform("ner", lambda e: F.concat_ws("/", e["text"], e["label"])))


@stage("GCJtoWGS")
def gcj_to_wgs(df: DataFrame, field: str, in_format: str = "lnglat", out_format: str = "latlng") -> DataFrame:
    return df.withColumn(field, geo.convert(field, in_format, out_format))


@stage("HanziChaizi")
def hanzi_parts(df: DataFrame, table: dict = None, ctx: Context = None) -> DataFrame:
    """chaizi: the parts of each character, or longer phrase, that the table has.

    The table is the argument or the context's table (phrase, value) "chaizi".
    """
    from pyspark.sql import types as T

    from .phrases import Phrases

    phrases = Phrases(df.sparkSession, table or (ctx.named.get("chaizi") if ctx else None) or {})
    df = df.withColumn("__c", F.coalesce("content", F.lit("")))
    return phrases.apply(df, "__c", "chaizi", T.ArrayType(T.StringType()), lambda a, t: [v for _, _, v in a.longest(t)]).drop("__c")


@stage("GazetteerNER")
def gazetteer(df: DataFrame, table: dict = None, ctx: Context = None) -> DataFrame:
    """ner: the phrases of a table (phrase -> label; argument or the context's "gazetteer") in content, in order."""
    from .phrases import Phrases

    phrases = Phrases(df.sparkSession, table or ctx.named["gazetteer"])
    return phrases.found(df, "content", "ner").withColumn("ner", F.transform("ner", lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"))))


@stage("AutoSentimentAnalysis")
def sentiment(df: DataFrame, lexicon: dict = None, ctx: Context = None) -> DataFrame:
    """sentiment from -1 to 1: (p - 0.5) * 2.

    p is the share of the label positive among the likelihoods of the context's
    table sentiment_model (made by bayes.SENTIMENT.fit with labels positive and
    negative; texts without words have 0). Without that table p is the smoothed
    share of positive among the lexicon's words.
    """
    from . import bayes

    model = ctx.named.get("sentiment_model") if ctx else None
    if model is not None:
        scored = bayes.SENTIMENT.score(df, model, "content", "__guess", "__share")
        p = F.when(F.col("__guess") == "positive", F.col("__share")).otherwise(1 - F.col("__share"))
        return scored.withColumn("sentiment", F.coalesce((p - 0.5) * 2, F.lit(0.0))).drop("__guess", "__share")
    good = [w for w, v in (lexicon or {}).items() if v > 0]
    bad = [w for w, v in (lexicon or {}).items() if v < 0]
    w = text.words(F.lower("content"))
    count = lambda found: F.size(F.filter(w, lambda x: x.isin(found))) if found else F.lit(0)
    p = (count(good) + 1) / (count(good) + count(bad) + 2)
    return df.withColumn("sentiment", (p - 0.5) * 2)
