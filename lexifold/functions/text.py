"""Text functions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}_]+"
ASCII_PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache
def _accents() -> tuple[str, str]:
    """Letters of Latin, Greek and Cyrillic with marks, and the same without: from the character database."""
    marked, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c and c.isalpha():
            marked.append(c)
            plain.append(base)
    return "".join(marked), "".join(plain)


def strip_accents(c) -> Column:
    """Letters without their marks: one table lookup a character, inside the JVM."""
    return F.translate(col(c), *_accents())


def words(c) -> Column:
    """The runs of letters, digits and underscores, in order; null has none."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), NOT_WORD), lambda w: w != "")


def tokens(c, stems=None) -> Column:
    """Lower-cased words followed by their accent-free copies."""
    low = words(F.lower(col(c)))
    out = F.concat(low, F.transform(low, strip_accents))
    return F.concat(out, stems(low)) if stems else out


def keywords_of(c) -> Column:
    """The distinct tokens, sorted."""
    return F.array_sort(F.array_distinct(tokens(c)))


def filter_punctuation(c) -> Column:
    """Without ASCII punctuation at both ends, and without any punctuation or white space inside."""
    # fixed values: the marks that are deleted
    marks = r"[，。「」·；□■•●『』［］【】（）\s　\(\)、“”‘’《》—\-！？\.\?!,'\"：/\\…]"
    return F.regexp_replace(F.btrim(col(c), F.lit(ASCII_PUNCTUATION)), marks, "")


def remove_stop_words(arr, stop: dict, lang) -> Column:
    """arr without the stop words of the row's language (and of "*") and single punctuation marks.

    stop: language -> words. Codes of simplified and traditional Chinese share "zh".
    """
    code = F.when(col(lang).isin("chs", "zhs", "zht", "zh"), "zh").otherwise(col(lang))
    drop = F.array(*[F.lit(w) for w in stop.get("*", [])]).cast("array<string>")
    for k, found in stop.items():
        if k != "*":
            drop = F.when(code == k, F.array(*[F.lit(w) for w in [*found, *stop.get("*", [])]])).otherwise(drop)
    return F.filter(col(arr), lambda w: ~F.coalesce(F.array_contains(drop, w), F.lit(False)) & ~w.rlike(r"^\p{P}$"))


#: fixed values: what stands for each confusable character
CONFUSABLES = {
    "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "‘": "'", "’": "'", "“": '"', "”": '"', "—": "-", "–": "-", "…": "...", "•": "*", "°": "o",
}
# fixed values: how umlauts are spelled without marks
UMLAUTS = {"Ae": "Ä", "Oe": "Ö", "Ue": "Ü", "ae": "ä", "oe": "ö", "ue": "ü", "ss": "ß"}
# fixed values: characters that are dropped
INVISIBLE = "​‌‍﻿\x00\x01\x02\x03\x04\x05�"


def clean_text(c, fix: bool = True, join_hyphens: bool = True, umlauts: bool = False) -> Column:
    """Ligatures, quotes and dashes made plain, words joined over line ends, white space settled."""
    t = col(c)
    if fix:
        single = "".join(k for k, v in CONFUSABLES.items() if len(v) == 1)
        t = F.translate(t, single + INVISIBLE, "".join(v for v in CONFUSABLES.values() if len(v) == 1))
        for k, v in CONFUSABLES.items():
            if len(v) > 1:
                t = F.replace(t, F.lit(k), F.lit(v))
        if umlauts:
            for a, b in UMLAUTS.items():
                t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}}_]){a}(?![\p{{L}}\p{{N}}_])", b)
    if join_hyphens:
        t = F.regexp_replace(t, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    for pattern, put in ((r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n")):
        t = F.regexp_replace(t, pattern, put)
    return F.regexp_replace(t, r"^\s+|\s+$", "")


#: counted as ordinary besides letters, digits and white space
ORDINARY = r"""[\p{L}\p{N}\s.,!?;:()\[\]{}"'\-–—…]"""


def is_garbled(c, threshold: float = 0.3, min_length: int = 10) -> Column:
    """Too many special characters, replacement characters, control characters, or case that changes all the time."""
    t = F.coalesce(col(c), F.lit(""))
    n = F.char_length(t)
    special = F.char_length(F.regexp_replace(t, ORDINARY, ""))
    control = F.char_length(F.regexp_replace(t, r"[^\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    changes = F.regexp_count(letters, F.lit(r"(?<=\p{Ll})(?=[^\p{Ll}])|(?<=[^\p{Ll}])(?=\p{Ll})"))
    m = F.char_length(letters)
    return (n >= min_length) & ((special > threshold * n) | F.contains(t, F.lit("�")) | (control > 0.05 * n) | ((m > 10) & (changes > 0.6 * m)))


#: a few frequent words of each language for texts in Latin script
COMMON = {
    "en": "the of and to in is that for it with as was are on be this",
    "de": "der die das und ist nicht ein eine zu von mit den im sich auf",
    "fr": "le la les et des est une un dans que qui pour pas sur de",
    "es": "el los las y es un una que por con del para se en",
}


SCRIPTS = {"kana": r"\x{3040}-\x{30FF}", "han": r"\x{4E00}-\x{9FFF}", "cyrillic": r"\x{0400}-\x{04FF}", "hangul": r"\x{AC00}-\x{D7AF}", "latin": r"A-Za-z\x{00C0}-\x{024F}"}


def script_counts(c) -> dict:
    """The number of characters of each script, and under "all" of those that are no white space."""
    t = F.coalesce(col(c), F.lit(""))
    count = lambda cls: F.char_length(F.regexp_replace(t, f"[^{cls}]+", ""))
    return {k: count(cls) for k, cls in SCRIPTS.items()} | {"all": F.char_length(F.regexp_replace(t, r"\s+", ""))}


def with_script_counts(df: DataFrame, content: str = "content", prefix: str = "__n_") -> tuple[DataFrame, dict]:
    """(df with columns of the counts, the columns as script_counts gives them, without Latin).

    Each count is taken once, however often it is used, and only of texts that
    have a character of these scripts at all; of the others it is null.
    """
    told = [k for k in SCRIPTS if k != "latin"]
    t, any_ = F.col(content), f"{prefix}any"
    mixed = (F.octet_length(t) > F.char_length(t)) & t.rlike(f"[{''.join(SCRIPTS[k] for k in told)}]")
    df = df.withColumn(any_, F.coalesce(mixed, F.lit(False)))
    n = script_counts(content)
    df = df.withColumns({f"{prefix}{k}": F.when(F.col(any_), n[k]) for k in (*told, "all")}).drop(any_)
    return df, {k: F.col(f"{prefix}{k}") for k in (*told, "all")}


def script_language(c, counts: dict | None = None) -> Column:
    """Language by script: Hangul ko, kana over 30 % ja, Han over half zh, Cyrillic over half ru; else null."""
    n = counts or script_counts(c)
    return F.when(n["all"] == 0, None).when(n["hangul"] > 0, "ko").when(n["kana"] > 0.3 * n["all"], "ja").when(n["han"] > 0.5 * n["all"], "zh").when(n["cyrillic"] > 0.5 * n["all"], "ru")


def script_share(c, counts: dict | None = None) -> Column:
    """The share that decided in script_language; null where it gives null. Japanese counts its Han too."""
    n = counts or script_counts(c)
    one = {"ko": n["hangul"], "ja": n["kana"] + n["han"], "zh": n["han"], "ru": n["cyrillic"]}
    lang = script_language(c, n)
    out = None
    for k, v in one.items():
        out = F.when(lang == k, v) if out is None else out.when(lang == k, v)
    return F.try_divide(out, n["all"])


def detect_language(c, default: str = "en") -> Column:
    """script_language, else the language whose common words come most often (default on a tie at zero)."""
    w = words(F.lower(col(c)))

    def among(found):
        return lambda x: x.isin(found)

    scores = [F.struct(F.size(F.filter(w, among(found.split()))).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("lang")) for i, (k, found) in enumerate(COMMON.items())]
    best = F.greatest(*scores)
    return F.coalesce(script_language(c), F.when(best["n"] > 0, best["lang"]), F.lit(default))


def no_other_characters(c) -> Column:
    """Control, format, unassigned and private characters become spaces."""
    return F.regexp_replace(col(c), r"\p{C}", " ")
