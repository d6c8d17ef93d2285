"""Greek and Cyrillic letters in Latin ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: common romanisation, one letter each
SINGLE = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "з": "z", "и": "i", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "c", "ы": "y", "э": "e", "ё": "e", "і": "i", "ї": "i", "є": "e", "ґ": "g",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o",
    "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "ω": "o",
}
# fixed values: those with more than one
MULTIPLE = {"ж": "zh", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ъ": "", "ь": "", "θ": "th", "φ": "ph", "χ": "ch", "ψ": "ps"}


def to_latin(word: Column) -> Column:
    """Lower-cased, letters of both scripts replaced; others as they are."""
    out = F.translate(F.lower(word), "".join(SINGLE), "".join(SINGLE.values()))
    for a, b in MULTIPLE.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
