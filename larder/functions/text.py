"""Text functions as Column expressions: accent folding, trigram similarity, boundary match, list splitting."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.cache
def accent_table() -> tuple[str, str]:
    """Characters up to U+1FFF whose decomposition, without its marks, is one other character; and that character."""
    source, target = [], []
    for point in range(0x80, 0x2000):
        char = chr(point)
        bare = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != char:
            source.append(char)
            target.append(bare)
    return "".join(source), "".join(target)


def unaccent(text: Column) -> Column:
    """F-06: accents removed, case kept; null stays null."""
    return F.regexp_replace(F.translate(text, *accent_table()), r"\p{Mn}", "")


#: Letters without a decomposition, as a database's own folding writes them: one for one, and several for one.
LETTERS = ("ØøĐđÐðŁłĦħŦŧıŊŋ", "OoDdDdLlHhTtiNn")
LIGATURES = (("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"), ("ß", "ss"), ("ẞ", "SS"), ("Þ", "TH"), ("þ", "th"), ("Ĳ", "IJ"), ("ĳ", "ij"))


def unaccent_search(text: Column) -> Column:
    """F-06 as the search has it: letters that have no accents but a bar or a ligature are folded too."""
    for letter, plain in LIGATURES:
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return unaccent(F.translate(text, *LETTERS))


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold(text: Column) -> Column:
    """F-01: no accents, lower case, anything but a-z, 0-9 and spaces becomes a space, spaces squeezed."""
    return _squeezed(F.regexp_replace(F.lower(unaccent(text)), r"[^a-z0-9\s]", " "))


def fold_deleting(text: Column) -> Column:
    """F-02: as fold(), but other characters are deleted."""
    return _squeezed(F.regexp_replace(F.lower(unaccent(text)), r"[^a-z0-9\s]", ""))


def fold_letters(text: Column) -> Column:
    """F-03: letters a-z only."""
    return F.regexp_replace(F.lower(unaccent(text)), r"[^a-z]", "")


#: Units that join a preceding number before words are compared.
UNITS = ("mcg", "mg", "ml", "g", "kcal", "kj", "ui", "iu")


def fold_metric(text: Column) -> Column:
    """F-04: as fold(), after joining a number and its unit."""
    lowered = F.lower(unaccent(text))
    joined = F.regexp_replace(lowered, rf"(\d)\s+({'|'.join(UNITS)})\b", "$1$2")
    return _squeezed(F.regexp_replace(joined, r"[^a-z0-9\s]", " "))


def fold_label(text: Column) -> Column:
    """F-05: lower case, letters a-z and digits only, accents not folded."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]", "")


def contains_folded(text: Column, query: str) -> Column:
    """P-07: case- and accent-insensitive pattern; % and _ in the query keep their meaning."""
    return F.like(F.lower(unaccent_search(text)), F.concat(F.lit("%"), F.lower(unaccent_search(F.lit(query))), F.lit("%")))


def trigrams(text: Column) -> Column:
    """Ordered trigrams, with repeats, of the words in a text; words are padded by two spaces before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)

    def of(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substr(padded, i, F.lit(3)))

    return F.flatten(F.transform(words, of))


def word_similarity(first: Column, second: Column) -> Column:
    """F-38: the best overlap of the first text's trigram set with a run of the second text's trigrams.

    A best run begins and ends at a shared trigram, so only such ends are tried.
    """
    a, b = F.array_distinct(trigrams(first)), trigrams(second)
    both = F.struct(a.alias("a"), b.alias("b"))

    def best(x: Column) -> Column:
        place = F.filter(F.transform(x["b"], lambda t, i: F.when(F.array_contains(x["a"], t), i + 1)), lambda i: i.isNotNull())

        def to_end(i: Column) -> Column:
            def score(j: Column) -> Column:
                run = F.array_distinct(F.slice(x["b"], i, j - i + 1))
                common = F.size(F.array_intersect(run, x["a"]))
                return common / (F.size(x["a"]) + F.size(run) - common)

            return F.array_max(F.transform(F.filter(place, lambda j: j >= i), score))

        return F.coalesce(F.array_max(F.transform(place, to_end)), F.lit(0.0))

    return F.transform(F.array(both), best)[0]


def bounded_first(text: Column, key: Column) -> Column:
    """F-24: whether the key's first occurrence in the text stands between spaces or ends."""
    at = F.instr(text, key)
    before = (at == 1) | (F.substr(text, at - 1, F.lit(1)) == " ")
    after = (at + F.length(key) > F.length(text)) | (F.substr(text, at + F.length(key), F.lit(1)) == " ")
    return (at > 0) & before & after


#: What is stripped from an item's ends.
EDGE = r"[ \t\-•·.]"


def split_items(raw: Column) -> Column:
    """F-08: items between commas or semicolons, or lines if there are none; short and numeric items dropped (P-13)."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^(?U:\s)+|(?U:\s)+$", "")
    parts = F.when(text.rlike("[,;]"), F.split(text, "[,;]", -1)).otherwise(F.split(text, r"[\r\n]+", -1))
    bare = F.transform(parts, lambda p: F.regexp_replace(p, f"^{EDGE}+|{EDGE}+$", ""))
    return F.filter(bare, lambda p: (F.length(p) >= 2) & ~p.rlike(r"^(?U:\d)+$"))


def canonical_list(text: Column) -> Column:
    """F-39: comma separated values, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ",", -1), lambda p: F.trim(p)), lambda p: p != "")


def looks_like_one_phrase(items: Column) -> Column:
    """P-15: a single item of more than 60 characters."""
    return (F.size(items) == 1) & (F.length(items[0]) > 60)


def truncated(message: Column, most: int = 500) -> Column:
    """F-40: the first 500 characters, no ellipsis."""
    return F.substring(message, 1, most)
