"""The text functions for queries that are written as SQL: temporary functions that SQL defines, so that they stay in the plan and nothing
is called outside it. ``register`` makes them known to a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from larder.functions.text import LETTERS, LIGATURES, UNITS, accent_table


def _quoted(text: str) -> str:
    """As SQL literals' escapes need it."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _unaccent() -> str:
    source, target = accent_table()
    return f"regexp_replace(translate(t, {_quoted(source)}, {_quoted(target)}), r'\\p{{Mn}}', '')"


def _ligatures() -> str:
    out = "t"
    for letter, plain in LIGATURES:
        out = f"replace({out}, '{letter}', '{plain}')"
    return f"larder_unaccent(translate({out}, '{LETTERS[0]}', '{LETTERS[1]}'))"


#: Name, parameters, type, body; a function may use those before it.
FUNCTIONS = [
    ("larder_unaccent", "t string", "string", _unaccent),
    ("larder_unaccent_search", "t string", "string", _ligatures),
    ("larder_fold", "t string", "string", lambda: r"trim(regexp_replace(regexp_replace(lower(larder_unaccent(t)), r'[^a-z0-9\s]', ' '), r'\s+', ' '))"),
    ("larder_fold_deleting", "t string", "string", lambda: r"trim(regexp_replace(regexp_replace(lower(larder_unaccent(t)), r'[^a-z0-9\s]', ''), r'\s+', ' '))"),
    ("larder_fold_letters", "t string", "string", lambda: r"regexp_replace(lower(larder_unaccent(t)), r'[^a-z]', '')"),
    ("larder_fold_metric", "t string", "string", lambda: rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(larder_unaccent(t)), r'(\d)\s+({'|'.join(UNITS)})\b', '$1$2'), r'[^a-z0-9\s]', ' '), r'\s+', ' '))"),
    ("larder_search_text", "name string, brand string", "string", lambda: "lower(larder_unaccent_search(concat(coalesce(name, ''), ' ', coalesce(brand, ''))))"),
    ("larder_trigrams", "t string", "array<string>", lambda: r"flatten(transform(regexp_extract_all(lower(t), r'([\p{L}\p{N}]+)', 1), w -> transform(sequence(1, length(w) + 1), i -> substr(concat('  ', w, ' '), i, 3))))"),
    (
        "larder_word_similarity",
        "first string, second string",
        "double",
        lambda: """transform(array(named_struct('a', array_distinct(larder_trigrams(first)), 'b', larder_trigrams(second))), x ->
            coalesce(array_max(transform(filter(transform(x.b, (t, i) -> if(array_contains(x.a, t), i + 1, null)), i -> i is not null), i ->
              array_max(transform(filter(transform(x.b, (t, j) -> if(array_contains(x.a, t), j + 1, null)), j -> j >= i), j ->
                size(array_intersect(array_distinct(slice(x.b, i, j - i + 1)), x.a)) / size(array_union(x.a, array_distinct(slice(x.b, i, j - i + 1)))))))), 0D))[0]""",
    ),
]


def register(spark: SparkSession) -> None:
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body()}")
