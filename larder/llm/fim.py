"""Fill-in-middle transformation in native Spark SQL (operator 13).

A text is an array of units (``regexp_extract_all``; by default lines, the last one with or without its end). Four
numbers, the first groups of 8 hexadecimal digits of the sha256 of ``seed:id`` (``conv`` of ``substring``), decide: two
cuts among the n + 1 places between units, whether the text is rearranged at all, and how. ``slice`` and ``array_join``
make prefix, middle and suffix, and put them in one of two orders behind the sentinels ``<P>``, ``<S>`` and ``<M>``:
``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle). ``restored`` parses the sentinels of an output and
puts the parts back in their order; nothing but output and form is read for that.

A text that holds a sentinel itself stays as it is (``plain``), so every output can be undone. A sentinel can't come
about where parts meet: none of them ends with the beginning of another.

Everything is an expression on a row: no shuffle, no Python; a text's size is the only bound on memory.

Defined cases: a null text is an empty one, and stays plain with no units; a null id is decided by ``seed:`` alone; equal
ids with equal texts give equal rows; a text of one unit, however long, is cut at its ends only; an empty table gives no
rows; other columns, whatever their names, are kept by ``transformed`` (but for its own, which replace them) and not
read by ``digest``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Parts of ``transformed`` that ``digest`` gives no digest of.
PARTS = ("n", "form", "prefix", "middle", "suffix", "output")


def draw(id_col: Column, seed: int | str, k: int) -> Column:
    """The k-th number (from 0) that an id's hash gives: a whole number under 2 ** 32."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transformed(docs: DataFrame, seed: int | str = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text: str = "text", units: str = LINES) -> DataFrame:
    """``docs`` with columns n (units), form, prefix, middle, suffix (null if plain) and output.

    ``rate`` percent of the texts are rearranged, ``spm`` percent of these suffix first. ``units`` is a pattern whose matches
    cover every text.
    """
    key, whole = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    draws, h = [draw(key, seed, k) for k in range(4)], [F.col(f"_h{k}") for k in range(4)]
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # a struct, so that no name clashes
    split = docs.select(kept.alias("_row"), *[d.alias(f"_h{k}") for k, d in enumerate(draws)], whole.alias("_text"), F.regexp_extract_all(whole, F.lit(units), F.lit(0)).alias("_units"))
    counted = split.withColumn("n", F.size("_units").cast("long"))
    places = [h[k] % (F.col("n") + 1) for k in (0, 1)]
    plain = (F.col("_text") == "") | F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE)) | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    cut = counted.withColumns({"_a": F.least(*places).cast("int"), "_b": F.greatest(*places).cast("int"), "form": form})

    def part(begin: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("_units", begin + 1, length), ""))

    a, b, n = F.col("_a"), F.col("_b"), F.col("n").cast("int")
    parts = cut.withColumns({"prefix": part(F.lit(0), a), "middle": part(a, b - a), "suffix": part(b, n - b)})
    psm = F.array_join(F.array(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"), "")
    spm_ = F.array_join(F.array(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"), "")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("_text"))
    return parts.withColumn("output", output).select(*[F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in PARTS], *PARTS)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of: its sentinels are parsed, in the order that its form gives them. Null for an output that
    lacks them; a plain one is the text."""
    found = F.struct(F.split(output, "|".join(SENTINELS), -1).alias("parts"), F.regexp_extract_all(output, F.lit("|".join(SENTINELS)), F.lit(0)).alias("marks"))

    def put(x: Column, names: tuple, places: tuple) -> Column:
        return F.when(x.marks == F.array(*map(F.lit, names)), F.concat(*[x.parts[k] for k in places]))

    undone = lambda x: F.when(form == "psm", put(x, (PREFIX, SUFFIX, MIDDLE), (1, 3, 2))).when(form == "spm", put(x, (SUFFIX, PREFIX, MIDDLE), (2, 3, 1)))
    return F.when(form == "plain", output).otherwise(F.transform(F.array(found), undone)[0])  # parsed once for both


def digest(docs: DataFrame, seed: int | str = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of each document."""
    rows = transformed(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), seed, rate, spm)
    back = rows.withColumn("back", restored(F.col("output"), F.col("form")))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    sizes = [F.char_length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return back.select(F.col("doc_id").alias(id_col), "n", "form", *sizes, sha("output").alias("output_sha256"), sha("back").alias("restored_sha256"))


def oracle(seed: int | str = 7, rate: int = 100, spm: int = 50) -> str:
    """Cuts found by the units' lengths and taken from the text by place; the text itself is what must come back."""
    return f"""
    with d as (select doc_id, coalesce(text, '') as t, sha256('{seed}:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
    u as (select *, list_transform(regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+'), lambda s: length(s)) as sizes, list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(x, i, 8) as bigint)) as h from d),
    c as (select *, cast(len(sizes) as bigint) as n,
          case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= {rate} then 'plain'
               when h[4] % 100 < {spm} then 'spm' else 'psm' end as form from u),
    p as (select *, coalesce(list_sum(sizes[1:least(h[1] % (n + 1), h[2] % (n + 1))]), 0) as a, coalesce(list_sum(sizes[1:greatest(h[1] % (n + 1), h[2] % (n + 1))]), 0) as b from c)
    select doc_id, n, form, cast(case when form <> 'plain' then a end as bigint) as prefix_chars, cast(case when form <> 'plain' then b - a end as bigint) as middle_chars,
           sha256(case form when 'psm' then '<P>' || substr(t, 1, cast(a as bigint)) || '<S>' || substr(t, cast(b as bigint) + 1) || '<M>' || substr(t, cast(a as bigint) + 1, cast(b - a as bigint))
                            when 'spm' then '<S>' || substr(t, cast(b as bigint) + 1) || '<P>' || substr(t, 1, cast(a as bigint)) || '<M>' || substr(t, cast(a as bigint) + 1, cast(b - a as bigint))
                            else t end) as output_sha256, sha256(t) as restored_sha256
    from p
    """
