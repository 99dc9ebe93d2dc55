"""Nutrition text: line repair and row parsing (F-09, F-13 to F-23, F-25, J-12, J-13), as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import fold_deleting

#: Nutrients in order, as (folded key, unit, display).
NUTRIENTS = (
    ("valor energetico", "kcal", "Valor Energético"),
    ("carboidratos", "g", "Carboidratos"),
    ("acucares totais", "g", "Açúcares Totais"),
    ("proteinas", "g", "Proteínas"),
    ("gorduras totais", "g", "Gorduras Totais"),
    ("gorduras saturadas", "g", "Gorduras Saturadas"),
    ("gorduras trans", "g", "Gorduras Trans"),
    ("fibra alimentar", "g", "Fibra Alimentar"),
    ("sodio", "mg", "Sódio"),
)
MOST_DISTANCE = 6
#: Digits that letters are read for.
DIGITS = ("ÚúUOoQlIiSZsz", "0000001115522")
#: Marks of an undefined daily value; only the cloud variant takes a double quote.
MARKS, CLOUD_MARKS = "[*'»«]", "[*'\"»«]"
#: Readings that are replaced, in this order.
READINGS = (("k]", "kJ"), ("k|", "kJ"), ("k)", "kJ"), ("%ND()", "%VD(*)"), ("AVD()", "%VD(*)"), ("WVD()", "%VD(*)"), ("soDa", "sopa"))
LINE = r"(?U)^\s*([A-Za-zÀ-ÿ\s]+?)\s+([0-9.,]+)\s*([A-Za-z%*()]+)?\s*([0-9.,*]+)?\s*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeezed(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def digits(text: Column) -> Column:
    """F-13."""
    return F.translate(text, *DIGITS)


def nearest(label: Column) -> Column:
    """J-12: struct (distance, nth) of the nearest nutrient, the first among equals; null if none is near enough."""
    folded = fold_deleting(label)

    def of(x: Column) -> Column:
        best = F.array_min(F.array(*[F.struct(F.levenshtein(x, F.lit(key)).alias("distance"), F.lit(i).alias("nth")) for i, (key, _, _) in enumerate(NUTRIENTS)]))
        return F.when((x != "") & (best["distance"] <= MOST_DISTANCE), best)

    return let(folded, of)


def once(df: DataFrame, value: Column, of: Callable[[Column], Column], to: str) -> DataFrame:
    """``df`` with column ``to``: ``of`` applied to each distinct value once, and joined back. Labels repeat."""
    rows = df.withColumn("_value", value)
    found = rows.select("_value").distinct().select(F.col("_value").alias("_own"), of(F.col("_value")).alias(to))
    return rows.join(found, F.col("_value").eqNullSafe(F.col("_own")), "left").drop("_value", "_own")


def key_of(nearest_: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k, _, _ in NUTRIENTS]), nearest_["nth"])


def unit_of(nearest_: Column) -> Column:
    return F.get(F.array(*[F.lit(u) for _, u, _ in NUTRIENTS]), nearest_["nth"])


def display_of(nearest_: Column) -> Column:
    return F.get(F.array(*[F.lit(d) for _, _, d in NUTRIENTS]), nearest_["nth"])


def label_of(line: Column) -> Column:
    """F-22: the letters and spaces a line begins with."""
    return stripped(F.regexp_extract(line, r"(?U)^\s*([A-Za-zÀ-ÿ\s]+)", 1))


def symbols(line: Column) -> Column:
    """F-21."""
    for before, after in READINGS:
        line = F.replace(line, F.lit(before), F.lit(after))
    line = F.regexp_replace(line, r"(?iU)Quantidade\s+por\s+porc[aã]o\s+(WVD|%VD)\(\)", "Quantidade por porção %VD(*)")
    return squeezed(line)


def nine_for_g(number: Column, unit: Column) -> Column:
    """F-17: whether a number of at least 100 that ends in 9 is likely one whose unit g was read as 9."""
    return F.coalesce((unit == "g") & number.rlike("^[0-9]+9$") & (F.length(F.regexp_replace(number, "^0+", "")) >= 3), F.lit(False))


def daily_value(cell: Column, marks: str = MARKS) -> Column:
    """F-18: one to three digits, ** for marks and what can't be read, null for blanks and decimals."""

    def of(text: Column) -> Column:
        read = digits(text)
        some = F.regexp_extract(read, "[0-9]{1,3}", 0)
        return F.when(text == "", None).when(text.rlike(marks), "**").when(F.contains(read, F.lit(",")), None).when(some != "", some).otherwise("**")

    return let(stripped(cell), of)


def _cell(state: Column, col: Column, unit: Column) -> Column:
    """One step of F-16 over a cell; the state is (number, unit, daily value)."""
    same = F.struct(state["number"].alias("number"), state["unit"].alias("unit"), state["vd"].alias("vd"))
    new = lambda number, u, vd: F.struct(number.alias("number"), u.alias("unit"), vd.alias("vd"))
    number, has, vd = state["number"], state["number"] != "", state["vd"]
    is_g, is_kcal = F.coalesce(unit == "g", F.lit(False)), F.coalesce(unit == "kcal", F.lit(False))

    def read(text: Column) -> Column:
        kcal = F.regexp_extract(text, r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*kca[l1]", 1)
        alone = text.rlike("^[A-Za-z]+$") & unit.isNotNull() & (F.levenshtein(F.lower(text), F.coalesce(unit, F.lit(""))) <= 2)
        shape = r"^([0-9]+(?:[.,][0-9]+)?)\s*([A-Za-z0-9]+)?\s*$"
        n, u = F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2)
        near = unit.isNotNull() & (F.levenshtein(F.lower(u), F.coalesce(unit, F.lit(""))) <= 2)
        slip = nine_for_g(n, unit)
        shorter = F.substr(n, F.lit(1), F.length(n) - 1)
        with_unit = F.when(near, new(n, unit, vd)).when(slip, new(shorter, unit, vd)).otherwise(new(n, u, vd))
        after = new(number, state["unit"], F.when(text.rlike("^[0-9]{1,3}$"), text).otherwise(daily_value(col)))
        rest = F.when(has & vd.isNull(), new(number, state["unit"], daily_value(col))).otherwise(same)
        parsed = F.when(n == "", rest).when(u != "", with_unit).when(has, after).otherwise(new(n, state["unit"], vd))
        unit_only = F.when(has & (state["unit"] == ""), new(number, unit, vd)).otherwise(same)
        return F.when(is_kcal & (kcal != ""), new(kcal, F.lit("kcal"), vd)).when(alone, unit_only).otherwise(parsed)

    text = F.when(is_g & col.rlike(r"^[0-9]+[.,][0-9]*9$"), F.concat(F.substr(col, F.lit(1), F.length(col) - 1), F.lit("g"))).otherwise(col)
    return F.when(col == "", same).when(col.rlike(MARKS), new(number, state["unit"], F.lit("**"))).otherwise(let(digits(text), read))


def quantity(cols: Column, unit: Column) -> Column:
    """F-16: struct (quantity, vd) of the cells after a name, by what they hold, not by where they stand."""
    start = F.struct(F.lit("").alias("number"), F.lit("").alias("unit"), F.lit(None).cast("string").alias("vd"))

    def finish(s: Column) -> Column:
        number = F.when((s["unit"] == "") & nine_for_g(s["number"], unit), F.substr(s["number"], F.lit(1), F.length(s["number"]) - 1)).otherwise(s["number"])
        u = F.when(s["unit"] == "", F.coalesce(unit, F.lit(""))).otherwise(s["unit"])
        return F.struct(F.when(s["number"] == "", "").otherwise(F.trim(F.concat(number, F.lit(" "), u))).alias("quantity"), s["vd"].alias("vd"))

    return F.aggregate(cols, start, lambda s, c: _cell(s, c, unit), finish)


def tabular_line(line: Column) -> Column:
    """F-15: a line with tabs."""

    def of(cols: Column) -> Column:
        raw = symbols(cols[0])

        def named(near: Column) -> Column:
            name = F.coalesce(display_of(near), raw)
            q = quantity(F.slice(cols, 2, F.size(cols)), unit_of(near))
            return let(q, lambda x: F.concat(name, F.when(x["quantity"] != "", F.concat(F.lit("\t"), x["quantity"])).otherwise(""), F.coalesce(F.concat(F.lit("\t"), x["vd"]), F.lit(""))))

        full = let(F.when(label_of(raw) != "", nearest(label_of(raw))), named)
        return F.when(F.exists(cols, lambda c: c != ""), full).otherwise(line)

    return let(F.transform(F.split(line, "\t", -1), stripped), of)


def collision(value: Column, unit: Column, has_vd: Column) -> Column:
    """F-23: the value without a last digit that is likely its unit; null if it stays."""
    cut = F.substr(value, F.lit(1), F.length(value) - 1)
    plain = ~value.rlike("[.,]") & value.rlike("9$")
    decimal = F.when(value.rlike(r"^[0-9]+[.,][0-9]9$"), cut)
    without = F.when(plain & value.rlike("^[0-9]{3,}$") & (F.length(F.regexp_replace(value, "^0+", "")) >= 3), cut)
    with_vd = F.when(plain & (F.length(value) >= 2), cut)
    return F.when(unit == "g", F.coalesce(decimal, F.when(has_vd, with_vd).otherwise(without)))


def daily_token(token: Column) -> Column:
    """F-22: a daily value at a line's end."""
    some = F.regexp_extract(token, "[0-9]{1,2}", 0)
    return F.when(token == "", None).when(token.rlike(r"\*"), "**").when(some != "", some)


def energy_line(line: Column) -> Column:
    """F-20."""
    repaired = F.regexp_replace(F.regexp_replace(line, r"(?iU)\bk\s*[\)\]\|]?\b", "kJ"), r"(?iU)k\s?j", "kJ")
    shape = r"(?iU)([0-9]+[\.,]?[0-9]*)\s*kcal\s*=?\s*([0-9]+[\.,]?[0-9]*)\s*kJ\s*([0-9]{1,2})?"

    def of(x: Column) -> Column:
        vd = F.regexp_extract(x, shape, 3)
        built = F.concat(F.lit("Valor Energético "), F.regexp_extract(x, shape, 1), F.lit("kcal="), F.regexp_extract(x, shape, 2), F.lit("kJ"), F.when(vd != "", F.concat(F.lit(" "), vd)).otherwise(""))
        return F.when(x.rlike(shape), built).otherwise(x)

    return let(repaired, of)


def linear_line(line: Column) -> Column:
    """F-19: a line without tabs."""
    cleaned = squeezed(F.translate(symbols(line), "“”|", "   "))

    def of(x: Column) -> Column:
        def named(near: Column) -> Column:
            value, vd = F.regexp_extract(x, LINE, 2), daily_token(F.regexp_extract(x, LINE, 4))
            unit = unit_of(near)
            fixed = F.coalesce(collision(value, unit, vd.isNotNull()), value)
            built = F.concat_ws(" ", display_of(near), fixed, unit, vd)
            return F.when(near.isNull(), x).when(key_of(near) == "valor energetico", energy_line(x)).when(x.rlike(LINE), built).otherwise(x)

        return let(F.when(label_of(x) != "", nearest(label_of(x))), named)

    return let(cleaned, of)


def postprocess(text: Column) -> Column:
    """F-14: each line by its kind."""
    return F.array_join(F.transform(F.split(text, r"\r\n|\n|\r", -1), fixed_line), "\n")


def fixed_line(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("\t")), tabular_line(line)).otherwise(linear_line(line))


def postprocessed(df: DataFrame, text: str, to: str) -> DataFrame:
    """F-14 for a column of texts: labels repeat their lines, so each distinct line is repaired once and joined back. Texts and lines
    meet by their digests; neither is shuffled more than once as it was given."""
    digest = lambda c: F.sha2(c, 256)
    given = F.coalesce(F.col(text), F.lit(""))
    keyed = df.withColumn("_key", digest(given))
    texts = keyed.groupBy("_key").agg(F.any_value(given).alias("_text"))
    parts = texts.select("_key", F.posexplode(F.split("_text", r"\r\n|\n|\r", -1)).alias("_at", "_line")).withColumn("_digest", digest(F.col("_line")))
    fixed = parts.groupBy("_digest").agg(F.any_value("_line").alias("_line")).select("_digest", fixed_line(F.col("_line")).alias("_fixed"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_fixed"))), lambda x: x["_fixed"]), "\n")
    back = parts.select("_key", "_at", "_digest").join(fixed, "_digest").groupBy("_key").agg(whole.alias(to))
    return keyed.join(back, "_key").drop("_key")


def cloud_line(line: Column) -> Column:
    """F-25, J-13: the name may be in two columns; only the last column is read as a daily value."""

    def of(cols: Column) -> Column:
        def pick(ns: Column) -> Column:
            merged = ns["two"].isNotNull() & (ns["two"]["distance"] < F.coalesce(ns["one"]["distance"], F.lit(999)))
            near = F.when(merged, ns["two"]).otherwise(ns["one"])
            name = F.coalesce(display_of(near), cols[0])
            data = F.slice(cols, F.when(merged, 3).otherwise(2), F.size(cols))
            last = F.element_at(data, -1)
            vd = F.when(last.rlike(CLOUD_MARKS), "**").when(last.rlike("^[0-9]{1,3}$"), last)
            kept = F.when(vd.isNotNull() | last.rlike("^[0-9]{4,}$"), F.slice(data, 1, F.size(data) - 1)).otherwise(data)
            return F.when(F.size(data) == 0, name).otherwise(F.array_join(F.concat(F.array(name), kept, F.when(vd.isNotNull(), F.array(vd)).otherwise(F.array().cast("array<string>"))), "\t"))

        two = F.when(F.size(cols) > 1, nearest(F.concat(cols[0], F.lit(" "), F.get(cols, F.lit(1)))))
        return F.when(F.exists(cols, lambda c: c != ""), let(F.struct(nearest(cols[0]).alias("one"), two.alias("two")), pick)).otherwise(line)

    return F.when(F.contains(line, F.lit("\t")), let(F.transform(F.split(line, "\t", -1), stripped), of)).otherwise(line)


def rows(text: Column) -> Column:
    """F-09: array of (nutrient, values): cells by tabs if any line has one, else by two spaces, else at the first
    number; lines without a digit in a value are headings (P-14)."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r", -1), stripped), lambda x: x != "")
    shape = r"(?U)^([A-Za-zÀ-ÿ\s\-]+?)\s+([0-9].*)"

    def cells(line: Column) -> Column:
        wide = F.split(line, r"(?U)\s{2,}", -1)
        first = F.when((F.size(wide) == 1) & line.rlike(shape), F.array(F.regexp_extract(line, shape, 1), F.regexp_extract(line, shape, 2))).otherwise(wide)
        parts = F.when(F.exists(lines, lambda x: F.contains(x, F.lit("\t"))), F.split(line, "\t", -1)).otherwise(first)
        return F.filter(F.transform(parts, stripped), lambda x: x != "")

    structs = F.transform(F.transform(lines, cells), lambda c: F.struct(F.get(c, F.lit(0)).alias("nutrient"), F.slice(c, 2, F.greatest(F.size(c), F.lit(1))).alias("values")))
    return F.filter(structs, lambda r: F.exists(r["values"], lambda v: v.rlike("[0-9]")))


def columns(parsed: Column) -> Column:
    """A-19: the headings by the most values a row has; null without rows."""
    most = F.array_max(F.transform(parsed, lambda r: F.size(r["values"])))
    one, two = F.lit("Quantidade por porção"), F.lit("% VD")
    return F.when(most >= 2, F.array(one, two)).when(most.isNotNull(), F.array(one))


def serialized(parsed: Column) -> Column:
    """F-36: a line for each row."""
    return F.array_join(F.transform(parsed, lambda r: F.concat(r["nutrient"], F.lit(": "), F.array_join(r["values"], " | "))), "\n")
