"""Nutrition lines: values derived by hand from the rules, and the state machine against a plain version."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from larder.operators import nutrition as N

TABLE = str.maketrans("ÚúUOoQlIiSZsz", "0000001115522")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def plain_vd(cell):
    cell = cell.strip()
    if not cell:
        return None
    if re.search("[*'»«]", cell):
        return "**"
    read = cell.translate(TABLE)
    found = re.search("[0-9]{1,3}", read)
    return None if "," in read else found[0] if found else "**"


def slip(number, unit):
    return unit == "g" and number.isdigit() and number.endswith("9") and int(number) >= 100


def plain_quantity(cells, unit):
    number, own, vd = "", "", None
    for cell in cells:
        if not cell:
            continue
        if re.search("[*'»«]", cell):
            vd = "**"
            continue
        text = cell[:-1] + "g" if unit == "g" and re.fullmatch("[0-9]+[.,][0-9]*9", cell) else cell
        text = text.translate(TABLE)
        kcal = re.search("([0-9]+(?:[.,][0-9]+)?)\\s*kca[l1]", text, re.I) if unit == "kcal" else None
        if kcal:
            number, own = kcal[1], "kcal"
            continue
        if unit and re.fullmatch("[A-Za-z]+", text) and distance(text.lower(), unit) <= 2:
            own = unit if number and not own else own
            continue
        m = re.match("^([0-9]+(?:[.,][0-9]+)?)\\s*([A-Za-z0-9]+)?\\s*$", text)
        if not m:
            vd = plain_vd(cell) if number and vd is None else vd
        elif m[2]:
            if unit and distance(m[2].lower(), unit) <= 2:
                number, own = m[1], unit
            elif slip(m[1], unit):
                number, own = m[1][:-1], unit
            else:
                number, own = m[1], m[2]
        elif number:
            vd = text if re.fullmatch("[0-9]{1,3}", text) else plain_vd(cell)
        else:
            number = m[1]
    if not number:
        return "", vd
    if not own and slip(number, unit):
        number = number[:-1]
    return f"{number} {own or unit or ''}".strip(), vd


CELLS = ["", "12 g", "159", "1,49", "S", "g", "75 kcal = 315kJ", "l2 mg", "4", "**", "»", "2%", "abc", "45272", "1,2", "20q", "999 xyz"]


@pytest.mark.parametrize("unit", ["g", "mg", "kcal", None])
def test_cells_equal_a_plain_state_machine(spark, unit):
    cases = [list(c) for n in (1, 2) for c in itertools.product(CELLS, repeat=n)] + [[a, "9", b] for a in CELLS for b in CELLS]
    df = spark.createDataFrame([(i, c, unit) for i, c in enumerate(cases)], "i int, c array<string>, u string")
    got = {r["i"]: (r["q"]["quantity"], r["q"]["vd"]) for r in df.select("i", N.quantity(F.col("c"), F.col("u")).alias("q")).collect()}
    wrong = [(c, got[i], plain_quantity(c, unit)) for i, c in enumerate(cases) if got[i] != plain_quantity(c, unit)]
    assert not wrong, wrong[:5]


def one(spark, function, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("t"))).collect()]


def test_digits_pair_positionally(spark):
    assert one(spark, N.digits, "SZszUuÚOoQlIi") == ["55220u0000111"]
    assert one(spark, N.digits, "Z", "s", "u") == ["5", "2", "u"]


def test_lines(spark):
    got = one(spark, N.postprocess, "Carboidrato\t159\t5", "Proteinas 1,49 g 2", "Valor Energetico 75 kcal = 315 k) 4", "Sodio 30 mq **", "qualquer coisa", "Gorduras Trans 0 g", "")
    assert got == ["Carboidratos\t15 g\t5", "Proteínas 1,4 g 2", "Valor Energético 75kcal=315kJ 4", "Sódio 30 mg **", "qualquer coisa", "Gorduras Trans 0 g", ""]


def test_cloud_takes_a_double_quote(spark):
    assert one(spark, N.cloud_line, 'Sodio\t30 mg\t"') == ["Sódio\t30 mg\t**"]
    assert one(spark, N.cloud_line, "Gorduras\tsaturadas\t2 g\t45272", "no tabs", "\t") == ["Gorduras Saturadas\t2 g", "no tabs", "\t"]
    assert one(spark, N.daily_value, '"') == ["**"]  # not a mark here, but nothing that can be read


def test_rows(spark):
    got = one(spark, N.rows, "INFORMAÇÃO\nSódio  10 mg  2", "Fibra 3 g", "Sódio\t10\nFibra alimentar 3", "", "só texto")
    plain = [[(r["nutrient"], list(r["values"])) for r in x] for x in got]
    assert plain == [[("Sódio", ["10 mg", "2"])], [("Fibra", ["3 g"])], [("Sódio", ["10"])], [], []]


def test_lines_repaired_once_equal_lines_repaired_in_place(spark):
    texts = ["Sodio\t30 mq\t**\nProteinas 1,49 g 2", None, "", "Sodio\t30 mq\t**", "Sodio\t30 mq\t**", "a\r\nb\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["out"] for r in N.postprocessed(df, "t", "out").collect()}
    want = {r["i"]: r["w"] or "" for r in df.select("i", N.postprocess(F.col("t")).alias("w")).collect()}
    assert got == want and len(got) == len(texts)
