"""Operator 13 against a plain version in Python."""

import hashlib
import re

from larder.llm import fim
from tests.llm.cases import ROWS, no_documents, odd_documents

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain(doc, text, seed=7, rate=100, spm=50):
    text, x = text or "", hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert "".join(units) == text
    a, b = sorted(k % (len(units) + 1) for k in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, p, m, s, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["a\nb\nc\nd\ne", "\n\n\n", "one line", "ends\n", "<", "<P\n<S\n<M\n>", "a<P>b\nc", "x\n<M>\n", "S>\nP>\n<", "\r\n\r\n", "  not a line\x85\n", "漢\n\U0001f600\n\0\n", "a\n" * 3000, None, "", "line " * 50_000 + "\nshort"]


def test_forms_cuts_and_restoring(spark):
    cases = [(i * 7 + k, t, 1, 2) for i, t in enumerate(TEXTS) for k in range(6)] + [(None, "a\nb\nc", 1, 2), (1, "a\nb\nc", 1, 2), (1, "a\nb\nc", 1, 2)]
    docs = spark.createDataFrame(cases, "doc_id long, text string, output int, _row int")
    for rate, spm in ((100, 50), (60, 0), (100, 100)):
        rows = fim.transformed(docs, 7, rate, spm)
        assert rows.columns == ["doc_id", "text", "_row", *fim.PARTS]
        rows = rows.withColumn("back", fim.restored(rows.output, rows.form)).collect()
        assert len(rows) == len(cases)
        for r in rows:
            assert (r.n, r.form, r.prefix, r.middle, r.suffix, r.output) == plain(r.doc_id, r.text, 7, rate, spm)
            assert r.back == (r.text or "") and r._row == 2
    forms = {r.form for r in fim.transformed(docs, 7, 60, 50).collect()}
    assert forms == {"plain", "psm", "spm"}


def test_outputs_that_are_none(spark):
    bad = spark.createDataFrame([("<P>a<M>b<S>c", "psm"), ("no marks", "spm"), ("<P>a<S>b<M>c", "spm"), (None, "psm"), (None, "plain")], "output string, form string")
    assert [r[0] for r in bad.select(fim.restored(bad.output, bad.form)).collect()] == [None] * 5


def test_digest(spark):
    got = sorted(map(tuple, fim.digest(odd_documents(spark)).collect()), key=str)
    want = []
    for doc, text, *_ in ROWS:
        n, form, p, m, _, out = plain(doc, text)
        want.append((doc, n, form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(text or "")))
    assert got == sorted(want, key=str)
    assert fim.digest(no_documents(spark)).collect() == []
    plan = fim.digest(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
