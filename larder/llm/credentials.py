"""Secret scans by assignment-aware lexing (operator 10).

Base spans come from three patterns. The lexer then parses source and configuration syntax (``name = "x"``,
``name: x``, ``name: type = x``, ``"name": "x"``, ``export NAME=x``, ``name := x``, ``name => x``, ``cfg["name"] = x``, ``obj.name = x``, triple-quoted
literals) into pairs of a name and a literal or another name, or several joined by ``+``, propagates constants (``a = "x"`` then ``password = a``, which takes what ``a`` was given
last before; if it was given nothing before, all it is given later), and scores each literal by the names it
reaches and by its own shape. A quoted phrase of several words counts only where it reaches a name that is nearly always a secret's.
Two more forms give a pair that nothing is propagated through: quoted arguments side by side (``set("name", "x")``, ``("name", "x")``), and a
block below its name (``name: |`` and lines set in).
Every step takes time in proportion to the text's length, whatever it holds. Literals that score ``THRESHOLD`` or more and overlap no earlier span are added as
kind ``literal``.

Spans are in code points, end exclusive, the whole match. Defined cases: a null text is an empty one without spans;
repeated rows give repeated results; null ids stay null; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import releasing

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.7
#: The patterns of the base kinds and the least length of what they hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: How sensitive a target name is, by the words in it; the largest counts. Joined neighbours count too: api-key is apikey.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.95, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0, "auth": 0.7,
    "pass": 0.9, "passcode": 0.95, "pw": 0.85, "signingkey": 0.95, "encryptionkey": 0.95, "masterkey": 0.95, "sessionkey": 0.9, "sshkey": 0.95, "hostkey": 0.8, "clientkey": 0.9,
}
#: Names from which on a phrase of several words may be a secret; its words and its length.
PHRASE_NAME, PHRASE_WORDS, PHRASE_LENGTH = 0.95, range(3, 13), range(12, 121)
#: What a text must hold, JOINTS taken out, for any name in it to be sensitive enough: name_score joins neighbouring words.
HINTS, JOINTS = tuple(SENSITIVE), "_.-"
#: The type of a declaration, as in ``name: str = "x"``: what follows must be quoted, or set off by spaces.
TYPE = r"""(?:\??[\x20\t]*+:[\x20\t]*+[&*]?[A-Za-z_][A-Za-z0-9_.]*+(?:[<\[][^\n="']{0,60}[>\]])?(?:[\x20\t]*+\|[\x20\t]*+[A-Za-z_][A-Za-z0-9_.]*+){0,8}\??(?=[\x20\t]*+=[\x20\t]*+["']|[\x20\t]++=[\x20\t]++[^=\s]))?"""
VALUE = r"""(?:\"\"\"(?P<tdq>[^"]*+(?:"(?!"")[^"]*+)*+)\"\"\"|\'\'\'(?P<tsq>[^']*+(?:'(?!'')[^']*+)*+)\'\'\'|"(?P<dq>[^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|'(?P<sq>[^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'|(?P<bare>\$\{[A-Za-z_][A-Za-z0-9_.]*+\}|[^\s"',;{}()\[\]]++))"""
#: A run of name characters is looked at once, as a whole: no match begins inside it, and none gives a part of it back.
PAIR = re.compile(r"""(?<![A-Za-z0-9_.-])(?P<name>[A-Za-z0-9_.-]++)["']?\]?""" + TYPE + r"""[\x20\t]*+(?::=|=>|=(?!=)|:(?!//))[\x20\t]*+""" + VALUE, re.ASCII)
#: What is joined to a value by +, in the same line or the next.
JOINED = re.compile(r"""[\x20\t]*+\+[\x20\t]*+(?:\n[\x20\t]*+)?""" + VALUE, re.ASCII)
#: A quoted name and a quoted literal side by side.
ARGUMENTS = re.compile(r"""["'](?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)["'][\x20\t]*+,[\x20\t]*+(?:"(?P<dq>[^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|'(?P<sq>[^'\\\n]*+(?:\\.[^'\\\n]*+)*+)')""", re.ASCII)
#: A name on a line of its own, and the lines set in below it.
BLOCK = re.compile(r"""^(?P<in>[\x20\t]*+)(?:-[\x20\t]++)?["']?(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)["']?[\x20\t]*+:[\x20\t]*+[|>][+-]?[\x20\t]*+\n(?P<body>(?P=in)[\x20\t]++[^\s][^\n]*+(?:\n(?P=in)[\x20\t]++[^\s][^\n]*+)*+)""", re.ASCII | re.MULTILINE)
IDENTIFIER = re.compile(r"\$?\{?[A-Za-z_][A-Za-z0-9_.]*\}?", re.ASCII)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|changeme|example|none|null|true|false|your[_-].*|todo)$")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted. Cheap tests for what a match must hold come before the patterns."""
    found: list[tuple[int, int, int]] = []
    lowered = text.lower()
    if any(n in lowered for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if _has_hex(text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


_IS_HEX = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_RUN = b"1" * 32


def _has_hex(text: str) -> bool:
    return _RUN in text.encode("utf-8", "surrogatepass").translate(_IS_HEX)


def name_score(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    joined = {a + b for a, b in zip(words, words[1:])}
    return max([SENSITIVE.get(w, 0.0) for w in [*words, *joined]], default=0.0)


def literal_score(value: str, phrase: bool = False) -> float:
    """0 to 1 by length, mixture of character classes and entropy; placeholders and plain words score low. With ``phrase``,
    several words without a sentence's marks may be one too."""
    if len(value) < 6 or PLACEHOLDER.match(value):
        return 0.0
    if " " in value and not (phrase and len(value) in PHRASE_LENGTH and len(value.split()) in PHRASE_WORDS and not re.search("[.,;:!?]", value)):
        return 0.0
    n = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in n.values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.15 * classes + 0.12 * entropy + 0.01 * min(len(value), 40))


def _hinted(text: str) -> bool:
    lowered = text.lower()
    for joint in JOINTS:
        lowered = lowered.replace(joint, "")
    return any(h in lowered for h in HINTS)


@dataclass
class Given:
    """One assignment: what a name is given, in parts joined by +."""

    name: str
    parts: list[tuple[str, int, int, bool]]  # value, start, end, whether it is bare
    literal: list[tuple[str, int, int]] = field(default_factory=list)
    sources: list[int | str] = field(default_factory=list)  # places whose value it takes, or a name given only later


def assignments(text: str) -> list[Given]:
    """All assignments, in order, with what each takes from others."""
    given: list[Given] = []
    places: dict[str, list[int]] = {}  # name -> places in ``given``, rising
    m = PAIR.search(text)
    while m:
        parts, more = [], m
        while more:
            kind = next(k for k in ("tdq", "tsq", "dq", "sq", "bare") if more[k] is not None)
            parts.append((more[kind], more.start(kind), more.end(kind), kind == "bare"))
            end = more.end()
            more = JOINED.match(text, end)
        name = m["name"].lstrip("0123456789.-")
        if name:
            places.setdefault(name, []).append(len(given))
            given.append(Given(name, parts))
        m = PAIR.search(text, end)
    for i, g in enumerate(given):
        for value, start, end, bare in g.parts:
            other = value.strip("${}")
            if bare and other != g.name and IDENTIFIER.fullmatch(value) and (other in places or not any(c.isdigit() for c in value)):
                before = bisect.bisect_left(places.get(other, ()), i)
                if before:
                    g.sources.append(places[other][before - 1])
                elif other in places:
                    g.sources.append(other)
            elif value:
                g.literal.append((value, start, end))
    return given


def arguments(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, literal) of quoted arguments side by side, and of blocks, whose lines are put together."""
    for m in ARGUMENTS.finditer(text):
        kind = "dq" if m["dq"] is not None else "sq"
        yield m.start(kind), m.end(kind), m["name"], m[kind]
    for m in BLOCK.finditer(text) if ":" in text and ("|" in text or ">" in text) else ():
        lines = m["body"].split("\n")
        start = m.start("body") + len(lines[0]) - len(lines[0].lstrip(" \t"))
        yield start, m.end("body"), m["name"], "".join(line.strip(" \t") for line in lines)


def reached(given: list[Given]) -> list[float]:
    """For each assignment, how sensitive the most sensitive name is that its value reaches, its own included; 0 under THRESHOLD.

    Names are taken by falling sensitivity and followed back to what they take, so each assignment is met once."""
    score: dict[str, float] = {g.name: 0.0 for g in given}
    score = {name: name_score(name) for name in score}
    own: dict[str, list[int]] = {}
    for i, g in enumerate(given):
        own.setdefault(g.name, []).append(i)
    best, names = [0.0] * len(given), set()
    for start in sorted((i for i, g in enumerate(given) if score[g.name] >= THRESHOLD), key=lambda i: -score[given[i].name]):
        todo: list[int | str] = [start]
        while todo:
            at = todo.pop()
            if isinstance(at, str):
                if at not in names:
                    names.add(at)
                    todo += own[at]
            elif not best[at]:
                best[at] = score[given[start].name]
                todo += given[at].sources
    return best


def literal_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of literals that reach a sensitive name, directly or through other names. Joined literals are one span."""
    if not _hinted(text):
        return []
    given = assignments(text)
    starts, ends = [s for s, _, _ in taken], list(itertools.accumulate((e for _, _, e in taken), max))
    out: list[tuple[int, int, int]] = []

    def add(best: float, value: str, start: int, end: int, quoted: bool) -> None:
        score = literal_score(value, phrase=best >= PHRASE_NAME and quoted)
        before = bisect.bisect_left(starts, end)  # spans that begin before this one ends
        if score >= THRESHOLD * 0.75 and best * score >= THRESHOLD * 0.75 and not (before and ends[before - 1] > start):
            out.append((start, 3, end))

    for g, best in zip(given, reached(given)):
        if best and g.literal:
            start, end = g.literal[0][1], g.literal[-1][2]
            add(best, "".join(v for v, _, _ in g.literal).strip(), start, end, text[start - 1 : start] in ("'", '"'))
    own = {start for start, _, _ in out}
    for start, end, name, value in arguments(text):
        best = name_score(name)
        if best >= THRESHOLD and start not in own:
            add(best, value, start, end, True)
    return sorted(out)


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each sorted by start and then kind."""
    text = text or ""
    base = base_spans(text)
    return base, sorted({*base, *literal_spans(text, base)})


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span (overlapping ones as one) replaced by [SECRET]."""
    out, at, upto = [], 0, -1
    for s, _, e in sorted(found):
        if s < upto:
            upto = at = max(upto, e)
            continue
        out += [text[at:s], "[SECRET]"]
        at = upto = e
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), a row for each row of ``docs``."""
    schema = pa.schema([(id_col, pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                base, every = spans(t.as_py())
                n = Counter(k for _, k, _ in base)
                for column, value in zip(rows, (doc, n[0], n[1], n[2], hashlib.sha256(written(base).encode()).hexdigest(), written(every))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(releasing(run), f"`{id_col}` long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, secrets in ``text`` replaced, ``n_chars`` counted again where a text changed.

    Null and empty texts stay; overlapping spans are replaced as one; repeated rows stay alike; an empty table gives no rows."""

    def hide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for t in texts:
                t = t.as_py()
                found = spans(t)[1] if t else []
                out.append(redact(t, found) if found else t)
            yield pa.array(out, pa.string())

    new = docs.withColumn(text, F.arrow_udf(releasing(hide), "string")(F.col(f"`{text}`")))
    if n_chars and n_chars in docs.columns:
        same = F.coalesce(F.col(f"`{n_chars}`"), F.lit(0)) == F.length(f"`{text}`")
        new = new.withColumn(n_chars, F.when(F.col(f"`{text}`").isNull() | same, F.col(f"`{n_chars}`")).otherwise(F.length(f"`{text}`")).cast(docs.schema[n_chars].dataType))
    return new
