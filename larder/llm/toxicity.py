"""Toxicity by noisy-channel deobfuscation (operator 3).

1. Runs of four symbols of all texts are counted (a table of at most 28 ** 4 numbers) and make a character language model.
2. In each text, tokens that look disguised (symbols or digits inside a word, look-alike letters of other scripts among
   Latin ones, letters three times in a row or twice in several places, single letters spaced out) become a lattice:
   each character offers the letters it may stand for, repeated letters may be one or two, a mask may be any letter,
   separators may be nothing or end a word. Viterbi takes the likeliest letters under channel and model, for tokens of
   any length, and the restored text takes their place.
3. A logistic regression on the words and beginnings of words of the restored text scores it: those that labelled
   texts tie to the label, so that inflected forms of a word, seen or not, count alike. It is fitted on at most
   ``FIT_ROWS`` labelled texts, chosen by hash, one for each sketch, so that copies of one text don't count many times.

Defined cases: null and empty texts get the score of a text without telling words; labels with null ids or other
values than 0 and 1 aren't learned from; without usable labels every score is 0; a document with several labels is
learned from once for each; repeated rows give repeated results; rows with a null id get a row, with a null held_out;
an empty table gives no rows. Labels, language, source and id are never inputs of a score; other columns aren't read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Written, releasing

#: Bound on labelled texts the classifier is fitted on; ids with this remainder are held out.
FIT_ROWS, FOLDS, HELD_OUT = 20_000, 3, 1
CUT = 0.7
#: A telling word, or a beginning of words (written with ^): least labelled texts with it, least share of label 1 among
#: them, lengths of beginnings.
LEAST, SHARE, BEGINNINGS = 5, 0.8, (4, 5, 6, 7)
#: A telling word is sure if so large a share, and so many, of its texts have label 1; sure words share one more weight.
SURE, SURE_LEAST = 0.98, 8
#: A candidate that adds so little to a kept, longer one is left out.
SAME = 0.95
#: Symbols of the model (boundary, a to z, any other letter), and how many of them a count is of.
SIZE, ORDER = 28, 4
#: What a shorter context is worth when a longer one is seldom seen, in counts.
BACKOFF = 4.0

WORD = re.compile(r"[^\W\d_]+")
#: What a character, or two, may stand for besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
PAIRS = {"()": "o", "[]": "o", "vv": "w"}
#: Letters of other scripts and the Latin ones they look like.
ALIKE = dict(zip("аеорсухіјѕкмтвнԁɡӏαορνικτ", "aeopcyxijskmtbhdglaopvikt"))
#: The channel's costs in nats: a stand-in, a look-alike, a dropped symbol, two for three and more, one for two, a mask for a letter.
LEET_COST, ALIKE_COST, DROP_COST, DOUBLE_COST, SINGLE_COST, MASK_COST = 1.0, 0.5, 9.0, 1.0, 6, 4.0
#: What may stand between letters: nothing, or the end of a word; and those of them that may hide a letter, in tokens with so
#: many or fewer: with more, little of a word is left to tell them by.
SEPARATORS, MASKS, MASKED = " .-_*#%()[]", "*#%_", 3
#: Readings of tokens up to so long are remembered; longer ones are decoded each time.
REMEMBERED = 40
_S = r"0-9@$!|+(€£"  # may stand for letters
_L = "a-zA-Z" + "".join(ALIKE) + "".join(ALIKE).upper() + "\uff21-\uff3a\uff41-\uff5a"
_UNIT = rf"(?:[{_L}@$!|+€£0-9]|\(\)|\[\]|\()"
INSIDE = re.compile(rf"(?<![\w@$!|+(€£*]){_UNIT}++(?:[*#%.\-_]{{1,3}}{_UNIT}++)*+")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*][^\W_]){2,}(?![^\W_])")
#: Two of the single letters of SPACED at its end: a cheap test for what SPACED would find.
SPACES = re.compile(r"[ .\-_*][^\W_][ .\-_*][^\W_](?![^\W_])")
TRIPLE = re.compile(r"([a-zA-Z])\1\1")
TWICE = re.compile(r"([a-zA-Z])\1[a-zA-Z]{0,3}([a-zA-Z])\2")
AFTER = re.compile(r"[^\W_]*")
#: A symbol or digit between letters, before a word or after one. It begins with a set of characters, which is found fast.
DISGUISE = re.compile(r"(?s)[0-9@$!|+(€£*#%.\-_\[](?:(?<=[a-zA-Z].)[0-9@$!|+()€£*#%.\-_\]]*[a-zA-Z]|(?<!\w.)(?:(?<=[0-9@$!|+€£])|(?<=[(\[])[)\]])[a-zA-Z]|(?<=[a-zA-Z].)(?<=[0-9@$|+(€£])(?!\w))")
FOREIGN = re.compile(rf"[a-zA-Z0-9][{''.join(ALIKE)}]|[{''.join(ALIKE)}][a-zA-Z0-9]|[\uff21-\uff3a\uff41-\uff5a]")


def _codes() -> np.ndarray:
    """By code point (last entry: all beyond the table): 0 boundary, 1 to 26 a to z, 27 another letter."""
    out = np.zeros(0x3001, np.uint8)
    for c in range(0x3000):
        ch = chr(c).lower()
        out[c] = ord(ch) - 96 if len(ch) == 1 and "a" <= ch <= "z" else 27 if ch[0].isalpha() else 0
    out[0x3000] = 27
    return out


_CODES = _codes()


def gram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): how often each run of ORDER symbols occurs in all texts, each by itself; boundaries next to each other are
    one. Runs that begin with two boundaries, outside a text, aren't counted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**ORDER, np.int64)
        apart = " " * (ORDER - 1)
        for batch in batches:
            column = batch.column(0)
            for i in range(0, len(column), 256):
                texts = [t for t in column.slice(i, 256).to_pylist() if t]
                points = np.frombuffer((apart + "".join(t + apart for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
                codes = _CODES[np.minimum(points, 0x3000)]
                keep = np.ones(len(codes), bool)
                keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
                ends = np.cumsum([len(apart), *(len(t) + len(apart) for t in texts)])
                keep[ends[:, None] - 1 - np.arange(len(apart))] = True  # what stands between texts stays whole
                c = codes[keep].astype(np.int32)
                if len(c) >= ORDER:
                    grams = c[: 1 - ORDER]
                    for k in range(1, ORDER):
                        grams = grams * SIZE + c[k : len(c) - ORDER + 1 + k]
                    total += np.bincount(grams[(c[: 1 - ORDER] > 0) | (c[1 : 2 - ORDER] > 0)], minlength=SIZE**ORDER)
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int32)), pa.array(total[grams])], ["gram", "n"])

    return docs.select(text).mapInArrow(releasing(run), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


State = tuple[int, ...]


@dataclass
class Channel:
    """The language model and the Viterbi decoder."""

    cost: np.ndarray  # -log P(last | those before), indexed by ORDER symbols

    @staticmethod
    def of(counts: np.ndarray) -> Channel:
        grams = counts.reshape((SIZE,) * ORDER).astype(np.float64)
        p = (grams.sum(axis=tuple(range(ORDER - 1))) + 1) / (grams.sum() + SIZE)
        for n in range(2, ORDER + 1):  # each context with what the shorter one says
            c = grams.sum(axis=tuple(range(ORDER - n)))
            p = (c + BACKOFF * p[None]) / (c.sum(axis=-1, keepdims=True) + BACKOFF)
        return Channel((-np.log(p)).astype(np.float32))

    def options(self, token: str) -> list[list[tuple[str, float]]]:
        """The lattice: for each character, run of equal ones or pair, what it may stand for and at which cost."""
        chars = unicodedata.normalize("NFKC", token).lower()
        hides = 0 < sum(map(chars.count, MASKS)) <= MASKED
        steps, i = [], 0
        while i < len(chars):
            c, run = chars[i], 1
            if chars[i : i + 2] in PAIRS:
                steps.append([(PAIRS[chars[i : i + 2]], LEET_COST)] + ([(c * 2, 0.0)] if c.isalpha() else [("", DROP_COST)]))
                i += 2
                continue
            while i + run < len(chars) and chars[i + run] == c and chars[i + run : i + run + 2] not in PAIRS:
                run += 1
            one, two = (0.0, math.inf) if run == 1 else (SINGLE_COST, 0.0) if run == 2 else (0.0, DOUBLE_COST)
            stands = [(c, 0.0)] if c.isalpha() else []
            stands += [(x, LEET_COST) for x in LEET.get(c, "")] + ([(ALIKE[c], ALIKE_COST)] if c in ALIKE else [])
            options = [(x * n, cost + extra) for x, cost in stands for n, extra in ((1, one), (2, two)) if extra < math.inf]
            if not c.isalpha():
                options.append(("", DROP_COST if c in LEET and c not in SEPARATORS else 0.0))
            if c in SEPARATORS:
                options.append((" ", 0.0))
            if hides and c in MASKS and run < 3 and 0 < i and chars[i - 1].isalpha() and chars[i + run : i + run + 1].isalpha():
                masks = options + [(chr(k), MASK_COST) for k in range(97, 123)]
                steps += [masks] * run
            else:
                steps.append(options)
            i += run
        return steps

    def price(self, state: State, letters: str) -> tuple[float, State]:
        """What the model asks for these letters (a space ends a word), and the state after them."""
        total = 0.0
        for ch in letters:
            k = ord(ch) - 96 if "a" <= ch <= "z" else 0 if ch == " " else 27
            total += self.cost[state][k]
            state = (*state[1:], k) if k or state[-1] else state
        return total, state

    def decode(self, token: str) -> str:
        """The likeliest letters behind a token. States are the last letters; ties go to the earlier reading."""
        # what was read so far is a chain of (chain before, letters), so that a step costs the same at any length
        best: dict[State, tuple[float, tuple | None]] = {(0,) * (ORDER - 1): (0.0, None)}
        for options in self.options(token):
            new: dict[State, tuple[float, tuple | None]] = {}
            for state, (cost, read) in best.items():
                for letters, extra in options:
                    if letters == " " and state[-1] == 0:
                        continue
                    more, after = self.price(state, letters)
                    total = cost + extra + more
                    if after not in new or total < new[after][0]:
                        new[after] = (total, (read, letters) if letters else read)
            best = new
        ended = ((cost + (float(self.cost[state][0]) if state[-1] else 0.0), read) for state, (cost, read) in best.items())
        read = min(ended, key=lambda r: r[0])[1]
        out = []
        while read is not None:
            read, letters = read
            out.append(letters)
        return "".join(reversed(out)).strip()


def _around(text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Where the words with a match of the pattern begin and end."""
    out: list[tuple[int, int]] = []
    for m in pattern.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        start = m.start()
        while start > (out[-1][1] if out else 0) and text[start - 1].isalnum():
            start -= 1
        out.append((start, AFTER.match(text, m.end()).end()))
    return out


class Restorer:
    """Restores texts; remembers decoded tokens."""

    def __init__(self, channel: Channel) -> None:
        self.channel, self.known = channel, {}

    def _decoded(self, token: str) -> str:
        if len(token) > REMEMBERED:
            return self.channel.decode(token)
        if token not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[token] = self.channel.decode(token)
        return self.known[token]

    def _replaced(self, text: str, places: list[tuple[int, int]]) -> str:
        out, at = [], 0
        for a, b in places:
            out += [text[at:a], self._decoded(text[a:b])]
            at = b
        return "".join(out) + text[at:]

    def restore(self, text: str) -> str:
        """The text with what looks disguised replaced by its likeliest reading."""
        foreign = not text.isascii() and FOREIGN.search(text)
        if foreign or DISGUISE.search(text):
            text = INSIDE.sub(lambda m: self._decoded(m[0]) if DISGUISE.search(m[0]) or foreign and FOREIGN.search(m[0]) else m[0], text)
        if SPACES.search(text):
            text = SPACED.sub(lambda m: self._decoded(m[0]), text)
        for pattern in (TRIPLE, TWICE):
            places = _around(text, pattern)
            if places:
                text = self._replaced(text, places)
        return text

    def words(self, text: str) -> set[str]:
        return set(WORD.findall(self.restore(text).lower()))

    def among(self, text: str, known: Telling) -> set[str]:
        """Those of the telling words and beginnings that the restored text has."""
        restored = self.restore(text).lower()
        # a text is cut into words only if it holds a telling one at all
        words = set(WORD.findall(restored)) if any(w in restored for w in known.bare) else ()
        return {f for w in words for f in known.of(w)}


class Telling:
    """Words, and beginnings of words (written with ^)."""

    def __init__(self, features: list[str]) -> None:
        self.index = {f: i for i, f in enumerate(features)}
        self.bare = sorted({f.lstrip("^") for f in features})
        self.lengths = sorted({len(f) - 1 for f in features if f[0] == "^"})

    def of(self, word: str) -> list[str]:
        own = [word] if word in self.index else []
        return own + [f for n in self.lengths if (f := "^" + word[:n]) in self.index and len(word) >= n]


def features_of(words: set[str]) -> set[str]:
    """Words and their beginnings."""
    return words | {"^" + w[:n] for w in words for n in BEGINNINGS if len(w) >= n}


def choose(candidates: list[tuple[str, int]]) -> list[str]:
    """Of candidates (feature, texts of label 1) those that matter: the most frequent first; no word under a kept
    beginning, no beginning that a kept word or longer beginning stands for nearly always."""
    kept: list[tuple[str, int]] = []
    for f, p in sorted(candidates, key=lambda c: (-c[1], c[0][0] == "^", -len(c[0]), c[0])):
        bare = f.lstrip("^")
        below = any(k[0] == "^" and bare.startswith(k[1:]) for k, _ in kept)
        same = f[0] == "^" and any(k.lstrip("^").startswith(bare) and n >= SAME * p for k, n in kept)
        if not below and not same:
            kept.append((f, p))
    return [f for f, _ in kept]


@dataclass
class Model:
    cost: np.ndarray  # the language model's
    words: list[str]
    weights: np.ndarray
    intercept: float
    some: float = 0.0  # what any sure word adds, besides its own weight
    sure: frozenset[str] = frozenset()

    def score(self, found: set[str], known: Telling) -> float:
        z = self.intercept + self.some * (not self.sure.isdisjoint(found)) + sum(self.weights[known.index[w]] for w in found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def sketch(words: list[str]) -> int:
    """The least hash of a text's runs of four words; copies and near copies mostly share it."""
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    return min(map(xxhash.xxh3_64_intdigest, runs), default=0) - (1 << 63)


def learnable(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str) -> DataFrame:
    """(text, y): at most FIT_ROWS labelled texts with the least hashes of those not held out."""
    fold = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(FOLDS))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold != HELD_OUT)).distinct()
    chosen = known.orderBy(F.xxhash64("id"), "id", "y").limit(FIT_ROWS)  # bounded, so it can be broadcast
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("text", "y")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Counts of all texts, and the regression fitted on the bounded sample."""
    counts = np.zeros(SIZE**ORDER, np.int64)
    found = gram_counts(docs, text).toArrow()  # at most SIZE ** ORDER rows
    counts[found["gram"].to_numpy()] = found["n"].to_numpy()
    channel = Channel.of(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(channel)
        for batch in batches:
            keys, words, ys = [], [], []
            for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
                t = t.as_py() or ""
                keys.append(sketch(t.lower().split())), words.append(sorted(features_of(restorer.words(t)))), ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(ys, pa.int32())], ["sketch", "words", "y"])

    rows = learnable(docs, labels, id_col, text, label).mapInArrow(releasing(run), "sketch long, words array<string>, y int")
    written = Written(rows.groupBy("sketch", "y").agg(F.min("words").alias("words")), "labelled")  # read three times
    one = written.frame
    tied = one.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    # frequent ones of label 1; of a bounded sample they are few
    found = {r["w"]: r for r in tied.where((F.col("n") >= LEAST) & (F.col("p") >= SHARE * F.col("n"))).collect()}
    words = choose([(w, r["p"]) for w, r in found.items()])
    sure = frozenset(w for w in words if found[w]["p"] >= max(SURE_LEAST, SURE * found[w]["n"]))
    if not words:
        totals = one.agg(F.sum("y"), F.count(F.lit(1))).first()
        written.drop()
        rate = (totals[0] or 0) / totals[1] if totals[1] else 0.0
        return Model(channel.cost, [], np.zeros(0), math.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))
    index = set(words)

    def telling(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[w for w in ws if w in index] for ws in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.string()))], ["y", "found"])

    patterns = one.select("y", "words").mapInArrow(releasing(telling), "y int, found array<string>").groupBy("y", "found").count().collect()  # at most FIT_ROWS
    written.drop()
    return Model(channel.cost, words, *_fit(words, sure, [(r["found"], r["y"], r["count"]) for r in patterns]), sure)


def _fit(words: list[str], sure: frozenset[str], rows: list[tuple[list[str], int, int]], ridge: float = 0.2) -> tuple[np.ndarray, float, float]:
    """Weighted logistic regression with a ridge penalty, by Newton's method: a weight for each word, the intercept,
    and a weight for texts with any of the sure words, which few labels are enough to learn."""
    at = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(rows), len(words) + 2))
    x[:, -1] = 1
    for i, (found, _, _) in enumerate(rows):
        x[i, [at[w] for w in found]] = 1
        x[i, -2] = not sure.isdisjoint(found)
    y, n = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    penalty = np.full(len(words) + 2, ridge)
    penalty[-2:] = ridge / 10, 1e-6
    beta = np.zeros(len(words) + 2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (n * (y - p)) - penalty * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-2], float(beta[-1]), float(beta[-2])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``."""
    schema = pa.schema([(id_col, pa.int64()), ("score", pa.float64())])
    channel = Channel(model.cost)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, known = Restorer(channel), Telling(model.words)
        for batch in batches:
            scores = [model.score(restorer.among(t.as_py() or "", known), known) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=schema)

    scored = docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(releasing(run), f"`{id_col}` long, score double")
    held = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT
    return scored.select(id_col, held.alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` whose text scores under CUT. Null and empty texts score as any without telling words;
    repeated rows are judged alike; an empty table gives no rows."""
    channel = Channel(model.cost)

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restorer, known = Restorer(channel), Telling(model.words)
        for texts in batches:
            yield pa.array([model.score(restorer.among(t.as_py() or "", known), known) < CUT for t in texts], pa.bool_())

    return docs.where(F.arrow_udf(releasing(judge), "boolean")(F.col(f"`{text}`")))
