"""Hard-negative mining by norm-bucketed search (operator 11).

An anchor's positives are its best rows of the same label; for each of them, hard negatives are the best rows of other
labels whose score lies in a window under the positive's score, from ``low`` to ``high`` percent of it. Scores are inner
products of vectors in whole numbers, floor(256 * x).

Candidates are sorted by falling length and dealt out in groups of a bounded size; a task holds one group in the smallest
number type that fits, in buckets of ``CHUNK`` candidates. Anchors come in blocks. Both passes, first for positives and then for
negatives with the windows that these give, skip whatever the Cauchy-Schwarz bound |a| * |c| rules out:

- a block goes only to groups whose longest candidate may reach the least limit of one of its anchors;
- a window leaves the search at the first bucket whose longest candidate reaches neither its lower limit nor its running
  k-th score (lengths fall, so no later bucket does), and an anchor does with the last of its windows.

Running k-th scores start from the collection's longest rows (``HEAD``, a fixed number). In the first pass, only candidates of an anchor's
own label are multiplied with it. Each task gives the k best of each window, and those are ranked.

Defined cases: rows with a null id, a null label, a null vector, or a null, NaN or infinite component take no part; shorter vectors count as if
ended with zeros; rows with an anchor's own id are no candidates of it; candidates that repeat an id each count; an anchor id that
repeats is answered once, by its least label and vector; ties go to the smaller id; windows of a negative score are empty, of a score of zero hold
zero alone; fewer candidates give fewer rows; an empty table gives none; other columns, whatever their names, aren't read. Components
may be of any finite size: products that doubles can't hold exactly are done in exact integers, and a score outside 64 bits is given,
compared and ranked as the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import Written, releasing
from larder.llm.topk import EXACT, LONG, _integer, _matrix, _sound, quantized

SCALE = 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Longest rows that every search starts from; anchors in a block; bytes of a group of candidates; candidates in a bucket.
HEAD, ANCHORS, GROUP_BYTES, CHUNK = 256, 1024, 32 << 20, 2048
#: Steps in which the driver knows how lengths fall over all groups.
STEPS = 1024
NONE = -LONG - 1


class Kind:
    """How vectors are packed: whole numbers of the smallest type that fits all of them, or doubles in units of one."""

    def __init__(self, width: int, most: float) -> None:
        self.width = width
        self.type = next((np.dtype(t) for t, end in (("<i2", 2.0**15), ("<i4", 2.0**31)) if most * SCALE < end), np.dtype("<f8"))
        self.exact = most * SCALE * most * SCALE * width < EXACT

    def pack(self, m: np.ndarray) -> bytes:
        return (m if self.type.kind == "f" else m * SCALE).astype(self.type).tobytes()

    def unpack(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.type).reshape(-1, self.width)

    def numbers(self, m: np.ndarray) -> np.ndarray:
        """In the units of scores."""
        with np.errstate(over="ignore"):
            return m.astype(float) if self.type.kind == "i" else m * SCALE

    def norms(self, m: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.concatenate([np.empty(0), *(_sound(np.sqrt((self.numbers(m[i : i + CHUNK]) ** 2).sum(axis=1))) for i in range(0, len(m), CHUNK))])

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner products of all rows of ``a`` with all rows of ``b``."""
        if self.exact:
            return (self.numbers(a) @ self.numbers(b).T).astype(np.int64)
        whole = lambda m: np.array([[int(x) if self.type.kind == "i" else _integer(x, SCALE) for x in row] for row in m.tolist()], object).reshape(len(m), self.width)
        return np.clip(whole(a) @ whole(b).T, NONE + 1, LONG).astype(np.int64)


class Rows:
    """Some rows: ids, labels, vectors as they are packed, lengths."""

    def __init__(self, kind: Kind, ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> None:
        self.kind, self.ids, self.labels, self.m, self.norms = kind, ids, labels, m, kind.norms(m)

    def taken(self, at: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        out.kind, out.ids, out.labels, out.m, out.norms = self.kind, self.ids[at], self.labels[at], self.m[at], self.norms[at]
        return out


class Group:
    """Candidates by falling length, and the same of each label."""

    def __init__(self, rows: Rows) -> None:
        self.rows = rows.taken(np.lexsort((rows.ids, -rows.norms)))
        self.by_label = np.argsort(self.rows.labels, kind="stable")
        self.sorted_labels = self.rows.labels[self.by_label]

    def positives(self, a: Rows, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor's place, candidate id, score): the k best of the anchor's own label that reach its floor."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
        for label in np.unique(a.labels):
            own = np.flatnonzero(a.labels == label)
            at = self.by_label[np.searchsorted(self.sorted_labels, label) : np.searchsorted(self.sorted_labels, label, "right")]
            place, _, ids, scores = self._best(a.taken(own), at, floor[own, None], np.full((len(own), 1), LONG), k, False)
            found.append((own[place], ids, scores))
        return tuple(np.concatenate(x) for x in zip(*found))

    def negatives(self, a: Rows, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor's place, window, candidate id, score): the k best of other labels in each window."""
        return self._best(a, np.arange(len(self.rows.ids)), low, high, k, True)

    def _best(self, a: Rows, at: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, unlike: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        c, low, windows = self.rows, low.copy(), low.shape[1]
        rows, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for begin in range(0, len(at), CHUNK):
            bucket = at[begin : begin + CHUNK]
            with np.errstate(over="ignore", invalid="ignore"):
                reach = _sound(a.norms * c.norms[bucket[0]]) * (1 + 1e-9) + 1e-9  # no score here is greater
            live = (reach[:, None] >= low) & (low <= high)
            who = np.flatnonzero(live.any(axis=1))
            if not len(who):
                break
            s = c.kind.scores(a.m[who], c.m[bucket])
            out = a.ids[who, None] == c.ids[None, bucket]
            if unlike:
                out |= a.labels[who, None] == c.labels[None, bucket]
            s[out] = NONE
            parts = [(rows, ids, scores)]
            for w in range(windows):
                own = np.flatnonzero(live[who, w])
                t = s[own]
                good = (t >= low[who[own], w, None]) & (t <= high[who[own], w, None]) & (t > NONE)
                if len(bucket) > k and np.count_nonzero(good) > 4 * k * len(own):  # no more than the k best and their ties
                    good &= t >= np.partition(np.where(good, t, NONE), len(bucket) - k, axis=1)[:, len(bucket) - k, None]
                i, j = np.nonzero(good)
                parts.append((who[own[i]] * windows + w, c.ids[bucket[j]], t[i, j]))
            if sum(len(x[0]) for x in parts) == len(rows):
                continue
            rows, ids, scores = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((ids, -scores, rows))
            rows, ids, scores = rows[order], ids[order], scores[order]
            first = np.searchsorted(rows, rows)
            place = np.arange(len(rows)) - first
            kth = place == k - 1
            np.maximum.at(low, (rows[kth] // windows, rows[kth] % windows), scores[kth])
            rows, ids, scores = rows[place < k], ids[place < k], scores[place < k]
        return rows // windows, rows % windows, ids, scores

    def raised(self, a: Rows, low: np.ndarray, high: np.ndarray | None, k: int) -> np.ndarray:
        """Limits raised to the k-th score that this group has, where it has as many."""
        low = low.copy()
        place, w, _, scores = self.negatives(a, low, high, k) if high is not None else (lambda p, i, s: (p, np.zeros_like(p), i, s))(*self.positives(a, low[:, 0], k))
        row = place * low.shape[1] + w
        order = np.lexsort((-scores, row))
        row, scores = row[order], scores[order]
        kth = np.arange(len(row)) - np.searchsorted(row, row) == k - 1
        np.maximum.at(low, (row[kth] // low.shape[1], row[kth] % low.shape[1]), scores[kth])
        return low


def limits(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score s with low * p <= 100 * s <= high * p; where there is none, least is over all scores."""
    a, b = positive // 100, positive % 100
    least, most = a * low - (-b * low) // 100, a * high + b * high // 100
    return np.where(least <= most, least, LONG), np.where(least <= most, most, NONE)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``is_anchor`` is a condition on column ``id``."""
    label = F.col(label) if isinstance(label, str) else label
    spark, shown = vectors.sparkSession, ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    usable = quantized(vectors.where(label.isNotNull()), id_col, vector, SCALE, [label.cast("long").alias("label")])
    stored = Written(usable.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), "vectors")
    rows = stored.frame
    if not stored.rows:
        return spark.createDataFrame([], ", ".join(f"{c} {'int' if c == 'rank' else 'long'}" for c in shown))
    width, most = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width, kind = max(1, width), Kind(max(1, width), most or 0.0)
    packed = "ids array<long>, labels array<long>, m binary"

    def rows_of(ids: list, labels: list, raw: bytes) -> Rows:
        return Rows(kind, np.array(ids, np.int64), np.array(labels, np.int64), kind.unpack(raw))

    head = rows.orderBy(F.desc("norm"), "id").limit(HEAD).collect()  # a fixed number
    head_v = np.zeros((len(head), width))
    for i, r in enumerate(head):
        head_v[i, : len(r["v"])] = r["v"]
    head_ids, head_labels, head_m = [r["id"] for r in head], [r["label"] for r in head], kind.pack(head_v)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                longest = max(some.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([*(pa.array([some.column(i).to_pylist()], pa.list_(pa.int64())) for i in (0, 1)), pa.array([kind.pack(_matrix(some.column(2), width))], pa.binary()), pa.array([longest])], ["ids", "labels", "m", "norm"])

    each = max(1, GROUP_BYTES // (width * kind.type.itemsize))
    groups = max(-(-stored.rows // each), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored.rows // CHUNK)))
    dealt = rows.repartitionByRange(groups, F.desc("norm"), "id").select("id", "label", "v", "norm").mapInArrow(releasing(pack), packed + ", norm double")
    # ranges come from a sample: one that turned out large is cut in groups of the same size
    numbered = dealt.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), *("ids", "labels", "m", "norm"))
    pieces = F.expr(f"(at & {(1 << 33) - 1}) div {max(1, -(-each // 4096))}")
    candidates = Written(numbered.select("part", pieces.alias("piece"), "ids", "labels", "m", "norm"), "groups").frame
    parts = 1 + candidates.agg(F.max("part")).first()[0]  # a session may deal out more ranges than asked for
    step = -(-parts // STEPS)
    longest = np.full(-(-parts // step), -np.inf)
    for s, norm in candidates.groupBy(F.expr(f"part div {step}")).agg(F.max("norm")).collect():  # at most STEPS
        longest[s] = norm * SCALE
    longest = np.maximum.accumulate(longest[::-1])[::-1]

    anchors = rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v")

    def matches(anchors: DataFrame, windows: int, k: int, tag: str) -> DataFrame:
        """(anchor_id, w, id, score): the k best of each anchor's windows in each group; ``anchors`` has positives' scores, in array ``p``, if
        negatives are wanted."""
        mining = "p" in anchors.columns

        def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            everyone = Group(rows_of(head_ids, head_labels, head_m))
            for batch in batches:
                for at in range(0, batch.num_rows, ANCHORS):
                    some = batch.slice(at, ANCHORS)
                    ids, labels, raw = some.column(0).to_pylist(), some.column(1).to_pylist(), kind.pack(_matrix(some.column(2), width))
                    a = rows_of(ids, labels, raw)
                    least, greatest = np.full((len(ids), windows), NONE + 1 if not mining else LONG), np.full((len(ids), windows), LONG if not mining else NONE)
                    if mining:
                        for i, p in enumerate(some.column(3).to_pylist()):
                            least[i, : len(p)], greatest[i, : len(p)] = limits(np.array(p, np.int64), low, high)
                    least = everyone.raised(a, least, greatest if mining else None, k)
                    lowest = np.where(least <= greatest, least, LONG).min(axis=1).astype(float)
                    with np.errstate(all="ignore"):  # room for rounding; a limit of zero or less is reached by candidates of any length
                        need = np.where(lowest > 0, _sound(lowest / a.norms) * (1 - 1e-6) - 1e-6, -np.inf)
                        need = np.where(np.isfinite(a.norms), need, -np.inf)
                        need = np.where((least <= greatest).any(axis=1), need, np.inf)
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(least.tolist(), pa.list_(pa.int64())), pa.array(greatest.tolist(), pa.list_(pa.int64())), pa.array(need)], ["id", "label", "v", "low", "high", "need"])

        def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ANCHORS):
                    some = batch.slice(at, ANCHORS)
                    reach = min(int(np.searchsorted(-longest, -min(some.column(5).to_pylist()), "right")) * step - 1, parts - 1)
                    numbers = [pa.array([np.array(some.column(i).to_pylist(), "<i8").tobytes()], pa.binary()) for i in (3, 4)]
                    yield pa.RecordBatch.from_arrays([*(pa.array([some.column(i).to_pylist()], pa.list_(pa.int64())) for i in (0, 1)), pa.array([kind.pack(_matrix(some.column(2), width))], pa.binary()), *numbers, pa.array([reach], pa.int32())], ["ids", "labels", "m", "low", "high", "reach"])

        def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, group = None, [], None
            for batch in batches:
                for part, piece, role, ids, labels, m, least, greatest in zip(*(batch.column(i).to_pylist() for i in range(8))):
                    if (part, piece) != key:
                        key, held, group = (part, piece), [], None
                    if role == 0:
                        held.append((ids, labels, m))
                        continue
                    if group is None:
                        if not held:
                            continue
                        group = Group(rows_of(sum((x[0] for x in held), []), sum((x[1] for x in held), []), b"".join(x[2] for x in held)))
                        held = [None]
                    a, least, greatest = rows_of(ids, labels, m), np.frombuffer(least, "<i8").reshape(-1, windows), np.frombuffer(greatest, "<i8").reshape(-1, windows)
                    if mining:
                        place, w, found, scores = group.negatives(a, least, greatest, k)
                    else:
                        place, found, scores = group.positives(a, least[:, 0], k)
                        w = np.zeros(len(place), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(a.ids[place]), pa.array(w, pa.int32()), pa.array(found), pa.array(scores)], ["anchor_id", "w", "id", "score"])

        asked = Written(anchors.mapInArrow(releasing(ask), "id long, label long, v array<double>, low array<long>, high array<long>, need double"), f"{tag}-asked")
        # few full blocks of anchors that need much the same lengths
        ordered = asked.frame.where("need < double('infinity')").repartitionByRange(max(1, -(-asked.rows // ANCHORS)), F.desc("need"), "id").sortWithinPartitions(F.desc("need"), "label", "id")
        blocks = ordered.mapInArrow(releasing(fill), packed + ", low binary, high binary, reach int").where("reach >= 0")
        reached = blocks.select(F.explode(F.expr("sequence(0, reach)")).alias("part"), F.lit(1).alias("role"), "ids", "labels", "m", "low", "high")
        there = candidates.select("part", "piece").distinct()
        sent = reached.join(F.broadcast(there) if parts <= STEPS else there, "part").select("part", "piece", "role", "ids", "labels", "m", "low", "high")
        none = F.lit(None).cast("binary")
        members = candidates.select("part", "piece", F.lit(0).alias("role"), "ids", "labels", "m", none.alias("low"), none.alias("high"))
        by = ["part", "piece"]
        return members.unionByName(sent).repartition(*by).sortWithinPartitions(*by, "role").mapInArrow(releasing(search), "anchor_id long, w int, id long, score long")

    def ranked(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    chosen = ranked(matches(anchors, 1, positives, "positives"), positives)
    chosen = Written(chosen.select("anchor_id", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives").frame
    scores = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "positive_score"))), lambda x: x["positive_score"]).alias("p"))
    mined = ranked(matches(anchors.join(scores, "id").select("id", "label", "v", "p"), positives, negatives, "negatives"), negatives)
    out = mined.select("anchor_id", "w", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(chosen, ["anchor_id", "w"]).select(*shown)


def oracle(every: int, label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> str:
    return f"""
    with e as (select vec_id, {label} as label, list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as v from embeddings
               where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
          from (select * from e where vec_id % {every} = 0) a join e b on a.vec_id <> b.vec_id),
    p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
          qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {positives})
    select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
           vec_id as negative_id, positive_score, score as negative_score
    from p join s using (anchor_id) where not same and {low} * positive_score <= 100 * score and 100 * score <= {high} * positive_score
    qualify rank <= {negatives}
    """
