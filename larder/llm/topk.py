"""Exact top-k inner products over norm-sorted, SVD-rotated vectors (operator 2).

Vectors become integers, floor(64 * x), which are held divided by 64, so that no finite component is too large to hold. The right singular vectors of the whole collection, from its Gram matrix
(a sum over all rows, dimension squared in size), rotate them so that the first coordinates carry most of every
inner product. Candidates are dealt out by falling length; each task holds one group of them, and the queries pass
in blocks. A query's k-th best score over the collection's longest vectors (``HEAD``, a fixed number) is its floor; queries
are put in blocks by the length a candidate needs to reach it, and a block goes only to groups whose longest candidate
may reach one of its floors. For a block, candidates are taken in chunks by falling length:

- when |q| * |c| of the chunk's longest candidate is under a query's k-th best score, that query is done;
- else the partial sum over the first coordinates plus the Cauchy-Schwarz bound of the rest, |q'| * |c'|, must
  reach it; only survivors get their exact integer product.

Each task gives its k best of each query, and those are ranked.

Defined cases: vectors that are null or hold a null, NaN or infinite component take no part, nor do rows with a null
id; shorter vectors count as if ended with zeros; a query's own id is no candidate; candidates that repeat an id
each count; a query id that repeats is answered once, by its least vector; ties go to the smaller id; fewer than k
candidates give fewer rows; an empty table gives none; other columns, whatever their names, aren't read. Components may
be of any finite size: products beyond 2 ** 53 are done in exact integers, and a score outside 64 bits is given, and
ranked, as the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import Written, releasing

SCALE = 64
#: Longest vectors every task starts from; queries in a block; candidates in a group and in a chunk.
HEAD, QUERIES, GROUP, CHUNK = 256, 1024, 32768, 2048
#: Steps in which the driver knows how lengths fall over all groups.
STEPS = 1024
#: Above this, float64 sums of products may not be exact integers.
EXACT = 2.0**53
LONG = 2**63 - 1


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, keep: Sequence[Column] = ()) -> DataFrame:
    """(id, v, and columns to ``keep``): usable vectors, each component floor(64 * x) / 64 (or by another power of two up to 2 ** 16), which
    a double holds exactly."""
    v = F.col(vector).cast("array<double>")
    usable = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor() would give a 64-bit integer; 64 times a number beyond 2 ** 46 is whole already
    whole = F.transform(v, lambda x: F.when(F.abs(x) < 2.0**46, F.floor(x * scale).cast("double") / scale).otherwise(x))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), *keep)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lens, out = np.diff(offsets), np.zeros((len(column), width))
    if len(lens) and (lens == width).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, width).copy()
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[i, : b - a] = values[a:b]
    return out


def _rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows, by falling singular value; the Gram matrix is summed where the rows are."""

    def gram(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), width)
            scale = max(1.0, float(np.abs(m).max(initial=0)) / 2.0**400)
            m = m / scale if scale > 1 else m
            total += m.T @ m
        at = np.arange(width * width, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "x"])

    sums = rows.select("v").mapInArrow(releasing(gram), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()  # width ** 2
    g = np.zeros(width * width)
    for at, x in sums:
        g[at] = x
    g = g.reshape(width, width)
    if not np.isfinite(g).all() or not g.any():
        return np.eye(width)
    return np.linalg.eigh(g / np.abs(g).max())[1][:, ::-1].copy()


def _integer(x: float, scale: int = SCALE) -> int:
    """64 * x, exactly."""
    return int(x * scale) if abs(x) < 2.0**900 else int(x) * scale


def _sound(x: np.ndarray) -> np.ndarray:
    """A bound that is no number, from components beyond all squares, bounds nothing."""
    return np.where(np.isnan(x), np.inf, x)


class Rotated:
    """Vectors in the units of scores: lengths, first coordinates after the rotation, lengths of the rest."""

    def __init__(self, v: np.ndarray, rotation: np.ndarray, first: int) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = v * SCALE
            self.norms = _sound(np.sqrt((scaled * scaled).sum(axis=1)))
            rotated = scaled @ rotation
            self.first = rotated[:, :first].copy()
            self.rest = _sound(np.sqrt((rotated[:, first:] ** 2).sum(axis=1)))


class Group:
    """Candidates of one group, by falling length, ready for blocks of queries."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, rotation: np.ndarray, first: int) -> None:
        with np.errstate(over="ignore"):
            order = np.lexsort((ids, -np.sqrt((v * v).sum(axis=1))))
        self.ids, self.v, self.first = ids[order], v[order], first
        self.by = Rotated(self.v, rotation, first)

    def best(self, q_ids: np.ndarray, q: np.ndarray, rotation: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, candidate id, score): the k best of each query in this group that reach its floor."""
        with np.errstate(over="ignore", invalid="ignore"):
            return self._best(q_ids, q, Rotated(q, rotation, self.first), floor.copy(), k)

    def _best(self, q_ids: np.ndarray, q: np.ndarray, by: Rotated, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        norms = self.by.norms
        rows, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(self.v).max(initial=0)) * max(1, q.shape[1]) * SCALE * SCALE < EXACT
        for at in range(0, len(self.ids), CHUNK):
            to = min(at + CHUNK, len(self.ids))
            slack = _sound(1e-9 * (1 + by.norms * norms[at]))
            live = np.flatnonzero(_sound(by.norms * norms[at]) + slack >= floor)  # lengths fall: the others are done
            if not len(live):
                break
            bound = _sound(by.first[live] @ self.by.first[at:to].T + by.rest[live, None] * self.by.rest[None, at:to])
            i, j = np.nonzero((bound + slack[live, None] >= floor[live, None]) & (q_ids[live, None] != self.ids[None, at:to]))
            if not len(i):
                continue
            if not exact:
                s = np.array([_clamped(sum(_integer(a) * _integer(b) for a, b in zip(q[live[x]], self.v[at + y]))) for x, y in zip(i, j)], object)
            elif len(i) > 0.05 * len(live) * (to - at):
                s = (q[live] @ self.v[at:to].T)[i, j] * (SCALE * SCALE)
            else:
                s = np.einsum("ij,ij->i", q[live[i]], self.v[at + j]) * (SCALE * SCALE)
            good = s >= floor[live[i]]
            rows, ids, scores = np.concatenate([rows, live[i][good]]), np.concatenate([ids, self.ids[at + j][good]]), np.concatenate([scores, s[good]])
            rows, ids, scores = _top(rows, ids, scores, k)
            full = np.bincount(rows, minlength=len(q_ids)) >= k
            last = np.append(np.flatnonzero(rows[1:] != rows[:-1]), len(rows) - 1) if len(rows) else np.empty(0, np.int64)
            for r, s_last in zip(rows[last], scores[last]):
                if full[r]:
                    floor[r] = max(floor[r], _below(s_last))
        return rows, ids, scores

    def floors(self, q_ids: np.ndarray, q: np.ndarray, rotation: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each query here, or minus infinity if there are fewer."""
        none = np.full(len(q_ids), -np.inf)
        r, _, s = self.best(q_ids, q, rotation, none, k)
        n = np.bincount(r, minlength=len(q_ids))
        for x in np.flatnonzero(n >= k):
            none[x] = _below(s[np.searchsorted(r, x, "right") - 1])
        return none


def _below(score) -> float:
    """A floor that a score reaches even if it is no double: large integers are rounded."""
    return float(score) if abs(score) < EXACT else float(score) - abs(float(score)) * 1e-9


def _clamped(x: int) -> int:
    return max(-LONG - 1, min(LONG, x))


def _top(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if scores.dtype == object:
        order = np.array(sorted(range(len(rows)), key=lambda x: (rows[x], -scores[x], ids[x])), np.int64)
    else:
        order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    start = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1]) if len(rows) else np.empty(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
    return rows[place < k], ids[place < k], scores[place < k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score). ``is_query`` is a condition on column ``id``."""
    stored = Written(quantized(vectors, id_col, vector).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), "vectors")
    rows = stored.frame
    schema = f"query_id long, `{id_col}` long, score long"
    if not stored.rows:
        return rows.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.lit(0).cast("long").alias("score"))
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0])
    rotation, first = _rotation(rows, width), max(1, width // 2)
    head = rows.orderBy(F.desc("norm"), "id").limit(HEAD).collect()  # a fixed number
    head_ids, head_v = np.array([r["id"] for r in head], np.int64), np.zeros((len(head), width))
    for i, r in enumerate(head):
        head_v[i, : len(r["v"])] = r["v"]
    groups = -(-stored.rows // GROUP)
    # Lengths are dealt out in ranges, ties by id, so that no length, however common, makes a range long
    groups = max(groups, min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored.rows // 1024)))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([_matrix(some.column(1), width).tobytes()], pa.binary()), pa.array([pc.max(some.column(2)).as_py()])], ["ids", "m", "norm"])

    dealt = rows.repartitionByRange(groups, F.desc("norm"), "id").select("id", "v", "norm").mapInArrow(releasing(pack), "ids array<long>, m binary, norm double")
    candidates = Written(dealt.select(F.spark_partition_id().alias("g"), "ids", "m", "norm"), "groups").frame
    groups = 1 + candidates.agg(F.max("g")).first()[0]  # a session may deal out more ranges than asked for
    step = -(-groups // STEPS)
    longest = np.full(-(-groups // step), -np.inf)
    for s, norm in candidates.groupBy(F.expr(f"g div {step}")).agg(F.max("norm")).collect():  # at most STEPS
        longest[s] = norm * SCALE
    longest = np.maximum.accumulate(longest[::-1])[::-1]

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everyone = Group(head_ids, head_v, rotation, first)
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                some = batch.slice(at, QUERIES)
                ids, m = some.column(0).to_numpy(), _matrix(some.column(1), width)
                floor = everyone.floors(ids, m, rotation, k)
                with np.errstate(all="ignore"):
                    norms = Rotated(m, rotation, first).norms
                    # with room for rounding; a floor of zero or less is reached by candidates of any length
                    need = np.where(floor > 0, _sound(floor / norms) * (1 - 1e-6) - 1e-6, -np.inf)
                    need = np.where(np.isfinite(norms), need, -np.inf)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(floor), pa.array(need)], ["id", "v", "floor", "need"])

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                some = batch.slice(at, QUERIES)
                reach = int(np.searchsorted(-longest, -min(some.column(3).to_numpy()), "right")) * step - 1
                yield pa.RecordBatch.from_arrays([pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([_matrix(some.column(1), width).tobytes()], pa.binary()), pa.array([some.column(2).to_numpy().tobytes()], pa.binary()), pa.array([min(reach, groups - 1)], pa.int32())], ["ids", "m", "floors", "reach"])

    asked = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    asked = Written(asked.mapInArrow(releasing(ask), "id long, v array<double>, floor double, need double"), "asked")
    # few full blocks of queries that need much the same lengths
    sorted_ = asked.frame.repartitionByRange(max(1, -(-asked.rows // QUERIES)), F.desc("need"), "id").sortWithinPartitions(F.desc("need"), "id")
    filled = sorted_.mapInArrow(releasing(fill), "ids array<long>, m binary, floors binary, reach int").where("reach >= 0")
    blocks = filled.select(F.explode(F.expr("sequence(0, reach)")).alias("g"), F.lit(1).alias("role"), "ids", "m", "floors")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, ready = None, [], None
        for batch in batches:
            for g, role, ids, m, floors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                if g != group:
                    group, held, ready = g, [], None
                ids, m = np.array(ids, np.int64), np.frombuffer(m.as_py()).reshape(-1, width)
                if role == 0:
                    held.append((ids, m))
                    continue
                if not held:
                    continue
                if ready is None:
                    ready, held = Group(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), rotation, first), [None]
                r, c, s = ready.best(ids, m, rotation, np.frombuffer(floors.as_py()), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(c), pa.array([int(x) for x in s], pa.int64())], ["query_id", id_col, "score"])

    members = candidates.select("g", F.lit(0).alias("role"), "ids", "m", F.lit(None).cast("binary").alias("floors"))
    found = members.unionByName(blocks).repartition("g").sortWithinPartitions("g", "role").mapInArrow(releasing(search), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), id_col, "score")


def oracle(k: int, every: int) -> str:
    return f"""
    with q as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as double)) as v from embeddings
               where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.v, b.v) as bigint) as score
               from (select * from q where vec_id % {every} = 0) a join q b on a.vec_id <> b.vec_id),
    ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
    select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= {k}
    """
