"""Vector code compression: product codebooks found with norm-of-sum bounds (operator 13).

A vector is cut into parts and each part is replaced by the index of the nearest entry of its position's codebook.
Rounds move the entries. A part keeps two bounds: the distance to its own entry and the least distance to any other
one, each with the round in which it was measured. All codebooks of earlier rounds are kept, so a bound is carried to
the present round by the true displacement of an entry since that round (the norm of the sum of its moves), which is
never more than the sum of the moves' norms. Only parts whose bounds then overlap are measured again. Sums are kept as
whole numbers and bounds with a margin for rounding, so the codes are those of a full search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer.llm.tables import removed, saved, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SLACK = 1e-12  # relative; far above the rounding of a square root, far below what decides between entries
AT_ONCE = 1 << 22  # components compared with all entries at a time

_SPARK = "v array<int>, near array<smallint>, up array<double>, up_at array<smallint>, low array<double>, low_at array<smallint>"


class Bounds(NamedTuple):
    """Per part (rows x parts): nearest entry, bound above its distance, bound below all others', and their rounds."""

    near: np.ndarray
    up: np.ndarray
    up_at: np.ndarray
    low: np.ndarray
    low_at: np.ndarray


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of parts (n x d) to entries (k x d), as whole numbers."""
    step = max(1, AT_ONCE // max(1, entries.size))
    out = np.empty((len(parts), len(entries)), np.int64)
    for at in range(0, len(parts), step):
        gap = parts[at : at + step, None, :] - entries[None, :, :]
        out[at : at + step] = np.einsum("nkd,nkd->nk", gap, gap)
    return out


def displacements(history: np.ndarray) -> np.ndarray:
    """How far each entry lies from where it was in each round: rounds x parts x entries, rounded up."""
    gap = (history - history[-1]).astype(np.float64)
    return np.sqrt((gap * gap).sum(-1)) * (1 + SLACK)


def _scan(v: np.ndarray, book: np.ndarray, now: int, p: int, rows: np.ndarray, b: Bounds) -> None:
    """Measure the given rows' part against the whole codebook."""
    if not len(rows):
        return
    d = squared(v[rows, p], book[p])
    near = d.argmin(axis=1)  # the first of equal ones
    least = d[np.arange(len(rows)), near].astype(np.float64)
    d[np.arange(len(rows)), near] = np.iinfo(np.int64).max
    b.near[rows, p], b.up_at[rows, p], b.low_at[rows, p] = near, now, now
    b.up[rows, p] = np.sqrt(least) * (1 + SLACK)
    b.low[rows, p] = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - SLACK)


def start(v: np.ndarray, book: np.ndarray) -> Bounds:
    """Bounds of the first round: everything is measured."""
    shape = v.shape[:2]
    whole = lambda: np.zeros(shape, np.int64)
    b = Bounds(whole(), np.zeros(shape), whole(), np.zeros(shape), whole())
    for p in range(shape[1]):
        _scan(v, book, 0, p, np.arange(len(v)), b)
    return b


def advance(v: np.ndarray, b: Bounds, history: np.ndarray) -> tuple[Bounds, int]:
    """Bounds after the newest codebooks of ``history`` (rounds x parts x entries x d), and how many parts were scanned."""
    now, book, moved = len(history) - 1, history[-1], displacements(history)
    b, scanned = Bounds(*[x.copy() for x in b]), 0
    for p in range(v.shape[1]):
        own = moved[:, p, :]
        far = own.argmax(axis=1)
        most, rest = own.max(axis=1), own.copy()
        rest[np.arange(len(own)), far] = 0.0
        second = rest.max(axis=1)
        near = b.near[:, p]
        others = np.where(far[b.low_at[:, p]] == near, second[b.low_at[:, p]], most[b.low_at[:, p]])
        low = b.low[:, p] - others
        open_ = np.flatnonzero(~(b.up[:, p] + own[b.up_at[:, p], near] < low * (1 - SLACK)))
        if not len(open_):
            continue
        gap = v[open_, p] - book[p][near[open_]]
        b.up[open_, p] = np.sqrt((gap * gap).sum(axis=1).astype(np.float64)) * (1 + SLACK)
        b.up_at[open_, p] = now
        again = open_[~(b.up[open_, p] < low[open_] * (1 - SLACK))]
        _scan(v, book, now, p, again, b)
        scanned += len(again)
    return b, scanned


def errors(v: np.ndarray, near: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to its code, summed over parts."""
    out = np.zeros(len(v), np.int64)
    for p in range(v.shape[1]):
        gap = v[:, p] - book[p][near[:, p]]
        out += (gap * gap).sum(axis=1)
    return out


def moved_book(book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each entry becomes the mean of its parts, rounded down; an entry without parts stays."""
    means = sums // np.maximum(counts, 1)[..., None]
    return np.where(counts[..., None] > 0, means, book)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    flat = values.reshape(len(values), -1)
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()).cast(kind))


def _read(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _bounds(batch: pa.RecordBatch, parts: int) -> Bounds:
    return Bounds(*[_read(batch, n, parts).astype(np.float64 if n in ("up", "low") else np.int64) for n in Bounds._fields])


def _round(history: np.ndarray):
    """A round over a task's vectors: their new bounds, and one row of how the sums of the entries change."""
    _, parts, entries, d = history.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, d), np.int64), np.zeros((parts, entries), np.int64)
        row = None
        for batch in batches:
            row = batch.schema.field("row").type
            if not batch.num_rows:
                continue
            v = _read(batch, "v", parts * d).astype(np.int64).reshape(-1, parts, d)
            if len(history) == 1:
                old, new = None, start(v, history[0])
            else:
                old = _bounds(batch, parts)
                new, _ = advance(v, old, history)
            for p in range(parts):
                gone = np.arange(len(v)) if old is None else np.flatnonzero(old.near[:, p] != new.near[:, p])
                np.add.at(sums[p], new.near[gone, p], v[gone, p])
                np.add.at(counts[p], new.near[gone, p], 1)
                if old is not None:
                    np.subtract.at(sums[p], old.near[gone, p], v[gone, p])
                    np.subtract.at(counts[p], old.near[gone, p], 1)
            n = batch.num_rows
            kept = [_lists(x, pa.float64() if name in ("up", "low") else pa.int16()) for name, x in zip(Bounds._fields, new)]
            none = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("v"), *kept, none, none],
                names=["row", "v", *Bounds._fields, "sums", "counts"],
            )
        if row is not None:
            none = [pa.nulls(1, row), pa.nulls(1, pa.list_(pa.int32()))]
            none += [pa.nulls(1, pa.list_(pa.float64() if n in ("up", "low") else pa.int16())) for n in Bounds._fields]
            totals = [_lists(x.reshape(1, -1), pa.int64()) for x in (sums, counts)]
            yield pa.RecordBatch.from_arrays([*none, *totals], names=["row", "v", *Bounds._fields, "sums", "counts"])

    return run


def _last(history: np.ndarray):
    _, parts, _, d = history.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _read(batch, "v", parts * d).astype(np.int64).reshape(-1, parts, d)
            new = advance(v, _bounds(batch, parts), history)[0] if len(history) > 1 else start(v, history[0])
            error = errors(v, new.near, history[-1])
            yield pa.RecordBatch.from_arrays([batch.column("row"), _lists(new.near, pa.int16()), pa.array(error)], names=["row", "code", "error"])

    return run


class Compressed(NamedTuple):
    """``rows``: the carried columns with ``code`` (entry index by part) and ``error``; ``codebooks``: parts x entries x d."""

    rows: DataFrame
    codebooks: np.ndarray


def _usable(vector: Column) -> Column:
    x = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))


def _totals(state: DataFrame, column: str) -> np.ndarray:
    """The sum over tasks of one array, by place; as long as the codebooks."""
    rows = state.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    return np.array([r["x"] for r in sorted(rows.collect())], np.int64)


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    carried: Sequence[str] | None = None,
) -> Compressed:
    """Codes of all vectors whose components are present and finite; rows with other vectors are dropped.

    Components become floor(scale * x). The codebooks start as the parts of the smallest ``entries`` ids (nulls last,
    ties by vector; repeated rows count each) and move ``rounds`` times. Only the codebooks pass through the driver.
    The vectors and their bounds are written to the shared folder once a round, and the table before is removed.

    Codes are exact in 64-bit numbers for scaled components up to 2**30 / sqrt(length). Vectors beyond that, and those
    of another length than the first one whose length ``parts`` divides, keep a null code and a null error. With fewer
    vectors than entries the codebooks are smaller; an empty table gives no rows. ``carried`` names the columns kept
    beside the code (all but the vector).
    """
    spark = vectors.sparkSession
    carried = [c for c in vectors.columns if c != vector] if carried is None else list(carried)
    own = vectors.where(_usable(F.col(f"`{vector}`"))).select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"),
        F.col(f"`{vec_id}`").alias("id"),
        F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale)))).alias("v"),
    )
    row_type = own.schema["row"].dataType
    fitting = own.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    first = fitting.orderBy(F.asc_nulls_last("id"), "v").select("v").first()
    dims = len(first["v"]) if first else parts
    limit = int(2**30 / np.sqrt(dims))
    good = (F.size("v") == dims) & F.forall("v", lambda x: F.abs(x) <= limit)
    least = own.where(good).orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()
    if not least:
        rows = own.select("row.*", F.lit(None).cast("array<smallint>").alias("code"), F.lit(None).cast("bigint").alias("error"))
        return Compressed(rows, np.zeros((parts, 0, dims // parts), np.int64))
    begin = np.array([r["v"] for r in least], np.int64).reshape(len(least), parts, -1).swapaxes(0, 1)
    history = begin[None]
    shape = begin.shape
    sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)

    state = own.where(good).select("row", F.col("v").cast("array<int>").alias("v"))
    schema = T._parse_datatype_string(f"{_SPARK}, sums array<bigint>, counts array<bigint>")
    schema = T.StructType([T.StructField("row", row_type), *schema.fields])
    path = None
    for _ in range(rounds):
        before, path = path, saved(state.mapInArrow(_round(history), schema), "codes")
        if before:
            removed(spark, before)
        table = spark.read.schema(schema).parquet(path)
        sums = sums + _totals(table, "sums").reshape(shape)
        counts = counts + _totals(table, "counts").reshape(shape[:2])
        history = np.concatenate([history, moved_book(history[-1], sums, counts)[None]])
        state = table.where("v is not null").select("row", "v", *Bounds._fields)
    done = T.StructType([T.StructField("row", row_type), *T._parse_datatype_string("code array<smallint>, error bigint").fields])
    coded = state.mapInArrow(_last(history), done)
    odd = own.where(~good).select("row", F.lit(None).cast("array<smallint>").alias("code"), F.lit(None).cast("bigint").alias("error"))
    rows = written(coded.unionByName(odd), "coded")
    if path:
        removed(spark, path)
    return Compressed(rows.select("row.*", "code", "error"), history[-1])


def codebooks_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in order, decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows, codebooks = compress(vectors)
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(by_label, rows["label"].eqNullSafe(by_label["of"])).select(
        "vec_id",
        F.array_join(F.transform("code", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "").alias("code"),
        "error",
        "label_error",
        F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"),
    )


def _op13_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same codes by a full search in every round."""
    gap = "list_sum(list_transform(list_zip(x.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = (
        "SELECT x.row, x.p, any_value(x.x) AS x, min({gap} * 256 + c.e) AS best FROM parts x JOIN book{t} c ON x.p = c.p GROUP BY x.row, x.p"
    )
    steps = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
            list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS (SELECT row, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) r(p))""",
        f"book0 AS (SELECT p, row - 1 AS e, x FROM parts WHERE row <= {entries})",
    ]
    for t in range(rounds + 1):
        steps.append(f"near{t} AS ({nearest.format(gap=gap, t=t)})")
        if t < rounds:
            steps.append(f"""sums{t} AS (
              SELECT p, e, place, sum(i)::BIGINT AS s, count(*) AS n
              FROM (SELECT p, best % 256 AS e, unnest(x) AS i, generate_subscripts(x, 1) AS place FROM near{t}) GROUP BY p, e, place)""")
            steps.append(f"""book{t + 1} AS (
              SELECT b.p, b.e, coalesce(any_value(m.x), any_value(b.x)) AS x FROM book{t} b LEFT JOIN (
                SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY place) AS x FROM sums{t} GROUP BY p, e) m USING (p, e)
              GROUP BY b.p, b.e)""")
    steps.append(f"""coded AS (
      SELECT row, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error
      FROM near{rounds} GROUP BY row)""")
    steps.append(f"""books AS (
      SELECT sha256(string_agg(i::VARCHAR, ',' ORDER BY p, e, place)) AS codebooks_sha256
      FROM (SELECT p, e, unnest(x) AS i, generate_subscripts(x, 1) AS place FROM book{rounds}))""")
    return f"""WITH {", ".join(steps)}
      SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
      FROM kept JOIN coded USING (row), books"""


OP13_SQL = _op13_sql()
