"""Product codes of vectors: one codebook for each part, trained by Lloyd rounds under Yinyang bounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnmill.llm.common import materialise

#: Parts of a vector, entries of a codebook (256 at most: a code is a byte a part), rounds, entries in a group on
#: average, and the steps in a unit to which components are rounded down.
PARTS, ENTRIES, ROUNDS, PER_GROUP, SCALE = 16, 64, 2, 8, 256
#: Vectors that are compared at once.
ROWS_AT_ONCE = 4096
#: Most rows of the table of sums by label that are broadcast; a longer one is joined with salted labels.
LABELS, SALTS = 100_000, 32

_FAR = np.iinfo(np.int64).max


def most(dims: int) -> int:
    """The largest size of a component for which all squared distances of ``dims`` dimensions fit 63 bits."""
    return 1 << ((61 - max(1, dims - 1).bit_length()) // 2)


def usable(v: Column) -> Column:
    """Neither null nor with null, NaN or infinite components."""
    inf = F.lit(float("inf"))
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))


def _below(d: np.ndarray) -> np.ndarray:
    """Roots of squared distances as half floats, rounded down; beyond their range the largest one."""
    root = np.where(d == _FAR, np.inf, np.sqrt(d.astype(np.float64)))
    near = np.minimum(root, 65504.0).astype(np.float16)
    near = np.where(near.astype(np.float64) > root, np.nextafter(near, np.float16(0)), near)
    return np.where(np.isinf(root), np.float16(np.inf), near)


def _above(d: np.ndarray) -> np.ndarray:
    """Roots of squared distances as half floats, rounded up; beyond their range infinite."""
    root = np.sqrt(d.astype(np.float64))
    with np.errstate(over="ignore"):
        near = root.astype(np.float16)
    return np.where(near.astype(np.float64) < root * (1 + 1e-15), np.nextafter(near, np.float16(np.inf)), near)


def entry_groups(books: np.ndarray, per_group: int = PER_GROUP) -> np.ndarray:
    """(parts, entries) number of the group of each entry: a few Lloyd rounds over the entries themselves."""
    parts, entries, _ = books.shape
    n = max(1, entries // per_group)
    out = np.zeros((parts, entries), np.int64)
    for p in range(parts):
        x = books[p].astype(np.float64)
        centre = x[np.linspace(0, entries - 1, n).astype(int)]
        for _ in range(5):
            out[p] = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
            centre = np.array([x[out[p] == g].mean(axis=0) if (out[p] == g).any() else centre[g] for g in range(n)])
    return out


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(rows, entries) exact squared distances of integers."""
    diff = x[:, None, :] - entries[None]
    return np.einsum("rek,rek->re", diff, diff)


def assign_all(x: np.ndarray, book: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, upper, lower) of the rows of one part by comparing every entry: the nearest entry, its distance from
    above, and for each group the distance of its nearest other entry from below."""
    d = squared(x, book)
    code = d.argmin(axis=1)  # the first of equals
    upper = _above(d[np.arange(len(x)), code])
    d[np.arange(len(x)), code] = _FAR
    return code, upper, _below(_group_least(d, group, n_groups))


def _group_least(d: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    return np.stack([d[:, group == g].min(axis=1, initial=_FAR) for g in range(n_groups)], axis=1)


def assign_again(x, book, group, drift, code, upper, lower):
    """(code, upper, lower, scanned) after the entries of one part have moved by at most ``drift`` each.

    The distance to the own entry has grown by its drift at most, and that to a group has shrunk by the largest drift
    in it at most. A group whose bound stays above the distance to the own entry holds nothing nearer or equally near
    and is not read. The others are compared in integers, so that equal distances are told exactly and the lower
    index wins. ``scanned`` counts the distances that were computed.
    """
    n_groups, rows = lower.shape[1], np.arange(len(x))
    moved = np.array([drift[group == g].max(initial=0.0) for g in range(n_groups)])
    high, low = upper.astype(np.float64) + drift[code], lower.astype(np.float64) - moved
    code, upper, lower = code.copy(), _outward(high, True), _outward(low, False)
    at = rows[low.min(axis=1) <= high]  # the other rows keep their entry
    if not len(at):
        return code, upper, lower, 0
    own = code[at]
    best = ((x[at] - book[own]) ** 2).sum(axis=1)
    reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-12)
    upper[at] = _above(best)
    open_group = low[at] <= reach[:, None]
    d = np.full((len(at), len(book)), _FAR, np.int64)
    for g in range(n_groups):
        members, hit = np.flatnonzero(group == g), np.flatnonzero(open_group[:, g])
        if len(members) and len(hit):
            d[np.ix_(hit, members)] = squared(x[at[hit]], book[members])
    scanned = len(at) + int(sum(open_group[:, g].sum() * (group == g).sum() for g in range(n_groups)))
    d[np.arange(len(at)), own] = best
    new = d.argmin(axis=1)
    code[at], upper[at] = new, _above(d[np.arange(len(at)), new])
    d[np.arange(len(at)), new] = _FAR
    least, fresh = _below(_group_least(d, group, n_groups)), lower[at]
    # a group that was read has a new bound; one that was not may have got the former entry back
    lower[at] = np.where(open_group, least, np.minimum(fresh, least))
    return code, upper, lower, scanned


def _outward(v: np.ndarray, up: bool) -> np.ndarray:
    with np.errstate(over="ignore"):
        near = (v if up else np.clip(v, -65504.0, None)).astype(np.float16)
    wide = near.astype(np.float64)
    if up:
        return np.where(wide < v, np.nextafter(near, np.float16(np.inf)), near)
    near = np.where(np.isinf(near) & ~np.isinf(v), np.float16(65504.0), near)
    return np.where(near.astype(np.float64) > v, np.nextafter(near, np.float16(-np.inf)), near)


_STATE = T.StructType([T.StructField(c, T.BinaryType()) for c in ("ints", "code", "upper", "lower")])


def _matrix(col: pa.Array, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, *shape)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x).reshape(len(x), -1)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * width), pa.py_buffer(x.tobytes())])


def first_state(rows: DataFrame, books: np.ndarray, groups: np.ndarray) -> DataFrame:
    """(id, label, ints, code, upper, lower) of the rows (id, label, v) after a full comparison."""
    parts, _, size = books.shape
    n_groups = int(groups.max()) + 1
    schema = T.StructType([*rows.schema.fields[:2], *_STATE.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                piece = batch.slice(at, ROWS_AT_ONCE)
                x = piece.column(2).flatten().to_numpy().astype(np.int32).reshape(-1, parts, size)
                wide, found = x.astype(np.int64), [None] * parts
                for p in range(parts):
                    found[p] = assign_all(wide[:, p], books[p], groups[p], n_groups)
                code, upper, lower = (np.stack([f[k] for f in found], axis=1) for k in range(3))
                cols = [piece.column(0), piece.column(1), _binary(x), _binary(code.astype(np.uint8)), _binary(upper), _binary(lower)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return rows.select("id", "label", "v").mapInArrow(run, schema)


def next_state(state: DataFrame, books: np.ndarray, groups: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The state after the entries have become ``books``, each moved by ``drift`` (parts, entries), and ``error``, the
    squared distances to the assigned entries summed over the parts."""
    parts, _, size = books.shape
    n_groups = int(groups.max()) + 1
    schema = T.StructType([*state.schema.fields[:6], T.StructField("error", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                piece = batch.slice(at, ROWS_AT_ONCE)
                x = _matrix(piece.column(2), np.int32, parts, size).astype(np.int64)
                code, upper, lower = _matrix(piece.column(3), np.uint8, parts).astype(np.int64), _matrix(piece.column(4), np.float16, parts), _matrix(piece.column(5), np.float16, parts, n_groups)
                found = [assign_again(x[:, p], books[p], groups[p], drift[p], code[:, p], upper[:, p], lower[:, p]) for p in range(parts)]
                code, upper, lower = (np.stack([f[k] for f in found], axis=1) for k in range(3))
                error = sum(((x[:, p] - books[p][code[:, p]]) ** 2).sum(axis=1) for p in range(parts))
                cols = [piece.column(0), piece.column(1), piece.column(2), _binary(code.astype(np.uint8)), _binary(upper), _binary(lower), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return state.select("id", "label", "ints", "code", "upper", "lower").mapInArrow(run, schema)


def moved_entries(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries as means, rounded down, of the parts assigned to them; unused ones stay.

    Each task adds up its rows and sends a number for each component of an entry; so many numbers reach the driver.
    """
    parts, entries, size = books.shape
    schema = "slot int, n long, s long"
    arrow = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("s", pa.int64())])

    def run(batches):
        sums, counts = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x, code = _matrix(batch.column(0), np.int32, parts, size), _matrix(batch.column(1), np.uint8, parts).astype(np.int64)
            slot = (code + np.arange(parts) * entries).reshape(-1)
            np.add.at(sums, slot, x.reshape(-1, size).astype(np.int64))
            counts += np.bincount(slot, minlength=len(counts))
        used = np.flatnonzero(counts)
        slots = (used[:, None] * size + np.arange(size)).reshape(-1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.repeat(counts[used], size)), pa.array(sums[used].reshape(-1))], schema=arrow)

    total = state.select("ints", "code").mapInArrow(run, schema).groupBy("slot").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = books.reshape(-1).copy()
    for slot, n, s in total.toLocalIterator():
        out[slot] = int(s) // n
    return out.reshape(books.shape)


def compress_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error) of the usable rows, final codebooks (parts, entries, size)).

    Components become ``floor(scale * x)``. The codebooks start as the parts of the ``entries`` smallest ids. A round
    assigns every part to its nearest entry, the lower index among equals, and moves the entries to the rounded-down
    means; after the last round parts are assigned once more. ``code`` is a byte for each part, ``error`` the squared
    distance in total.

    The entries of each codebook are clustered into groups once. A part keeps an upper bound of the distance to its
    entry and a lower bound for each group (half floats rounded outwards, two bytes each); after a round bounds move by
    the drift of the entries, and only groups whose bound then fails are compared, in integers (``assign_again``). The
    state of the rows is written to the shared folder once a round. Rows never move: a task sends its sums alone, and
    only codebooks (parts x entries x size numbers) pass through the driver.

    Defined cases: null vectors and vectors with null, NaN or infinite components are dropped, as are all other columns.
    Rows with a null id are coded but start no codebook; repeated rows each count, and rows of equal id start it in the
    order of their components. The length is that of the smallest id whose length is a multiple of ``parts``; rows of
    other lengths stay, with null code and error. Fewer usable rows than ``entries`` give so many entries. Components
    beyond ``most(length)`` (2**27 for 64 dimensions, x of 524,288) are set to it, so that sums fit 63 bits. A table
    without usable vectors gives an empty table.
    """
    usual = df.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("raw"))
    startable = usual.filter((F.size("raw") > 0) & (F.size("raw") % parts == 0) & F.col("id").isNotNull())
    head = startable.orderBy("id", "raw").select(F.size("raw")).first()
    if head is None:
        lonely = usual.filter((F.size("raw") > 0) & (F.size("raw") % parts == 0)).select(F.size("raw")).agg(F.min("size(raw)")).first()
        head = lonely if lonely[0] is not None else (parts,)
    dims = head[0]
    bound = most(dims)
    ints = F.transform("raw", lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), F.floor(F.lit(float(scale)) * x.cast("double")))).cast("int"))
    fits = F.size("raw") == dims
    rows = usual.filter(fits).select("id", "label", ints.alias("v"))
    start = rows.filter("id IS NOT NULL").orderBy("id", "v").select("v").limit(entries).collect()
    rest = usual.filter(~fits).select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    if not start:
        return rest.unionByName(rows.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))), np.zeros((parts, 0, dims // parts), np.int64)
    books = np.array([r[0] for r in start], np.int64).reshape(len(start), parts, dims // parts).transpose(1, 0, 2)
    groups = entry_groups(books)
    state = materialise(first_state(rows, books, groups), "codes")
    for step in range(rounds):
        new = moved_entries(state, books)
        drift = np.sqrt(((new - books) ** 2).sum(axis=2).astype(np.float64)) * (1 + 1e-12)
        books = new
        state = materialise(next_state(state, books, groups, drift), "codes")
    if not rounds:
        state = next_state(state, books, groups, np.zeros(books.shape[:2]))
    return state.select("id", "label", "code", "error").unionByName(rest), books


def with_label_sums(coded: DataFrame) -> DataFrame:
    """``coded`` (label, error, ...) with ``label_error``, the sum of error over the rows of its label, nulls together.

    Sums combine before they move. A table of at most ``LABELS`` labels is broadcast; beyond, labels are salted, so
    that the rows of a hot one are dealt over tasks.
    """
    sums = materialise(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-sums").withColumnRenamed("label", "_tm_label")
    same = F.col("label").eqNullSafe(F.col("_tm_label"))
    if sums.count() <= LABELS:
        return coded.join(F.broadcast(sums), same, "left").drop("_tm_label")
    salted = sums.withColumn("_tm_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("_tm_at", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, same & (F.col("_tm_at") == F.col("_tm_salt")), "left").drop("_tm_label", "_tm_salt", "_tm_at")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes and errors of all usable rows of ``embeddings``; cases as in ``compress_vectors``."""
    coded, books = compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    out = with_label_sums(coded)
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignment k and the codebook that it gives."""
    return f"""
a{k} AS (SELECT vec_id, part, x, first(e ORDER BY d, e) AS e, min(d) AS d FROM
  (SELECT p.vec_id, p.part, p.x, c.e, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.y[i]) * (p.x[i] - c.y[i]))) AS d FROM p JOIN c{k} c ON p.part = c.part)
  GROUP BY vec_id, part, x),
m{k} AS (SELECT part, e, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT part, e, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL),
n{k} AS (SELECT part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS y FROM m{k} GROUP BY ALL),
c{k + 1} AS (SELECT c.part, c.e, coalesce(n.y, c.y) AS y FROM c{k} c LEFT JOIN n{k} n ON c.part = n.part AND c.e = n.e)"""


OP13_SQL = f"""
WITH q AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS x FROM (SELECT *, unnest(range(16)) AS part FROM q)),
c0 AS (SELECT part, e, x AS y FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM q ORDER BY vec_id LIMIT 64) USING (vec_id)),
{_round_sql(0)},{_round_sql(1)},{_round_sql(2)},
codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN q USING (vec_id), books"""
