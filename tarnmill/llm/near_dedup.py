"""MinHash near-dedup: an inverted join over signature coordinates, confirmed on full shingle sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnmill.llm import textbytes as tb
from tarnmill.llm.common import materialise
from tarnmill.llm.graph import connected_components

#: Coordinates of a signature, the least values under so many permutations that each holds, and the chance with which a
#: pair right at the threshold may be missed.
COORDINATES, VALUES, MISS = 32, 2, 1e-8
#: Most 64-bit words (8 MB) of the filter that keeps texts of no interest out of a shuffle, and of the table of counts.
FILTER_WORDS = 1 << 20
#: Elements of differences that are ordered at once.
ELEMENTS = 1 << 18
#: Bytes of the texts that are signed at once, and packed bytes of those that are compared.
SIGN_BYTES, PART_BYTES = 2 << 20, 1 << 19

_RANDOM = np.random.default_rng(20240607)
_TIMES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_XOR = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)


def match_threshold(threshold: int, coordinates: int = COORDINATES, values: int = VALUES, miss: float = MISS) -> int:
    """The largest number of equal coordinates that a pair of Jaccard similarity ``threshold`` percent reaches but
    with chance ``miss``: each of a coordinate's ``values`` agrees independently with that probability."""
    p, below = (threshold / 100) ** values, 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > miss:
            return max(1, k)
    return coordinates


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingles of text i are hashes[bounds[i]:bounds[i + 1]].

    Words are runs of other bytes than blanks, A-Z lower-cased. A text of fewer words than ``width``, but not none,
    has its whole sequence as one shingle.
    """
    data, offsets = tb.text_buffer(texts)
    data = tb.ASCII_LOWER[data]
    start, end, text = tb.words(data, offsets, tb.NOT_BLANK)
    n = len(offsets) - 1
    word = tb.run_hashes(data, start, end)
    count = np.bincount(text, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        size = max(0, len(word) - width + 1)
        value = np.full(size, np.uint64(width), np.uint64)
        for j in range(width):
            value = value * step + word[j : j + size]
        whole = (first[text[:size]] + count[text[:size]] - np.arange(size)) >= width  # the window ends in its text
        value, owner = tb.mix(value[whole]), text[:size][whole]
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            extra = np.array([_sequence(word[first[i] : first[i + 1]], step) for i in short], np.uint64)
            value, owner = np.concatenate([value, extra]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def _sequence(words: np.ndarray, step: np.uint64) -> np.uint64:
    value = np.uint64(len(words)) + np.uint64(1 << 40)
    for w in words:
        value = value * step + w
    return tb.mix(np.array([value], np.uint64))[0]


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES * VALUES) least values of the shingles under each permutation; for non-empty sets."""
    filled = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, COORDINATES * VALUES), np.uint64)
    if len(filled):
        for j in range(COORDINATES * VALUES):
            out[filled, j] = np.minimum.reduceat((values ^ _XOR[j]) * _TIMES[j], bounds[filled])
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def text_signatures(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, k1, k2, sig, mini) of each row: set size, a 128-bit key of the set, the signature (empty without
    shingles) as one number for each coordinate, and as bytes 16 bits of each of its values, in which collisions of a
    pair are counted."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    long = T.LongType()
    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), *(T.StructField(c, long) for c in ("n", "k1", "k2")), T.StructField("sig", T.ArrayType(long)), T.StructField("mini", T.BinaryType())]
    )
    arrow = to_arrow_schema(schema)

    def sign(batches):
        for batch in batches:
            for piece in tb.slices(batch, "text", SIGN_BYTES):
                values, bounds = shingle_sets(piece.column(1), width)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)]) for v in (values, tb.mix(values ^ np.uint64(0x5851F42D4C957F2D)))]
                    k1, k2 = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
                size = np.diff(bounds)
                least = signatures(values, bounds)[size > 0]
                with np.errstate(over="ignore"):
                    sig = least[:, ::VALUES]
                    for j in range(1, VALUES):
                        sig = tb.mix(sig) + least[:, j::VALUES]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((size > 0) * COORDINATES)]).astype(np.int32)), _signed(sig.reshape(-1)))
                mini = np.zeros((len(size), COORDINATES * VALUES), np.uint16)
                mini[size > 0] = (tb.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0).cast(arrow.field(0).type), pa.array(size.astype(np.int64)), _signed(k1), _signed(k2), lists.cast(arrow.field(4).type),
                        pa.array([r.tobytes() for r in mini], pa.binary()),
                    ],
                    schema=arrow,
                )

    return rows.mapInArrow(sign, schema)


def maybe_among(rows: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """(node, packed) of the rows (node, text) whose node may be in ``ids`` (node): all that are, and few others.

    Texts travel compressed from here on (``packed``).

    A Bloom filter of 16 bits for each of the ``count`` ids, but at most ``FILTER_WORDS`` words, is built by a combined
    bitwise OR and broadcast, so that texts of no interest stay out of the join that follows. Beyond that size it
    lets more through, which costs time and no row.
    """
    size = min(FILTER_WORDS, max(1 << 10, 1 << max(0, count // 4).bit_length()))
    spots = lambda c: F.array(*[F.pmod(F.xxhash64(F.lit(k), F.col(c)), F.lit(size * 64)) for k in range(2)])
    words = (
        ids.select(F.explode(spots("node")).alias("s"))
        .groupBy((F.col("s") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("s") % 64).cast("int"))).alias("bits")).toArrow()
    )
    table = np.zeros(size, np.int64)
    table[words["w"].to_numpy()] = words["bits"].to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(table.view(np.uint64))
    schema = T.StructType([T.StructField("node", rows.schema["node"].dataType), T.StructField("packed", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def keep(batches):
        bits, pack = sent.value, zstandard.ZstdCompressor(level=6)
        for batch in batches:
            mask = np.ones(batch.num_rows, bool)
            spot = batch.column(2).flatten().to_numpy().reshape(-1, 2)
            for k in range(2):
                mask &= ((bits[spot[:, k] // 64] >> (spot[:, k] % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)
            kept = batch.filter(pa.array(mask))
            packed = pa.array([pack.compress((t or "").encode()) for t in kept.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([kept.column(0).cast(arrow.field(0).type), packed], schema=arrow)

    source = rows.select("node", "text", spots("node").alias("s"))
    return source.mapInArrow(keep, schema)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, packed) of the documents with ``ids`` (node, distinct and materialised)."""
    return maybe_among(docs, ids, ids.count()).join(ids, "node", "left_semi")


def unpacked(col: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(x).decode() for x in col.to_pylist()], pa.large_string())


def _steps(batch: pa.RecordBatch, columns: tuple[str, ...], limit: int):
    """Parts of ``batch`` with at most ``limit`` bytes in its binary ``columns``, or one row."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        size += pc.binary_length(batch.column(batch.schema.get_field_index(c))).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.concatenate([[0], np.cumsum(size + 64)]), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + limit, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def _pair_filter(pairs: DataFrame, columns: tuple[str, ...], kept) -> DataFrame:
    """(a, b) of the rows for which ``kept`` (a part's columns by name -> booleans) holds; parts are bounded by the
    bytes of ``columns``."""
    kind = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for piece in _steps(batch, columns, PART_BYTES):
                cols = {c: piece.column(i) for i, c in enumerate(piece.schema.names)}
                mask = pa.array(kept(cols))
                yield pa.RecordBatch.from_arrays([cols["a"].filter(mask).cast(arrow.field(0).type), cols["b"].filter(mask).cast(arrow.field(1).type)], schema=arrow)

    return pairs.mapInArrow(run, schema)


def _minis(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, COORDINATES * VALUES)


def count_collisions(pairs: DataFrame, facts: DataFrame, matches: int, threshold: int) -> DataFrame:
    """(a, b) of the distinct pairs (a, b) of fitting sizes with at least ``matches`` equal values.

    The merged lists were the short ones; the long ones that merging skipped are probed here, value by value, for each
    pair that a short list names. ``facts``: (node, n, mini).
    """
    side = lambda c: facts.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("mini").alias(f"mini_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    return _pair_filter(both.select("a", "b", "mini_a", "mini_b"), ("mini_a", "mini_b"), lambda c: (_minis(c["mini_a"]) == _minis(c["mini_b"])).sum(axis=1) >= matches)


def _pairs_of_sets(c: dict, width: int):
    """The two full sets of each pair of texts."""
    (va, ba), (vb, bb) = (shingle_sets(unpacked(c[x]), width) for x in ("text_a", "text_b"))
    for k in range(len(ba) - 1):
        yield va[ba[k] : ba[k + 1]], vb[bb[k] : bb[k + 1]]


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= threshold * (len(a) + len(b) - common)


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = lambda c: texts.select(F.col("node").alias(c), F.col("packed").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def confirm_pairs(pairs: DataFrame, texts: DataFrame, threshold: int, width: int) -> DataFrame:
    """(a, b) of the pairs (a, b) whose full sets are similar enough."""
    return _pair_filter(with_texts(pairs, texts), ("text_a", "text_b"), lambda c: np.array([similar(x, y, threshold) for x, y in _pairs_of_sets(c, width)], bool))


def differences(pairs: DataFrame, texts: DataFrame, width: int, centred: bool) -> DataFrame:
    """(a, b, centre, own, n, ds) of the pairs (a, b): the shingles in which the set of a differs from its centre.

    ``centred``: the centre is the set of b, and ``centre`` a key of it; else it is the empty set, so that ``ds`` is all
    of the set of a. ``own`` is a key of the set of a, and ``n`` its size.
    """
    kind, long = pairs.schema["a"].dataType, T.LongType()
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), *(T.StructField(c, long) for c in ("centre", "own", "n")), T.StructField("ds", T.ArrayType(long))])
    arrow = to_arrow_schema(schema)
    columns = ("text_a", "text_b") if centred else ("text_a",)
    rows = with_texts(pairs, texts) if centred else pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("text_a")), "a").select("a", "b", "text_a")
    key = lambda x: int(np.bitwise_xor.reduce(tb.mix(x), initial=np.uint64(0)).astype(np.int64))

    def run(batches):
        for batch in batches:
            for piece in _steps(batch, columns, PART_BYTES):
                c = {x: piece.column(i) for i, x in enumerate(piece.schema.names)}
                if centred:
                    sets = list(_pairs_of_sets(c, width))
                else:
                    v, e = shingle_sets(unpacked(c["text_a"]), width)
                    sets = [(v[e[k] : e[k + 1]], v[:0]) for k in range(len(e) - 1)]
                found = [np.setxor1d(x, y, assume_unique=True) for x, y in sets]
                bounds = np.concatenate([[0], np.cumsum([len(d) for d in found])]).astype(np.int32)
                values = np.concatenate(found) if found else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        c["a"].cast(arrow.field(0).type), c["b"].cast(arrow.field(1).type), pa.array([key(y) for _, y in sets], pa.int64()), pa.array([key(x) for x, _ in sets], pa.int64()),
                        pa.array([len(x) for x, _ in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), _signed(values)).cast(arrow.field(5).type),
                    ],
                    schema=arrow,
                )

    return rows.mapInArrow(run, schema)


def labelled(rows: DataFrame, components: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """``rows`` with the component of ``node`` as ``label``; a node without links is its own."""
    found = components.select(F.col("node").alias(node), F.col("component").alias("_tm_component"))
    return rows.join(found, node, "left").withColumn(label, F.coalesce("_tm_component", node)).drop("_tm_component")


def still_open(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (keys, node, label, ...) of the keys that hold several labels."""
    mixed = rows.groupBy(*keys).agg(F.min("label").alias("_tm_low"), F.max("label").alias("_tm_high")).filter("_tm_low <> _tm_high")
    return rows.join(mixed.select(*keys), keys, "left_semi")


def with_unlike(rows: DataFrame) -> DataFrame:
    """The rows (hub, node, label, related) of the families that hold several labels and a member unlike their hub."""
    mixed = rows.groupBy("hub").agg(F.min("label").alias("_tm_low"), F.max("label").alias("_tm_high"), F.min("related").alias("_tm_all")).filter("_tm_low <> _tm_high AND NOT _tm_all")
    return rows.join(mixed.select("hub"), "hub", "left_semi")


def sharing(asked: DataFrame) -> DataFrame:
    """The rows (key, node, own, o, ds, ...) with at least ``o`` elements that another row of their key has too.

    An element that one row alone has is told by its count, and its row by the least one of its group, so elements are
    counted with a combined aggregate and are not joined back; only one count a row is.
    """
    asked = asked.filter(F.size("ds") >= F.col("o"))
    groups = asked.select("key", "node", "own", F.explode("ds").alias("d")).groupBy("key", "d").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("node"), F.min("own").alias("own"))
    alone = groups.filter("df = 1").groupBy("key", "node", "own").agg(F.count(F.lit(1)).alias("alone"))
    return asked.join(alone, ["key", "node", "own"], "left").filter(F.size("ds") - F.coalesce("alone", F.lit(0)) >= F.col("o")).drop("alone")


def rare_first(rows: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    """``rows`` (key, ds, ...) with the elements of ``ds`` that are in ``groups`` (key, d, df), and few others, rare ones first.

    The counts ``df`` are summed into a table of one to two numbers for each of the ``count`` elements, but at most
    ``FILTER_WORDS``, which is broadcast. An element has two places in it, and the smaller number there is its rank: at
    least its count, and zero only if it is in no group. Equal elements of a key get equal ranks, so all members have
    one order, and what the prefix principle asks for holds with any: a table that is too full lets more
    elements through and orders them less well, which costs time and no pair.
    """
    size = min(FILTER_WORDS, max(1 << 10, 1 << count.bit_length()))
    mixed = F.col("key").bitwiseXOR(F.col("d"))
    spots = F.explode(F.array(*[F.shiftrightunsigned(mixed, 24 * k).bitwiseAND(F.lit(size - 1)) for k in range(2)]))
    sums = groups.select("df", spots.alias("spot")).groupBy("spot").agg(F.sum("df").alias("n")).toArrow()
    table = np.zeros(size, np.int64)
    table[sums["spot"].to_numpy()] = sums["n"].to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(table)
    arrow = to_arrow_schema(rows.schema)
    at_key, at_ds = rows.columns.index("key"), rows.columns.index("ds")

    def run(batches):
        numbers = sent.value
        for batch in batches:
            upto, at = np.concatenate([[0], np.cumsum(batch.column(at_ds).value_lengths().to_numpy())]), 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(upto, upto[at] + ELEMENTS, "right")) - 1)
                piece = batch.slice(at, stop - at)
                value, owner = piece.column(at_ds).flatten().to_numpy(), np.repeat(np.arange(stop - at), np.diff(upto[at : stop + 1]))
                spot = (piece.column(at_key).to_numpy()[owner] ^ value).view(np.uint64)
                rank = np.minimum(*(numbers[(spot >> np.uint64(24 * k)) & np.uint64(size - 1)] for k in range(2)))
                value, owner, rank = (x[rank > 0] for x in (value, owner, rank))
                value = value[np.lexsort((value, rank, owner))]
                bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=stop - at))]).astype(np.int32)
                columns = [c.cast(f.type) for c, f in zip(piece.columns, arrow, strict=True)]
                columns[at_ds] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(value)).cast(arrow.field(at_ds).type)
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                at = stop

    return rows.mapInArrow(run, rows.schema)


def difference_postings(members: DataFrame, hub_labels: DataFrame, threshold: int, whole: DataFrame | None = None, apart: DataFrame | None = None) -> DataFrame:
    """(key, d, node, label, s, left, related) from members (hub, centre, node, own, n, related, label, ds), and from the
    whole sets (node, own, n, related, label, ds) of the families ``apart`` (hub, node, label, related).

    Let D be the difference of a set from its centre. Two sets x, y of one centre are similar exactly if
    2 (100 + t) |D_x & D_y| >= s_x + s_y with s = (100 + t) |D| - (100 - t) n. So a pair needs common elements of D, and
    by the prefix principle one among each member's rarest ``c - o + 1``, with c the elements that it has in common with
    any member of another label (and few others, ``rare_first``) and o the least overlap that any such member asks for.
    ``left`` counts the elements of a member from a posting on, which bounds the overlap of two members that meet first
    there. Members that have fewer than o elements in common with all others (``sharing``) drop out before. Elements are
    counted with combined aggregates and never joined to their counts.

    The centre of whole sets is empty, so one for all families: a set's elements are counted and ordered once, in however
    many families it is, and only the postings are made by family.
    """
    t, columns = threshold, ["key", "centred", "node", "own", "s", "related", "label", "ds", "o"]
    weighed = lambda rows: rows.withColumn("s", (100 + t) * F.size("ds").cast("long") - (100 - t) * F.col("n"))
    overlap = F.greatest(F.lit(1), F.ceil((F.col("s") + F.col("least")) / (2 * (100 + t)))).cast("int")
    keyed = labelled(weighed(members).withColumns({"key": F.xxhash64("hub", F.lit(True), "centre"), "centred": F.lit(True)}), hub_labels, "hub", "hub_label")
    keyed = keyed.withColumn("inside", F.col("label") == F.col("hub_label"))
    low = keyed.groupBy("key").agg(F.min("s").alias("low"), F.min(F.when(~F.col("inside"), F.col("s"))).alias("low_out"))
    # a member of the hub's component looks for members outside it; without a centre sizes give the bound
    asked = keyed.join(low, "key").withColumn("least", F.when(F.col("inside"), F.col("low_out")).otherwise(F.col("low"))).filter("least IS NOT NULL").withColumn("o", overlap).select(columns)
    if whole is not None:
        sets = weighed(whole).withColumns({"key": F.lit(0).cast("bigint"), "centred": F.lit(False), "least": F.ceil(2 * t * t * F.col("n") / 100)})
        asked = asked.unionByName(sets.withColumn("o", overlap).select(columns))
    facts = materialise(sharing(asked), "sharing")
    elements = facts.select("key", "centred", "related", "label", F.explode("ds").alias("d"))
    groups = (
        elements.groupBy("key", "d").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("_a"), F.max("label").alias("_b"), F.min("related").alias("_r"), F.max("centred").alias("_c"))
        .filter("df > 1 AND _a <> _b AND (_c OR NOT _r)").select("key", "d", "df")
    )
    count = facts.agg(F.sum(F.size("ds"))).first()[0] or 0
    ready = rare_first(facts, groups, count).withColumn("c", F.size("ds")).filter("c >= o").withColumn("ds", F.slice("ds", 1, F.col("c") - F.col("o") + 1))
    ready = ready if whole is None else materialise(ready, "prefixes")
    prefix = ["key", "node", "label", "s", "related", "c", "ds"]
    posted = ready.filter("centred").withColumn("related", F.lit(False)).select(prefix)
    if whole is not None:
        sets = ready.filter("NOT centred").drop("key", "related")
        there = with_unlike(apart.join(sets.select("node").distinct(), "node", "left_semi")).select("node", "related", F.xxhash64("hub", F.lit(False)).alias("key"))
        posted = posted.unionByName(sets.join(there, "node").select(prefix))
    return posted.select("key", "node", "label", "s", "related", "c", F.posexplode("ds").alias("pos", "d")).select("key", "d", "node", "label", "s", (F.col("c") - F.col("pos")).alias("left"), "related")


def family_postings(family: DataFrame, apart: DataFrame, texts: DataFrame, hub_labels: DataFrame, threshold: int, width: int) -> DataFrame:
    """``difference_postings`` of the families (hub, node, label, related), of which those in ``apart`` have members unlike
    their hub and so are posted under their whole sets too; each text of these is read once."""
    related = still_open(family.filter("related"), ["hub"])
    centred = differences(related.select(F.col("node").alias("a"), F.col("hub").alias("b")), texts, width, True).withColumnsRenamed({"a": "node", "b": "hub"}).join(family, ["hub", "node"])
    sets = apart.groupBy("node").agg(F.min("label").alias("label"), F.min("related").alias("related"))
    whole = differences(sets.select(F.col("node").alias("a"), F.col("node").alias("b")), texts, width, False).select(F.col("a").alias("node"), "own", "n", "ds").join(sets, "node")
    return materialise(difference_postings(materialise(centred, "differences"), hub_labels, threshold, materialise(whole, "differences"), apart), "differences")


def meeting(rows: DataFrame, others: DataFrame, threshold: int) -> DataFrame:
    """The pairs of a posting in ``rows`` and one in ``others`` (columns with ``_2``) of the same key and element that may
    be similar and have different labels."""
    enough = 2 * (100 + threshold) * F.least("left", "left_2") >= F.col("s") + F.col("s_2")
    return rows.join(others, ["key", "d"]).filter((F.col("label") != F.col("label_2")) & enough & ~(F.col("related") & F.col("related_2")))


def contracted(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more ``links`` (materialised), of which only those between components count."""
    between = labelled(labelled(links, found, "a", "la"), found, "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a <> b")
    between = materialise(between.distinct(), "links")
    if between.isEmpty():
        return found
    joined = materialise(connected_components(between), "components")
    fresh = joined.join(found.select("node"), "node", "left_anti")
    moved = found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_tm_to")), "component", "left")
    return materialise(moved.select("node", F.coalesce("_tm_to", "component").alias("component")).unionByName(fresh), "components")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) per row: connected components of Jaccard similarity over word shingles.

    1. Each text's shingle set gives a key and a MinHash signature; equal sets become one class, named by its least
       id, with a combined minimum.
    2. Classes are posted under each (coordinate, value), where the value of a coordinate is a pair of least values:
       unlike sets that share a frequent shingle then rarely meet, however large the corpus. Two sets at the threshold
       agree in ``match_threshold`` of
       the coordinates but for one case in 10**8, so by the prefix principle they share a posting among the
       coordinates - matches + 1 rarest of both. Only these lists are merged; the long ones are skipped, and probed
       through the signature for the pairs that the short ones name. Values that only one class has are dropped, and
       so are classes with fewer shared values than matches.
    3. A posting list is never paired with itself. Its hub, the member with most shared values, meets each member:
       pairs are distinct, their collisions are counted, and those over the match threshold are confirmed on the
       full sets. Components of these links contract the lists.
    4. The lists that then hold several components are taken together by hub. Each member related to the hub is
       written as its difference from it (``difference_postings``): what all have in common drops out, and
       members are posted again under the rarest elements of their differences, for which an exact overlap bound
       holds. These lists have a hub each too, contract, and only pairs of different components that the
       bound admits are left to be confirmed. Where a family has members unlike the hub, its members are posted under
       their whole sets too, for the pairs with one of these; a whole set is read, counted and ordered once, in however
       many families it is.

    So each pair that shares a posting and is not joined already is met or excluded by an exact bound, whatever its
    list's size; no list or candidate is capped. Values and postings are counted and joined on hashed keys, without
    windows over hot keys. Texts of candidates alone move, and are read in parts of bounded bytes. What a step needs
    twice is written to the shared folder.

    Defined cases: null text and text without words have no shingles, n_shingles 0, and are linked with nothing;
    shorter texts than ``width`` words have one shingle; repeated rows are equal sets and so one component; rows that
    share an id count as one document, whose rows are in one component; rows with a null id are linked with nothing
    and have a null component; other columns are dropped; an empty table gives an empty table.
    """
    matches, equal_values = match_threshold(threshold), match_threshold(threshold, COORDINATES * VALUES, 1)
    least = max(1, math.ceil(100 / (100 - threshold)) - 1) if threshold < 100 else 1 << 62  # smaller sets link only with their equals
    base = materialise(text_signatures(df, id_col, text_col, width), "signatures")
    named = base.filter("n > 0 AND id IS NOT NULL")
    classes = materialise(named.groupBy("k1", "k2", "n").agg(F.min("id").alias("node")), "classes")

    large = named.filter(F.col("n") >= least).join(classes.filter(F.col("n") >= least).select("k1", "k2", "n", F.col("node").alias("id")), ["k1", "k2", "n", "id"], "left_semi")
    tokens = large.select(F.col("id").alias("node"), F.posexplode("sig").alias("pos", "value")).select("node", F.xxhash64("pos", "value").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # rare values first: the count above 48 bits of the value's hash, one number to move and to sort by
    ranked = F.shiftleft(F.least(F.col("df"), F.lit(32767)).cast("bigint"), 48).bitwiseOR(F.col("token").bitwiseAND(F.lit((1 << 48) - 1)))
    shared = tokens.join(often, "token").select("node", ranked.alias("token")).groupBy("node").agg(F.array_sort(F.collect_set("token")).alias("ts"))
    posted = shared.withColumn("c", F.size("ts")).filter(F.col("c") >= matches)
    postings = materialise(posted.select("node", "c", F.explode(F.slice("ts", 1, F.col("c") - matches + 1)).alias("token")).select("token", "node", "c"), "postings")

    hubs = postings.groupBy("token").agg(F.max(F.struct("c", "node")).alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    lists = materialise(postings.join(hubs, "token").select("token", "node", F.col("hub.node").alias("hub")).filter("node <> hub"), "lists")
    met = lists.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    facts = named.select(F.col("id").alias("node"), "n", "k1", "mini").join(postings.select("node").distinct(), "node", "left_semi").dropDuplicates(["node", "k1"])
    facts = materialise(facts.select("node", "n", "mini"), "facts")
    docs = df.select(F.col(id_col).alias("node"), F.col(text_col).cast("string").alias("text"))
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node"))

    hits = materialise(count_collisions(met, facts, equal_values, threshold).distinct(), "collisions")
    wanted = materialise(ends(hits).distinct(), "wanted")
    texts = materialise(texts_of(docs, wanted), "texts")
    found = materialise(connected_components(materialise(confirm_pairs(hits, texts, threshold, width), "links")), "components")

    open_lists = still_open(labelled(lists, found), ["token"])
    related = hits.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.lit(True).alias("related"))
    family = materialise(open_lists.select("hub", "node", "label").distinct().join(related, ["hub", "node"], "left").withColumn("related", F.coalesce("related", F.lit(False))), "families")
    apart = materialise(with_unlike(family), "apart")
    more = materialise(apart.select("node").distinct().join(wanted, "node", "left_anti"), "wanted")
    texts = texts.unionByName(materialise(texts_of(docs, more), "texts"))
    fine = family_postings(family, apart, texts, found, threshold, width)

    hubs = fine.groupBy("key", "d").agg(F.min(F.struct("s", "node", "label", "left", "related")).alias("h")).select("key", "d", *(F.col(f"h.{c}").alias(f"{c}_2") for c in ("s", "node", "label", "left", "related")))
    pairs = lambda rows: rows.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct()
    found = contracted(found, materialise(confirm_pairs(pairs(meeting(fine, hubs, threshold)), texts, threshold, width), "links"))

    left = materialise(still_open(labelled(fine.drop("label"), found), ["key", "d"]), "differences")
    centre = labelled(hubs.select("key", "d", F.col("node_2").alias("node")), found, label="main").select("key", "d", "main")
    outside = left.join(centre, ["key", "d"]).filter("label <> main")
    others = left.select("key", "d", *(F.col(c).alias(f"{c}_2") for c in ("s", "node", "label", "left", "related")))
    last = pairs(meeting(outside, others, threshold).filter("label_2 = main OR node < node_2"))
    final = contracted(found, materialise(confirm_pairs(last, texts, threshold, width), "links"))

    placed = classes.join(final, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("component"))
    out = base.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("k1")).alias("k1"), "k2").join(placed, ["k1", "k2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(docs, width=2, threshold=80)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS sh FROM w),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM inter JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * c >= 80 * (len(p.sh) + len(q.sh) - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, t.b FROM reach r JOIN both_ways t ON r.seen = t.a),
c AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM s LEFT JOIN c ON s.doc_id = c.node"""
