"""Principal components of vectors, and character-gram fingerprints of texts by TF-IDF and a truncated SVD."""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.sources.files import written

#: Fixed values of the fingerprint: lengths of grams, least documents of a term, most terms, dimensions.
GRAMS, MIN_DF, MAX_TERMS, DIMS = (3, 5), 3, 60_000, 64
#: What a task holds at once: terms that are counted before their counts are sent, characters of texts, weights that are
#: multiplied, numbers of the dense block that these make, bytes of packed rows that are put in order.
MET_TERMS, PART_CHARS, PART_CELLS, BLOCK_CELLS, ORDER_BYTES = 1 << 19, 1 << 17, 1 << 19, 1 << 23, 1 << 25
#: Terms whose sums are made at once, so that they stay in a core's cache, and are sent in one row. Bytes of packed rows
#: that are read by one task or another: rounds last as long as the task that has most.
BLOCK_TERMS, GROUP_BYTES = 1 << 11, 1 << 22


def _matrix(df: DataFrame, rows: int, cols: int) -> np.ndarray:
    """(i, j, s) as a dense matrix on the driver; its size is that of the two arguments."""
    out = np.zeros((rows, cols))
    got = df.toArrow()
    out[got["i"].to_numpy(), got["j"].to_numpy()] = got["s"].to_numpy()
    return out


def moments(df: DataFrame, vector: str, shift: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance) of the arrays ``vector`` of equal length.

    Each task adds up its outer products and sends one number for each cell; rows never move, and only
    dims x (dims + 1) numbers reach the driver. ``shift`` is any vector near the mean: sums of squares around it do not
    cancel.
    """
    d = len(shift)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())])

    def add_up(batches):
        gram, n = np.zeros((d + 1, d)), 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d) - shift
            gram[:d] += x.T @ x
            gram[d] += x.sum(axis=0)
            n += len(x)
        i, j = np.indices(gram.shape)
        cells = [np.append(a.ravel(), b) for a, b in ((i, d), (j, d), (gram, n))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((cells[0].astype(np.int32), cells[1].astype(np.int32), cells[2]), schema)], schema=schema)

    usable = df.filter(F.col(vector).isNotNull() & (F.size(vector) == d) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)))
    sums = _matrix(usable.select(vector).mapInArrow(add_up, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")), d + 1, d + 1)
    n = int(sums[d, d])
    if n < 2:
        return n, shift.copy(), np.zeros((d, d))
    off = sums[d, :d] / n
    return n, shift + off, (sums[:d, :d] - n * np.outer(off, off)) / (n - 1)


def with_fixed_sign(components: np.ndarray) -> np.ndarray:
    """Rows turned so that the entry of largest size, the first of equals, is positive."""
    top = np.abs(components).argmax(axis=1)
    sign = np.sign(components[np.arange(len(components)), top])
    return components * np.where(sign == 0, 1.0, sign)[:, None]


def fit_pca(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components (k, dims), explained variances) by falling variance. Vectors that are null, of another length
    than the first one or with null or NaN components are left out; without vectors the arrays are empty."""
    head = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))).select(vector).first()
    if head is None:
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    _, mean, cov = moments(df, vector, np.array(head[0], np.float64))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    return mean, with_fixed_sign(vectors[:, order].T), values[order]


def _lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _numbers(x: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


def apply_pca(df: DataFrame, vector: str, mean: np.ndarray, components: np.ndarray, out: str, eps: float = 1e-8) -> DataFrame:
    """``df`` with the projection of ``vector`` at unit length as ``out``; null for vectors of another length. Array
    expressions in the JVM; mean and components are one row of bounded size, broadcast."""
    if not len(components):
        return df.withColumn(out, F.lit(None).cast("array<double>"))
    table = df.sparkSession.range(1).select(_numbers(mean).alias("_tm_mean"), F.array(*[_numbers(c) for c in components]).alias("_tm_axes"))
    centred = F.zip_with(vector, "_tm_mean", lambda x, m: x.cast("double") - m)
    along = lambda c: F.transform("_tm_axes", lambda a: F.aggregate(F.zip_with(c, a, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    raw = F.transform(F.array(centred), along)[0]
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + eps
    unit = F.transform(F.array(raw), lambda v: F.transform(F.array(length(v)), lambda n: F.transform(v, lambda x: x / n))[0])[0]
    return df.crossJoin(F.broadcast(table)).withColumn(out, F.when(F.size(vector) == len(mean), unit)).drop("_tm_mean", "_tm_axes")


def word_grams(text: Column, shortest: int = GRAMS[0], longest: int = GRAMS[1]) -> Column:
    """The character grams within words: each word stands between two blanks, grams do not pass its ends, and a word of
    fewer characters than a length gives one gram, the whole, for the first such length alone."""

    def of_word(word):
        chars = F.array_remove(F.split(F.concat(F.lit(" "), word, F.lit(" ")), "", -1), "")

        def of_length(c, n):
            whole = F.array(F.array_join(c, "")) if n == shortest else F.array().cast("array<string>")
            runs = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[c[i + k] for k in range(n)]))
            return F.when(F.size(c) >= n, runs).otherwise(whole)

        def grams(c):
            return F.concat(*[of_length(c, n) for n in range(shortest, longest + 1)])

        return F.transform(F.array(chars), grams)[0]

    return F.flatten(F.transform(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), ""), of_word))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(chars: np.ndarray):
    """(n, hashes) for each length of grams: of the runs of n characters from every position on."""
    c, x = chars.astype(np.uint64), np.zeros(len(chars), np.uint64)
    for n in range(1, GRAMS[1] + 1):
        if len(c) < n:
            return
        x = x[: len(c) - n + 1]
        last = c[n - 1 :]
        x = (x << np.uint64(21)) | last if n <= 3 else _mix(x * np.uint64(0x9E3779B97F4A7C15) + last)
        if n == 3:
            x = _mix(x)
        if n >= GRAMS[0]:
            yield n, x


def _gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times, chars, length) of the grams of each text, once each; chars: five of each, as many count as its
    length says. Words stand between single blanks, and only ends of grams may be blank."""
    chars = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    owner = np.append(np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t) + 1 for t in texts]), np.uint64(len(texts)))
    blank = (chars == 32) | ((chars >= 9) & (chars <= 13))
    kept = np.append(True, ~(blank[1:] & blank[:-1]))
    chars, owner, blank = np.where(blank, np.uint32(32), chars)[kept], owner[kept], blank[kept]
    upto = np.append(0, np.cumsum(blank))
    starts, hashes, sizes = [], [], []
    for n, x in _gram_hashes(chars):
        at = np.flatnonzero(upto[n - 1 : len(chars)] == upto[1 : len(chars) - n + 2])  # no blank but at the ends
        starts.append(at)
        hashes.append(x[at])
        sizes.append(np.full(len(at), n))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, GRAMS[1]), np.uint32), np.zeros(0, np.int64)
    start, x, size = map(np.concatenate, (starts, hashes, sizes))
    text = owner[start + 1]  # a blank may stand between two texts, the next character not
    key = x ^ _mix(text + np.uint64(1))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    one = order[first]
    chars = np.append(chars, np.zeros(GRAMS[1], np.uint32))
    return text[one].astype(np.int64), x[one], np.diff(np.append(first, len(key))), chars[start[one][:, None] + np.arange(GRAMS[1])], size[one]


def _parts(batch: pa.RecordBatch):
    """(first row, texts) of parts of a batch (id, text) of about ``PART_CHARS`` characters."""
    first, texts, size = 0, [], 0
    for k, text in enumerate(batch.column(1)):
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= PART_CHARS:
            yield first, texts
            first, texts, size = k + 1, [], 0
    if texts:
        yield first, texts


def _merged(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(hash, df, total, chars, length) once each."""
    x, df, total, chars, size = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(x)
    x = x[order]
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    add = lambda c: np.add.reduceat(c[order], first) if len(x) else c
    return x[first], add(df), add(total), chars[order[first]], size[order[first]]


def _vocabulary(df: DataFrame, id_col: str, text: Column, min_df: int, max_terms: int) -> tuple[DataFrame, list[str], np.ndarray]:
    """((id, text), terms, idf): one row for each id, and the terms in their order.

    A task counts the grams of its texts in arrays, by 64-bit hashes, and sends one count for each term, of which the
    vocabulary is the distributed top-k. Texts do not move, unless ids repeat: then those of each id are joined.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    n, most = rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).agg(F.count(F.lit(1)), F.coalesce(F.max("rows"), F.lit(0))).first()
    if most > 1:
        rows = rows.groupBy("id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    schema = pa.schema([("term", pa.string()), ("df", pa.int64()), ("total", pa.int64())])

    def count(batches):
        def sent(found):
            _, df, total, chars, size = found
            for k in range(GRAMS[0], GRAMS[1] + 1):
                mine = size == k
                joined = np.ascontiguousarray(chars[mine][:, :k]).tobytes().decode("utf-32-le")
                terms = pa.array([joined[i : i + k] for i in range(0, len(joined), k)], pa.string())
                yield pa.RecordBatch.from_arrays([terms, pa.array(df[mine]), pa.array(total[mine])], schema=schema)

        found, fresh = [], 0
        for batch in batches:
            for _, texts in _parts(batch):
                _, x, times, chars, size = _gram_counts(texts)
                found.append(_merged([(x, np.ones(len(x), np.int64), times, chars, size)]))
                fresh += len(found[-1][0])
                if fresh >= MET_TERMS:
                    found, fresh = [_merged(found)], 0
                    if len(found[0][0]) >= MET_TERMS:
                        yield from sent(found[0])
                        found = []
        if found:
            yield from sent(_merged(found))

    known = rows.mapInArrow(count, "term string, df bigint, total bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).filter(F.col("df") >= min_df)
    vocabulary = known.orderBy(F.desc("total"), "term").limit(max_terms).select("term", "df").toArrow().to_pydict()  # of bounded size
    order = sorted(range(len(vocabulary["term"])), key=vocabulary["term"].__getitem__)
    terms = [vocabulary["term"][k] for k in order]
    idf = np.log((1.0 + n) / (1 + np.array([vocabulary["df"][k] for k in order], float))) + 1
    return rows, terms, idf


def _by_hash(terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, numbers) of the terms, by rising hash."""
    hashes, size = np.zeros(len(terms), np.uint64), np.array([len(t) for t in terms], int)
    for n in set(size.tolist()):
        mine = np.flatnonzero(size == n)
        chars = np.frombuffer("".join(terms[k] for k in mine).encode("utf-32-le"), np.uint32)
        hashes[mine] = dict(_gram_hashes(chars))[n][::n]
    order = np.argsort(hashes)
    return hashes[order], order


def _known_counts(batches, hashes: np.ndarray, numbers: np.ndarray):
    """(ids, bounds, term, times) of parts of the batches (id, text): the documents that hold a term, and between the
    bounds of each its terms, rising, with their counts."""
    for batch in batches:
        for first, texts in _parts(batch):
            doc, x, times, *_ = _gram_counts(texts)
            spot = np.minimum(np.searchsorted(hashes, x), max(0, len(hashes) - 1))
            hit = np.flatnonzero(hashes[spot] == x) if len(hashes) else np.zeros(0, np.int64)
            if not len(hit):
                continue
            doc, term, times = doc[hit], numbers[spot[hit]], times[hit]
            order = np.argsort(doc * len(hashes) + term)
            kept, starts = np.unique(doc[order], return_index=True)
            yield batch.column(0).slice(first).take(pa.array(kept)), np.append(starts, len(doc)), term[order], times[order]


def term_rows(df: DataFrame, id_col: str, text: Column, min_df: int = MIN_DF, max_terms: int = MAX_TERMS) -> tuple[DataFrame, list[str]]:
    """((id, ks, ws), terms): the numbers of each document's terms, rising, and their weights, as ``term_weights`` has them.

    After the vocabulary a second pass weighs the terms of every document where it lies.
    """
    rows, terms, idf = _vocabulary(df, id_col, text, min_df, max_terms)
    shared = df.sparkSession.sparkContext.broadcast((*_by_hash(terms), idf))

    def weigh(batches):
        hashes, numbers, idf = shared.value
        for ids, bounds, term, times in _known_counts(batches, hashes, numbers):
            w = (1 + np.log(times)) * idf[term]
            w /= np.repeat(np.sqrt(np.add.reduceat(w * w, bounds[:-1])), np.diff(bounds))
            lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(c)) for c in (term.astype(np.int32), w)]
            yield pa.RecordBatch.from_arrays([ids, *lists], ["id", "ks", "ws"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(weigh, f"id {kind}, ks array<int>, ws array<double>"), terms


def term_weights(df: DataFrame, id_col: str, text: Column, min_df: int = MIN_DF, max_terms: int = MAX_TERMS) -> DataFrame:
    """(id, term, w): TF-IDF of the character grams, sublinear in counts, each document at unit length.

    w is (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) over the root of the document's sum of squares. Terms need ``min_df``
    documents; of more than ``max_terms`` those with the largest total counts stay, then the first by text. Documents
    without a term have no row.
    """
    rows, terms = term_rows(df, id_col, text, min_df, max_terms)
    numbered = df.sparkSession.createDataFrame([(t, k) for k, t in enumerate(terms)], "term string, k int")
    cells = rows.select("id", F.explode(F.arrays_zip("ks", "ws")).alias("c")).select("id", F.col("c.ks").alias("k"), F.col("c.ws").alias("w"))
    return cells.join(F.broadcast(numbered), "k").select("id", "term", "w")


def truncated_svd(weights: DataFrame, dims: int = DIMS, rounds: int = 4, extra: int = 8, seed: int = 42, eps: float = 1e-8) -> tuple[DataFrame, np.ndarray]:
    """((id, fingerprint), singular values) of the sparse matrix (id, term, w): the rows in the first ``dims`` right
    singular directions, at unit length. Directions have the sign that makes their largest entry positive."""
    spark = weights.sparkSession
    terms = sorted(r[0] for r in weights.select("term").distinct().toLocalIterator())  # the vocabulary, of bounded size
    numbered = spark.createDataFrame([(t, k) for k, t in enumerate(terms)], "term string, k int")
    packed = weights.join(F.broadcast(numbered), "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("ts"))
    return svd_of_rows(packed.select("id", F.transform("ts", lambda t: t["k"]).alias("ks"), F.transform("ts", lambda t: t["w"]).alias("ws")), len(terms), dims, rounds, extra, seed, eps)


def _term_kind(n_terms: int) -> np.dtype:
    return np.dtype(np.uint16 if n_terms <= 1 << 16 else np.uint32)


def _packed(rows: DataFrame, pack: Callable) -> DataFrame:
    """(id, cells) that ``pack`` makes of rows, written. One binary a row: readers hold thousands of rows at once, and lists of
    numbers several times over."""
    cells = rows.mapInArrow(pack, f"id {rows.schema['id'].dataType.simpleString()}, cells binary")
    return written(cells, "term-rows", **{"parquet.block.size": GROUP_BYTES})


def svd_of_rows(rows: DataFrame, n_terms: int, dims: int = DIMS, rounds: int = 4, extra: int = 8, seed: int = 42, eps: float = 1e-8) -> tuple[DataFrame, np.ndarray]:
    """``truncated_svd`` of the rows (id, ks, ws): numbers of terms below ``n_terms``, rising, and weights."""
    kind = _term_kind(n_terms)

    def pack(batches):
        for batch in batches:
            ks, ws = (batch.column(batch.schema.get_field_index(c)) for c in ("ks", "ws"))
            upto = np.append(0, np.cumsum(ks.value_lengths().to_numpy()))
            ks, ws = ks.flatten().to_numpy().astype(kind), ws.flatten().to_numpy()
            cells = [ws[i:j].tobytes() + ks[i:j].tobytes() for i, j in pairwise(upto)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), pa.array(cells, pa.binary())], ["id", "cells"])

    def unpack(cells):
        n = cells.size // (8 + kind.itemsize)
        return np.frombuffer(cells, kind, n, 8 * n), np.frombuffer(cells, np.float64, n)

    return _svd(_packed(rows.select("id", "ks", "ws"), pack), n_terms, unpack, dims, rounds, extra, seed, eps)


def svd_of_texts(
    df: DataFrame, id_col: str, text: Column, min_df: int = MIN_DF, max_terms: int = MAX_TERMS, dims: int = DIMS, rounds: int = 4, extra: int = 8, seed: int = 42, eps: float = 1e-8
) -> tuple[DataFrame, np.ndarray]:
    """``truncated_svd`` of the weights that ``term_rows`` gives the texts.

    Rows are written as numbers of terms and counts, 3 bytes a term where no count passes 255; a task that reads them weighs
    them again. Those with the same commonest term, mostly of one language, are written together.
    """
    rows, terms, idf = _vocabulary(df, id_col, text, min_df, max_terms)
    kind = _term_kind(len(terms))
    few = 1 + np.log(np.maximum(np.arange(256), 1))  # of counts of one byte
    known, weights = df.sparkSession.sparkContext.broadcast(_by_hash(terms)), df.sparkSession.sparkContext.broadcast(idf)

    def pack(batches):
        def ordered():
            order = np.argsort(commonest, kind="stable")
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids).take(pa.array(order)), pa.array([cells[k] for k in order], pa.binary())], ["id", "cells"])

        ids, commonest, cells, size = [], [], [], 0
        for some, bounds, term, times in _known_counts(batches, *known.value):
            ids.append(some)
            for i, j in pairwise(bounds):
                counts = times[i:j].astype(np.min_scalar_type(times[i:j].max()))
                cells.append(term[i:j].astype(kind).tobytes() + counts.tobytes() + bytes([counts.itemsize]))
                commonest.append(term[i + counts.argmax()])
                size += len(cells[-1])
            if size >= ORDER_BYTES:
                yield ordered()
                ids, commonest, cells, size = [], [], [], 0
        if cells:
            yield ordered()

    def unpack(cells):
        each = cells[cells.size - 1 :].to_pybytes()[0]
        n = (cells.size - 1) // (kind.itemsize + each)
        ks, times = np.frombuffer(cells, kind, n), np.frombuffer(cells, f"u{each}", n, n * kind.itemsize)
        ws = (few[times] if each == 1 else 1 + np.log(times.astype(np.float64))) * weights.value[ks]
        return ks, ws / np.sqrt(ws @ ws)

    return _svd(_packed(rows, pack), len(terms), unpack, dims, rounds, extra, seed, eps)


def _svd(rows: DataFrame, n_terms: int, unpack: Callable, dims: int, rounds: int, extra: int, seed: int, eps: float) -> tuple[DataFrame, np.ndarray]:
    """``truncated_svd`` of packed rows (id, cells), of which ``unpack`` makes numbers of terms and weights.

    Randomised subspace iteration. In a round each task takes its rows times the basis, and back, in dense blocks of
    ``PART_CELLS`` weights over the terms that these rows hold: a product of matrices costs a tenth of gathering a row of the
    basis for each weight. Its sums move in rows of ``BLOCK_TERMS`` terms. The basis (terms x (dims + extra) numbers, bounded by
    the vocabulary) is broadcast; documents are written once and never move again. A round has one task a core, as each
    sends as much as the basis holds.
    """
    spark, id_kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    width = min(dims + extra, n_terms)
    if not width:
        return rows.select("id", F.lit(None).cast("array<double>").alias("fingerprint")), np.zeros(0)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, width)))[0]

    def parts(batches):
        """(batch, terms, block) of slices of at most ``PART_CELLS`` weights and ``BLOCK_CELLS`` numbers, one row at least."""
        for batch in batches:
            at, size, found, met = 0, 0, [], np.zeros(n_terms, bool)
            for k, cells in enumerate(batch.column(batch.num_columns - 1)):
                ks, ws = unpack(cells.as_buffer())
                terms = np.count_nonzero(met) + np.count_nonzero(~met[ks])
                if found and (size + len(ks) > PART_CELLS or terms * (len(found) + 1) > BLOCK_CELLS):
                    yield batch.slice(at, len(found)), *block(found, met)
                    at, size, found, met = k, 0, [], np.zeros(n_terms, bool)
                found.append((ks, ws))
                met[ks] = True
                size += len(ks)
            if found:
                yield batch.slice(at, len(found)), *block(found, met)

    def block(found, met):
        """(terms, rows x terms): the weights of rows over the terms that they hold."""
        terms, number = np.flatnonzero(met), np.cumsum(met) - 1
        out = np.zeros((len(found), len(terms)))
        for row, (ks, ws) in zip(out, found):
            row[number[ks]] = ws
        return terms, out

    def normal(matrix):
        """The matrix's transpose times the matrix times ``matrix``."""
        sent = spark.sparkContext.broadcast(matrix)

        def run(batches):
            sums = np.zeros(sent.value.shape)
            for _, terms, cells in parts(batches):
                y = cells @ sent.value[terms]
                for at in range(0, len(terms), BLOCK_TERMS):
                    sums[terms[at : at + BLOCK_TERMS]] += cells[:, at : at + BLOCK_TERMS].T @ y
            for at in range(0, n_terms, BLOCK_TERMS):
                yield of_terms(at, sums[at : at + BLOCK_TERMS])

        def of_terms(at, sums):
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["at", "sums"])

        def add_up(table):
            return pa.Table.from_batches([of_terms(table["at"][0].as_py(), sum(np.frombuffer(x.as_buffer()) for x in table["sums"]))])

        rows_of_sums = rows.select("cells").coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(run, "at int, sums binary")
        out = np.zeros(matrix.shape)
        for at, sums in zip(*rows_of_sums.groupBy("at").applyInArrow(add_up, "at int, sums binary").toArrow().select(["at", "sums"]).columns):
            at, found = at.as_py(), np.frombuffer(sums.as_buffer()).reshape(-1, matrix.shape[1])
            out[at : at + len(found)] = found
        sent.unpersist()
        return out

    for _ in range(rounds):
        basis = np.linalg.qr(normal(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ normal(basis))
    order = np.argsort(-values, kind="stable")[: min(dims, width)]
    axes = with_fixed_sign((basis @ turn[:, order]).T).T
    sent = spark.sparkContext.broadcast(axes)

    def project(batches):
        schema = None
        for batch, terms, cells in parts(batches):
            y = cells @ sent.value[terms]
            y /= np.linalg.norm(y, axis=1, keepdims=True) + eps
            schema = schema or pa.schema([batch.schema.field(0), ("fingerprint", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(y)], schema=schema)

    return rows.mapInArrow(project, f"id {id_kind}, fingerprint array<double>"), np.sqrt(np.clip(values[order], 0, None))
