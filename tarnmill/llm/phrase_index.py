"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarnmill.llm import textbytes as tb
from tarnmill.llm.common import materialise

#: Bytes of benchmark text whose words are sent to the executors at once.
BLOCK_BYTES = 32 << 20
#: Empty places between the documents of a segment; the width of a window and the slack stay below it.
GAP = 256


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash of each word, text of each word, number of texts)."""
    data, offsets = tb.text_buffer(texts)
    data = tb.ASCII_LOWER[data]
    start, end, text = tb.words(data, offsets, tb.ALNUM)
    return tb.run_hashes(data, start, end), text, len(offsets) - 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional inverted index of all words of ``docs``, one row for each segment of documents.

    A segment holds some MB of whole texts: ``ids`` and ``n_words`` of its documents, its sorted ``terms`` (word
    hashes), ``starts`` of each term's posting list, and the concatenated ``postings``. A posting is the place of a
    word in the segment: documents follow one another with ``GAP`` empty places between, so no phrase reaches from one
    into the next. Segments are independent, so building and searching need no shuffle, and a hot term is spread over
    all segments.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("segment", T.StringType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("n_words", T.ArrayType(T.IntegerType()))]
        + [T.StructField(c, T.BinaryType()) for c in ("terms", "starts", "postings")]
    )
    arrow = to_arrow_schema(schema)

    def build(batches):
        number, pack = 0, zstandard.ZstdCompressor(level=1)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for piece in tb.slices(batch, "text"):
                hashes, text, n = word_hashes(piece.column(1))
                n_words = np.bincount(text, minlength=n).astype(np.int32)
                place = (np.arange(len(hashes)) + GAP * text).astype(np.int32)
                order = np.argsort(hashes, kind="stable")
                terms, first = np.unique(hashes[order], return_index=True)
                starts = np.append(first, len(hashes)).astype(np.int32)
                deltas = np.diff(place[order], prepend=np.int32(0)).astype(np.int32)
                out = [
                    pa.array([f"{part}-{number}"]), pa.array([piece.column(0).to_pylist()], arrow.field("ids").type), pa.array([n_words.tolist()], arrow.field("n_words").type),
                    *(pa.array([pack.compress(x.tobytes())], pa.binary()) for x in (terms, starts, deltas)),
                ]
                yield pa.RecordBatch.from_arrays(out, schema=arrow)
                number += 1

    return rows.mapInArrow(build, schema)


class Windows:
    """The words of benchmark items, each once, and the windows over them: where each begins, its length and item."""

    def __init__(self, item_ids: list[str], texts: pa.Array, width: int) -> None:
        self.hashes, text, n = word_hashes(texts)
        self.items = item_ids
        count = np.bincount(text, minlength=n)
        first = np.cumsum(count) - count
        size = np.minimum(count, width)
        windows = np.where(count > 0, count - size + 1, 0)
        self.item = np.repeat(np.arange(n), windows)
        self.start = np.arange(len(self.item)) - np.repeat(np.cumsum(windows) - windows, windows) + first[self.item]
        self.size = size[self.item]

    def parts(self, most: int = 1 << 15):
        """Parts of at most ``most`` windows of one length: (length, places of their words in ``hashes``, items)."""
        for size in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == size)
            for at in range(0, len(own), most):
                w = own[at : at + most]
                yield size, self.start[w][:, None] + np.arange(size), self.item[w]


def match(starts: np.ndarray, postings: np.ndarray, ranks: np.ndarray, slack: int, most: int = 1 << 20):
    """Yields (window, start, exact) arrays: each place in which a window begins, once.

    A window begins where its first word stands, if each of its words stands within ``slack`` places of its own;
    it is exact if all stand there. ``ranks``: (windows, words) positions of the words' terms among the lists, -1 for
    words that no list has. Term k has the places postings[starts[k]:starts[k + 1]].

    The list of a window's rarest term gives the starts; the lists of its other terms, from the rarest on, are
    intersected with it after adjusting for their offsets. All windows are intersected together: a posting's key is
    its term's rank above its place, so one sorted array holds all the lists.
    """
    size = ranks.shape[1]
    window = np.flatnonzero((ranks >= 0).all(axis=1))
    if not len(window):
        return
    rank = ranks[window].astype(np.int64)
    counts = np.diff(starts)[rank]
    order = np.argsort(counts, axis=1, kind="stable")
    keys = (np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts)) << 32) + postings
    anchors = np.take_along_axis(counts, order[:, :1], 1)[:, 0].astype(np.int64)
    shifts = np.arange(-slack, slack + 1)
    done, upto = 0, np.cumsum(anchors) * len(shifts)

    def stands(wanted, within):
        at = np.searchsorted(keys, wanted - within)
        return (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= wanted + within)

    while done < len(window):
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + most, "right")))
        rows = np.arange(done, stop)
        who = np.repeat(rows, anchors[rows])
        nth = np.arange(len(who)) - np.repeat(np.cumsum(anchors[rows]) - anchors[rows], anchors[rows])
        place = order[who, 0]
        start = postings[starts[rank[who, place]] + nth].astype(np.int64) - place
        who, start = np.repeat(who, len(shifts)), (start[:, None] + shifts).reshape(-1)
        begins = (start >= 0) & stands((rank[who, 0] << 32) + start, 0)
        if slack:
            who, start = np.unique(np.stack([who[begins], start[begins]]), axis=1)
        else:
            who, start = who[begins], start[begins]
        exact = np.ones(len(who), bool)
        for j in range(size):
            if not len(who):
                break
            place = order[who, j]
            wanted = (rank[who, place] << 32) + start + place
            near = stands(wanted, slack)
            if slack:
                exact &= stands(wanted, 0)
            who, start, exact = who[near], start[near], exact[near]
        yield window[who], start, exact
        done = stop


def search_index(index: DataFrame, windows: Windows, slack: int) -> DataFrame:
    """(segment, row, id, n_words, hits, items, near) per document of the index.

    ``hits``: positions of the words inside exact matches; ``items``: ids, as strings, of items with an exact match;
    ``near``: ids of items that only have matches within ``slack``.
    """
    sent = index.sparkSession.sparkContext.broadcast(windows)
    id_type = index.schema["ids"].dataType.elementType
    strings = T.ArrayType(T.StringType())
    schema = T.StructType(
        [T.StructField("segment", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("id", id_type), T.StructField("n_words", T.LongType()),
         T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", strings), T.StructField("near", strings)]
    )
    arrow = to_arrow_schema(schema)

    def search(batches):
        w, unpack = sent.value, zstandard.ZstdDecompressor()
        words, which = np.unique(w.hashes, return_inverse=True)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k] for i, c in enumerate(batch.schema.names)}
                load = lambda c, kind: np.frombuffer(unpack.decompress(row[c].as_py()), kind)  # noqa: B023, E731
                n_words = np.asarray(row["n_words"].as_py(), np.int64)
                n = len(n_words)
                first = np.concatenate([[0], np.cumsum(n_words + GAP)])
                starts, postings = own_lists(load("terms", np.uint64), load("starts", np.int32), np.cumsum(load("postings", np.int32), dtype=np.int64), words)
                change = np.zeros(first[-1] + 1, np.int32)
                found: list[list[np.ndarray]] = [[], []]
                rank = np.where(np.diff(starts) > 0, np.arange(len(words)), -1)[which.reshape(-1)]
                for size, places, items in w.parts():
                    for window, start, exact in match(starts, postings, rank[places], slack):
                        doc = np.searchsorted(first, start, "right") - 1
                        np.add.at(change, start[exact], 1)
                        np.add.at(change, start[exact] + size, -1)
                        for out, some in zip(found, (exact, ~exact)):
                            out.append(np.unique(np.stack([doc[some], items[window[some]]], 1), axis=0))
                exact_of, near_of = ({}, {})
                for out, of in zip(found, (exact_of, near_of)):
                    for d, i in np.concatenate(out).tolist() if out else ():
                        of.setdefault(d, set()).add(i)
                covered = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                hits: list = [[] for _ in range(n)]
                if len(covered):
                    doc = np.searchsorted(first, covered, "right") - 1
                    for d in np.unique(doc).tolist():
                        hits[d] = (covered[doc == d] - first[d]).tolist()
                names = lambda s: sorted({w.items[i] for i in s})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"].as_py()] * n, arrow.field(0).type), pa.array(np.arange(n, dtype=np.int32)), pa.array(row["ids"].as_py(), arrow.field(2).type), pa.array(n_words),
                        pa.array(hits, arrow.field(4).type), pa.array([names(exact_of.get(d, ())) for d in range(n)], arrow.field(5).type),
                        pa.array([sorted({*names(near_of.get(d, ()))} - {*names(exact_of.get(d, ()))}) for d in range(n)], arrow.field(6).type),
                    ],
                    schema=arrow,
                )

    return index.mapInArrow(search, schema)


def own_lists(terms: np.ndarray, starts: np.ndarray, postings: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, postings) of the lists of the sorted ``words`` alone; words that are no term have an empty list."""
    at = np.minimum(np.searchsorted(terms, words), max(0, len(terms) - 1))
    known = terms[at] == words if len(terms) else np.zeros(len(words), bool)
    count = np.where(known, np.diff(starts)[at], 0) if len(terms) else np.zeros(len(words), np.int64)
    begin = np.concatenate([[0], np.cumsum(count)])
    return begin, postings[np.arange(begin[-1]) + np.repeat((starts[at] if len(terms) else 0) - begin[:-1], count)]


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = 10, slack: int = 2, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Where windows of ``width`` words of the benchmark occur in the documents.

    Returns per document: id (as ``id_col``), ``n_words``, ``hits`` (positions of the words inside exact matches),
    ``items`` (ids as sorted strings) and ``near`` (items that occur only with words off their places: the window's
    first word stands where it begins, and each other within ``slack`` words of its own place). Items of fewer words
    than ``width`` are one window.

    All words of the documents are indexed and the index is stored. The benchmark is the stated query set. It goes to
    the executors in blocks of about ``block_bytes`` bytes, its words once and not once a window; the index is searched
    block by block, and where there are several each document's results are merged.

    Defined cases: null and empty texts have no words and match nothing; rows that share an id are separate
    documents; items that share an id are one item; a null item id is written "null"; an empty benchmark matches
    nothing; other columns are dropped; an empty table gives an empty table.
    """
    if width + slack >= GAP:
        raise ValueError(f"width and slack together stay below {GAP}")
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    index = materialise(build_index(docs, id_col, text_col), "phrase-index")
    found = []
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        rows = part.toArrow()
        found.append(search_index(index, Windows(rows["item"].to_pylist(), rows["text"].combine_chunks(), width), slack))
    out = found[0]
    if blocks > 1:
        for more in found[1:]:
            out = out.unionByName(more)
        merge = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        out = out.groupBy("segment", "row", "id", "n_words").agg(merge("hits"), F.array_sort(merge("items")).alias("items"), F.array_sort(merge("near")).alias("near"))
        out = out.withColumn("near", F.array_except("near", "items"))
    return out.select(F.col("id").alias(id_col), "n_words", "hits", "items", "near")


def op9_phrase_index(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = contamination(docs, benchmark)
    return out.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"), F.sha2(F.array_join("near", ","), 256).alias("near_sha256"),
    )


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM g) WHERE len(ws) >= k)),
hit AS (SELECT rid, item_id, i, dw.k AS k FROM dw JOIN g ON dw.w = g.w AND dw.k = g.k),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hit) GROUP BY rid),
gw AS (SELECT item_id, k, string_split(w, ' ') AS q FROM g),
pl AS (SELECT rid, ws, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS s FROM d),
second AS (SELECT rid, item_id, k, q, s, list_slice(ws, greatest(1, s - 2), s + k + 1) AS u, s - greatest(1, s - 2) AS before FROM pl JOIN gw ON x = q[1]
  WHERE k = 1 OR list_contains(list_slice(ws, greatest(1, s - 1), s + 3), q[2])),
close AS (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM second WHERE len(list_filter(range(1, k + 1), lambda j: NOT list_contains(list_slice(u, greatest(1, before + j - 2), before + j + 2), q[j]))) = 0),
nr AS (SELECT rid, count(*) AS n_near, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT * FROM close EXCEPT SELECT DISTINCT rid, item_id::VARCHAR FROM hit) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(nr.ids, '')) AS near_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN its USING (rid) LEFT JOIN nr USING (rid)"""
