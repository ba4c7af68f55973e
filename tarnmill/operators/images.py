"""Grey images as flat arrays of pixels: windows, crops and removal of burned-in marks as array expressions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Margins that callers use around the box of bright pixels, and the brightness that counts.
MARGINS, BRIGHT = (4, 5, 8), 10


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def window(pixels: Column, center: Column | float | None = None, width: Column | float | None = None, low: float = 1.0, high: float = 99.0) -> Column:
    """The pixels mapped linearly from a band to 0..255 and truncated; those outside it are 0 or 255.

    The band is that of a centre and a width (over 0), by the standard's linear function: from center - 0.5 - (width - 1)
    / 2 to center - 0.5 + (width - 1) / 2; without them it lies between two interpolated percentiles. An empty band gives
    zeros, null pixels give null.
    """
    c, w = (F.lit(None).cast("double") if x is None else x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for x in (center, width))

    def at(ordered, percent):
        place = (F.size(ordered) - 1) * percent / 100
        left, right = F.get(ordered, F.floor(place).cast("int")), F.get(ordered, F.ceil(place).cast("int"))
        return left + (right - left) * (place - F.floor(place))

    given = c.isNotNull() & (w > 0)
    band = _bind(
        F.when(given, F.array().cast("array<double>")).otherwise(F.array_sort(F.transform(pixels, lambda x: x.cast("double")))),
        lambda o: F.struct(F.when(given, c - 0.5 - (w - 1) / 2).otherwise(at(o, low)).alias("a"), F.when(given, c - 0.5 + (w - 1) / 2).otherwise(at(o, high)).alias("b")),
    )
    scaled = lambda x, b: ((F.greatest(b["a"], F.least(b["b"], x.cast("double"))) - b["a"]) / (b["b"] - b["a"]) * 255).cast("int")
    return F.when(pixels.isNotNull(), _bind(band, lambda b: F.transform(pixels, lambda x: F.when(b["b"] > b["a"], scaled(x, b)).otherwise(F.lit(0)))))


def crop_box(pixels: Column, width: Column, threshold: Column | float, margin: int) -> Column:
    """Struct (top, bottom, left, right), ends exclusive: the rows and columns of the pixels over the threshold and
    ``margin`` more on each side, within the image; the whole image if no pixel is over it."""
    height = (F.size(pixels) / width).cast("int")
    level = threshold if isinstance(threshold, Column) else F.lit(threshold)
    marked = F.transform(pixels, lambda v, i: F.when(v > level, i))
    hits = F.filter(marked, lambda i: i.isNotNull())
    whole = F.struct(F.lit(0).alias("top"), height.alias("bottom"), F.lit(0).alias("left"), width.cast("int").alias("right"))

    def box(h):
        rows, cols = F.transform(h, lambda i: F.floor(i / width).cast("int")), F.transform(h, lambda i: (i % width).cast("int"))
        ends = lambda v, most: (F.greatest(F.lit(0), F.array_min(v) - margin), F.least(most, F.array_max(v) + margin + 1))
        (top, bottom), (left, right) = ends(rows, height), ends(cols, width.cast("int"))
        return F.when(F.size(h) > 0, F.struct(top.alias("top"), bottom.alias("bottom"), left.alias("left"), right.alias("right"))).otherwise(whole)

    return _bind(hits, box)


def crop(df: DataFrame, pixels: str, width: str, threshold: float = BRIGHT, margin: int = MARGINS[1], out: str = "cropped") -> DataFrame:
    """``df`` with ``<out>_box`` and the pixels within it as ``out``: a narrow pass of array expressions.

    Null or empty pixels, and a width that is null, not over 0 or does not divide their number, give null.
    """
    sound = F.col(pixels).isNotNull() & (F.size(pixels) > 0) & (F.col(width) > 0) & (F.size(pixels) % F.greatest(F.col(width), F.lit(1)) == 0)
    boxed = df.withColumn(f"{out}_box", F.when(sound, crop_box(F.col(pixels), F.col(width), threshold, margin)))
    b = F.col(f"{out}_box")
    rows = F.transform(F.sequence(b["top"], b["bottom"] - 1), lambda r: F.slice(F.col(pixels), (r * F.col(width) + b["left"] + 1).cast("int"), b["right"] - b["left"]))
    return boxed.withColumn(out, F.when(b.isNotNull(), F.flatten(rows)))


def regions(mask: np.ndarray) -> np.ndarray:
    """The number of the 4-connected region of each set pixel, from 1 in reading order, 0 elsewhere.

    Runs of a row are joined with the overlapping runs of the row above; a run takes the least number that it meets.
    """
    out, parent = np.zeros(mask.shape, np.int64), [0]

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        for start, stop in zip(edge[::2], edge[1::2]):
            above = {root(k) for k in np.unique(out[y - 1, start:stop]) if k} if y else set()
            mine = min(above, default=len(parent))
            if mine == len(parent):
                parent.append(mine)
            for k in above:
                parent[k] = mine
            out[y, start:stop] = mine
    final, names = np.array([root(k) for k in range(len(parent))]), {}
    out = final[out]
    for k in out[mask]:
        names.setdefault(int(k), len(names) + 1)
    table = np.zeros(len(parent), np.int64)
    for k, v in names.items():
        table[k] = v
    return table[out]


def scrub(df: DataFrame, key: str, pixels: str, width: str, threshold: int = BRIGHT, border: float = 0.06) -> DataFrame:
    """(key, pixels, n_regions, n_scrubbed, digest): marks outside the body are set to 0.

    The body is the largest 4-connected region of pixels over the threshold, the first of equals. Other regions are
    marks if they do not lie wholly within its bounding box or if they touch the border zone, the outer ``border`` share
    of rows and columns. ``digest`` is the SHA-256 of the pixels that are left, one byte each. Pixels are taken as 0 to
    255; null or ill-shaped images give null pixels, zero counts and a null digest. Images are independent rows in Arrow batches.
    """
    arrow = pa.schema([("pixels", pa.list_(pa.int32())), ("n_regions", pa.int64()), ("n_scrubbed", pa.int64()), ("digest", pa.string())])

    def one(values, w):
        if not values or not w or w < 1 or len(values) % w:
            return None, 0, 0, None
        image = np.clip(np.nan_to_num(np.array(values, float)), 0, 255).astype(np.uint8).reshape(-1, w)
        names = regions(image > threshold)
        sizes = np.bincount(names.ravel())[1:]
        gone = np.zeros(image.shape, bool)
        if len(sizes):
            body = names == int(sizes.argmax()) + 1
            ys, xs = np.nonzero(body)
            zone = np.zeros(image.shape, bool)
            my, mx = (max(1, int(n * border)) for n in image.shape)
            zone[:my], zone[-my:], zone[:, :mx], zone[:, -mx:] = True, True, True, True
            box = np.zeros(image.shape, bool)
            box[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] = True
            marks = np.unique(names[(zone | ~box) & ~body])
            gone = np.isin(names, marks[marks > 0])
        left = np.where(gone, 0, image)
        return left.ravel().tolist(), len(sizes), int(gone.sum()), hashlib.sha256(left.astype(np.uint8).tobytes()).hexdigest()

    def run(batches):
        for batch in batches:
            done = [one(v, w) for v, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([d[k] for d in done], f.type) for k, f in enumerate(arrow))], names=[batch.schema.names[0], *arrow.names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.transform(pixels, lambda x: x.cast("double")).alias("_tm_pixels"), F.col(width).cast("int").alias("_tm_width")).mapInArrow(run, f"{key} {kind}, pixels array<int>, n_regions bigint, n_scrubbed bigint, digest string")
