"""Archives of arrays (zip members in the npy format) as a source and a sink, and binary artifacts in general."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.sources.files import scratch, written

_MEMBERS = "path string, member string, dtype string, shape array<bigint>, values array<double>, problem string"


def pack_arrays(df: DataFrame, key: str, arrays: dict[str, str], out: str = "content") -> DataFrame:
    """(key, content): the array columns of a row as one archive; ``arrays`` names the dtype of each column.

    A column of arrays of arrays becomes a matrix; ragged rows are an error. A null is left out of its archive.
    """
    columns, kind = list(arrays), df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    for k, name in enumerate(columns, 1):
                        value = batch.column(k)[r].as_py()
                        if value is not None:
                            member = io.BytesIO()
                            np.lib.format.write_array(member, np.array(value, arrays[name]), allow_pickle=False)
                            z.writestr(zipfile.ZipInfo(f"{name}.npy"), member.getvalue())
                rows.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=[key, out])

    return df.select(key, *columns).mapInArrow(run, f"{key} {kind}, {out} binary")


def write_artifacts(df: DataFrame, name: str, content: str, suffix: str) -> DataFrame:
    """Writes each row's binary ``content`` as a file of its own and returns their manifest (name, path, bytes).

    The files lie in the shared folder. A task's attempt writes to a folder of its own, and the manifest, a table with
    Spark's commit protocol, names only files of attempts that succeeded. Null content writes nothing.
    """
    folder = scratch(df.sparkSession, "artifacts")

    def run(batches):
        store = None
        for batch in batches:
            made = []
            for label, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = f"{folder}/attempt-{TaskContext.get().taskAttemptId()}"
                if store is None:
                    store, root = pafs.FileSystem.from_uri(at)
                    store.create_dir(root, recursive=True)
                    number = 0
                with store.open_output_stream(f"{root}/{number:07d}{suffix}", compression=None) as f:
                    f.write(data)
                made.append((label, f"{at}/{number:07d}{suffix}", len(data)))
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["name", "path", "bytes"])

    rows = df.filter(F.col(content).isNotNull()).select(F.col(name).cast("string").alias("name"), content)
    return written(rows.mapInArrow(run, "name string, path string, bytes bigint"), "artifact-manifest")


def read_members(contents: DataFrame) -> DataFrame:
    """(path, member, dtype, shape, values, problem) of each array in the archives (path, content), values flattened.

    What can't be read gives a row with ``problem`` and without values: a file that is no archive (null member), a member
    that is cut or damaged, not an array, or of other values than numbers. Nothing is unpickled.
    """

    def members(path, data):
        try:
            z = zipfile.ZipFile(io.BytesIO(data))
            names = z.namelist()
        except Exception as e:  # damaged files are reported, whatever the reader calls the damage
            yield (path, None, None, None, None, f"no archive: {type(e).__name__}")
            return
        for name in names:
            try:
                x = np.lib.format.read_array(io.BytesIO(z.read(name)), allow_pickle=False)
                if x.dtype.kind not in "biuf":
                    raise ValueError(f"values of type {x.dtype}")
                yield (path, name.removesuffix(".npy"), str(x.dtype), list(x.shape), x.astype(np.float64).ravel(), None)
            except Exception as e:
                yield (path, name.removesuffix(".npy"), None, None, None, f"no array: {type(e).__name__}")

    kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.string())

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(members(path, data.as_py() or b""))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in _MEMBERS.split(", ")])

    return contents.select("path", "content").mapInArrow(run, _MEMBERS)


def scan_arrays(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The arrays of the archives below a path or glob, or of a list of files, as ``read_members`` gives them.
    Files without a byte are left out by Spark's listing."""
    return read_members(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(paths))


def scan_manifest(manifest: DataFrame) -> DataFrame:
    """The arrays of the archives of a manifest (name, path), read by the tasks; ``path`` is the name."""

    def run(batches):
        for batch in batches:
            for name, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, inner = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(inner, compression=None) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f.read()], pa.binary())], names=["path", "content"])

    spread = manifest.select("name", "path").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return read_members(spread.mapInArrow(run, "path string, content binary"))
