"""Signed publishing: a list's files, a manifest of their hashes, a detached signature, verification and mirrors.

Files are hashed where they are read; the driver holds the manifest only, one entry for each file.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions import hashing

FILE = "path string, sha256 string, size long"


def _fs(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    fs, target = _fs(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(content))
    out.close()


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), sha256 and size of each data file, hashed in tasks."""
    _, root = _fs(spark, folder)
    base = root.toUri().getPath().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    relative = F.substring_index(F.col("path"), base, -1)
    return found.select(relative.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def publish(spark: SparkSession, entities: DataFrame, catalog: DataFrame, path: str, sequence: int, private_key: bytes) -> dict:
    """Write entities (by list, sorted by id) and catalog (sorted by id) as JSON lines, then the manifest and its signature, in this
    order: what has no signature isn't published. Returns the manifest."""
    entities.repartition("source_list").sortWithinPartitions("source_list", "entity_id").write.partitionBy("source_list").json(f"{path}/entities")
    catalog.coalesce(1).sortWithinPartitions("id").write.json(f"{path}/catalog")
    files = [r.asDict() for r in _files(spark, path).orderBy("path").collect()]
    manifest = {"sequence": sequence, "files": files}
    body = hashing.canonical_json(manifest).encode()
    _put(spark, f"{path}/manifest.json", body)
    _put(spark, f"{path}/manifest.sig", hashing.ed25519_sign(spark, private_key, body))
    return manifest


def _manifest(spark: SparkSession, path: str, public_key: bytes, live_sequence: int = 0) -> dict:
    read = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.*").load(path).collect()}
    if not hashing.ed25519_verify(spark, public_key, read.get("manifest.json", b""), read.get("manifest.sig", b"")):
        raise ValueError("the manifest isn't signed by this key")
    manifest = json.loads(read["manifest.json"])
    if manifest["sequence"] < live_sequence:
        raise ValueError(f"sequence {manifest['sequence']} is older than {live_sequence}")
    return manifest


def verify(spark: SparkSession, path: str, public_key: bytes, live_sequence: int = 0) -> DataFrame:
    """path and problem (missing, unlisted, size, content) of files that differ from the signed manifest; a manifest that isn't
    signed by the key, or is older than the live one, is an error."""
    listed = spark.createDataFrame([(f["path"], f["sha256"], f["size"]) for f in _manifest(spark, path, public_key, live_sequence)["files"]], FILE)
    both = listed.select("path", F.struct("sha256", "size").alias("want")).join(_files(spark, path).select("path", F.struct("sha256", "size").alias("got")), "path", "full")
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("got.size") != F.col("want.size"), "size").when(F.col("got.sha256") != F.col("want.sha256"), "content")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def mirror(spark: SparkSession, source: str, target: str, public_key: bytes) -> int:
    """Copy an origin byte for byte, or not at all: it is verified, copied beside the target, verified there and renamed. Returns the
    number of files. The target must not exist."""
    if (bad := verify(spark, source, public_key).first()) is not None:
        raise ValueError(f"{bad['path']}: {bad['problem']}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    (from_fs, a), (to_fs, b) = _fs(spark, source), _fs(spark, target)
    if to_fs.exists(b):
        raise FileExistsError(target)
    _, beside = _fs(spark, f"{target}-{uuid.uuid4().hex}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, a, to_fs, beside, False, conf)
    if (bad := verify(spark, beside.toString(), public_key).first()) is not None:
        raise ValueError(f"{bad['path']}: {bad['problem']}")
    if not to_fs.rename(beside, b):
        raise OSError(f"{target} can't be made")
    return len(_manifest(spark, target, public_key)["files"])
