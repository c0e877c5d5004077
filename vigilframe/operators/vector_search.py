"""Exact cosine search of a set of queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions.vectors import cosine_to_unit

#: queries in one matrix product, queries that are sent to all tasks at most, and rows in a block beyond that
BLOCK, MOST, ROWS = 512, 8192, 65_536
#: numbers in a matrix of cosines at most, which bounds a task's memory
CELLS = 1 << 22


def _matrix(ids: pa.Array, vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors as rows of a matrix; one of another width than the first fails by its id."""
    lengths = np.diff(vectors.offsets.to_numpy())
    width = int(lengths[0]) if width is None else width
    if (lengths != width).any():
        at = int(np.flatnonzero(lengths != width)[0])
        raise ValueError(f"the vector of {ids[at].as_py()} has {lengths[at]} numbers, not {width}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), width)


def _units(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def _first(cosines: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each line's k largest cosines, ties by id. Of long lines only what reaches the k-th largest is sorted."""
    if cosines.shape[1] <= 4 * k:
        return np.lexsort((np.broadcast_to(ids, cosines.shape), -cosines), axis=1)[:, :k]
    least = np.partition(cosines, -k, axis=1)[:, -k]
    out = np.empty((len(cosines), k), np.int64)
    for i, line in enumerate(cosines):
        reach = np.flatnonzero(line >= least[i])
        out[i] = reach[np.lexsort((ids[reach], -line[reach]))[:k]]
    return out


def _best(qids: np.ndarray, units: np.ndarray, ids: pa.Array, vectors: pa.Array, lists: pa.Array | None, k: int, decimals: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of each query in one batch of rows, for each list if there are lists."""
    own, x = ids.to_numpy(), _matrix(ids, vectors, units.shape[1])
    names = np.zeros(len(own)) if lists is None else np.array(lists.to_pylist(), object)
    step = max(1, min(BLOCK, CELLS // max(1, len(own))))
    listed = [(name, np.flatnonzero(names == name)) for name in dict.fromkeys(names.tolist())]
    for lo in range(0, len(qids), step):
        block = qids[lo : lo + step]
        cosines = np.round(units[lo : lo + step] @ x.T, decimals)
        for name, here in listed:
            part, place = cosines[:, here], own[here]
            order = _first(part, place, k)
            columns = [pa.array(np.repeat(block, order.shape[1])), pa.array(place[order].ravel()), pa.array(np.take_along_axis(part, order, 1).ravel())]
            if lists is None:
                yield pa.RecordBatch.from_arrays(columns, names=["qid", "id", "cosine"])
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array([name] * len(columns[0]), pa.string())], names=["qid", "id", "cosine", "list_id"])


def topk_exact(queries: DataFrame, rows: DataFrame, k: int, decimals: int = 6, most: int = MOST) -> DataFrame:
    """qid, id, cosine, rank of the k best rows of each query, ties by id.

    queries: qid, vector. rows: id, vector (unit), optionally list_id: then the k best of each list. Null vectors are left out on
    both sides; a vector of another width fails by its id. Only the k best of each batch leave a task, so what is shuffled is
    queries times batches times k rows, not pairs.

    Up to `most` queries are sent to all tasks, and the rows are read once where they are. Of more, those with equal vectors are
    asked once. What is more still is a table dealt to blocks, as the rows are, and each pair of blocks meets in a task.
    """
    by_list = "list_id" in rows.columns
    rows = rows.where("vector is not null").select(F.col("id").cast("long").alias("id"), "vector", *(["list_id"] if by_list else []))
    asked = queries.where("vector is not null").select(F.col("qid").cast("long").alias("qid"), "vector")
    schema = f"qid long, id long, cosine double{', list_id string' if by_list else ''}"
    spark = rows.sparkSession
    if asked.limit(most + 1).count() <= most:
        table = asked.toArrow().combine_chunks()
        if not table.num_rows:
            found = spark.createDataFrame([], schema)
        else:
            held = [c.chunk(0) if c.num_chunks else c.combine_chunks() for c in table.columns]
            sent = spark.sparkContext.broadcast((held[0].to_numpy(), _units(_matrix(*held))))

            def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                qids, units = sent.value
                for batch in batches:
                    if batch.num_rows:
                        yield from _best(qids, units, batch.column(0), batch.column(1), batch.column(2) if by_list else None, k, decimals)

            found = rows.mapInArrow(each, schema)
    else:
        n, ones = asked.count(), asked.groupBy("vector").agg(F.min("qid").alias("one"))
        if ones.count() < n:
            equal = asked.join(ones, "vector").select("qid", "one")
            return topk_exact(ones.withColumnRenamed("one", "qid"), rows, k, decimals, most).withColumnRenamed("qid", "one").join(equal, "one").select("qid", "id", "cosine", *(["list_id"] if by_list else []), "rank")
        # new columns on both sides: queries may come from the rows themselves
        asked, rows = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (asked, rows))
        sides = [(asked, "qid", max(1, n // most + 1)), (rows, "id", max(1, rows.count() // ROWS + 1))]
        (a, b), (na, nb) = ((df.withColumn(f"__{key}", F.pmod(F.xxhash64(key), F.lit(n))) for df, key, n in sides), (sides[0][2], sides[1][2]))
        a = a.withColumn("__id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))))
        b = b.withColumn("__qid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(na - 1).cast("long"))))

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.Table.from_batches([], pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64()), *([("list_id", pa.string())] if by_list else [])]))
            whole = lambda t, c: t.column(c).combine_chunks()
            units = _units(_matrix(whole(left, "qid"), whole(left, "vector")))
            return pa.Table.from_batches(_best(whole(left, "qid").to_numpy(), units, whole(right, "id"), whole(right, "vector"), whole(right, "list_id") if by_list else None, k, decimals))

        found = a.groupBy("__qid", "__id").cogroup(b.groupBy("__qid", "__id")).applyInArrow(pair, schema)
    keys = ["qid", *(["list_id"] if by_list else [])]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cosine"), "id")))
    return ranked.where(F.col("rank") <= k)


def similarity_of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (…, id, query_vector) with cosine, looked up by id. An unknown id fails."""
    joined = pairs.join(rows.select("id", F.col("vector").alias("__v")), "id", "left")
    known = F.when(F.col("__v").isNull(), F.raise_error(F.concat(F.lit("no vector of id "), F.col("id").cast("string")))).otherwise(F.col("__v"))
    return joined.withColumn("cosine", cosine_to_unit(F.col("query_vector"), known)).drop("__v")
