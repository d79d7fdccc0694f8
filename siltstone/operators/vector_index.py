"""Nearest neighbours by an inverted file: vectors in cells around centroids, the nearest cells read, exact similarities of what they hold.

Parquet tables below one folder: centroids (cell, centroid), settings (probes), vectors (batch, cell, key, project, unit) and deletes
(batch, key, project). Vectors are stored at length one, so that a similarity is a sum of products. Centroids come from
k-means over at most SAMPLE_ROWS rows chosen by a hash of the key; every row is indexed. Rows of a change are a batch of
their own; they delete their keys from all batches before, and a deleted project is a row of deletes. How much a search may
miss is a matter of how many cells it reads: that number is set when the index is built, as the least with which the sample's
own neighbours are found to the share RECALL, with a margin; `recall` measures it against a scan of all.

A search lays the cells out in parts of a bounded number of rows and sends each query once to every part that holds one of its
cells. What meets in a part is multiplied cell by cell, and only the k best of a query leave it: the pairs are never rows.

Rows without a key or vector are left out; a vector of zeros has similarity 0 to all, one with NaN or infinity NaN, the first in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS, ROUNDS = 20_000, 12
MOST_CELLS = 4096
BLOCK_ROWS = 512  # so many rows at a time are compared with all cells
PART_ROWS, LEAST_ROWS = 1 << 16, 1 << 10  # so many rows of the index, at most and at least, meet so many queries at a time
TILE = 1 << 22  # so many similarities are held at a time
KEPT = 1 << 21  # and so many best ones
RECALL, MARGIN, TRIALS, NEIGHBOURS = 0.95, 0.02, 400, 10


def unit(vector: Column) -> Column:
    """The vector at length one, as doubles. The sum of squares is taken once: within the lambda it would be taken for each element."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    scaled = lambda total: F.transform(wide, lambda x: F.when(F.sqrt(total) > 0, x / F.sqrt(total)).otherwise(0.0))
    return F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x, scaled)


def own_cells(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest cell of each row, in blocks."""
    return np.concatenate([(rows[at : at + BLOCK_ROWS] @ centres.T).argmax(1) for at in range(0, len(rows), BLOCK_ROWS)])


def centroids_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; empty cells keep their centroid."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        own = own_cells(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray) -> int:
    """How many cells a search must read to find the share RECALL of the nearest rows, tried on rows of the sample."""
    tried = sample[np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)]
    near = np.argsort(-(tried @ sample.T), axis=1)[:, :NEIGHBOURS]
    own = own_cells(sample, centres)
    place = np.argsort(np.argsort(-(tried @ centres.T), axis=1), axis=1)  # of each cell in the order of a trial
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil((RECALL + MARGIN) * len(needed))) - 1)]) + 1


def _ranked(rows: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The nearest cells of each row, nearest first; the first one of equally near ones. An index without centroids has one cell."""
    if not len(centres):
        return np.zeros((len(rows), 1), np.int32)
    near = rows @ centres.T
    near[np.isnan(near)] = -np.inf
    found = near.argmax(1)[:, None] if probes == 1 else np.argsort(-near, axis=1, kind="stable")[:, :probes]
    return found.astype(np.int32)


def nearest_cells(units: pd.Series, centres: np.ndarray, probes: int) -> list[np.ndarray]:
    """The nearest cells of each row, in blocks: similarities to all cells take memory by the block, not by the batch."""
    out: list[np.ndarray] = []
    for at in range(0, len(units), BLOCK_ROWS):
        out.extend(_ranked(np.stack(units.iloc[at : at + BLOCK_ROWS].to_numpy()), centres, probes))
    return out


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row for each vector."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), lengths[0] if len(lengths) else 0)


def _rounded(scores: np.ndarray) -> np.ndarray:
    """To six digits, halves away from zero as Spark rounds them, without a negative zero."""
    return np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6, scores) + 0.0


def nearest_rows(
    units: np.ndarray, cells: np.ndarray, places: np.ndarray, asked: np.ndarray, askers: np.ndarray, looks: np.ndarray, k: int, groups: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of the k best rows of each query among those of its cells; of equal scores, rows with smaller places.

    cells, places: of each row, places without ties. askers, looks: a query and a cell it looks into. groups: of each row and
    query; only rows of a query's own group count.
    """
    k = min(k, len(units))
    by_cell = np.lexsort((places, cells))
    units, cells, places = units[by_cell], cells[by_cell], np.append(places[by_cell], np.iinfo(np.int64).max)  # the last: of no row
    of_row, of_query = (groups[0][by_cell], groups[1]) if groups else (None, None)
    turn = np.argsort(looks, kind="stable")
    askers, looks = askers[turn], looks[turn]
    odd = bool(np.isnan(units).any() or np.isnan(asked).any())
    best, best_at = np.full((len(asked), k), -np.inf), np.full((len(asked), k), -1)
    edges = np.flatnonzero(np.diff(cells, prepend=-1, append=-1))
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        low, high = np.searchsorted(looks, cells[start], "left"), np.searchsorted(looks, cells[start], "right")
        for at in range(low, high, step := max(1, TILE // (end - start))):
            who = askers[at : min(at + step, high)]
            near = asked[who] @ units[start:end].T
            if odd:
                near[np.isnan(near)] = np.inf
            if groups:
                near[of_query[who][:, None] != of_row[None, start:end]] = -np.inf
            hits = near >= best[who, -1:] - 2e-6
            many = np.flatnonzero(hits.sum(1) > 2 * k)  # of these only the k best of the cell
            if len(many):
                close = _rounded(near[many])
                least = -np.partition(-close, k - 1, axis=1)[:, k - 1 : k]
                above, even = close > least, close == least
                hits[many] = above | even & (np.cumsum(even, axis=1) <= k - above.sum(1, keepdims=True))
            query, row = np.nonzero(hits & (near > -np.inf) if groups else hits)
            if not len(query):
                continue
            some, query = np.unique(query, return_inverse=True)
            mine = who[some]
            whose = np.append(np.repeat(np.arange(len(some)), k), query)
            scores = np.append(best[mine], _rounded(near[some[query], row]))
            rows = np.append(best_at[mine], start + row)
            order = np.lexsort((places[rows], -scores, whose))
            kept = order[np.searchsorted(whose[order], np.arange(len(some)))[:, None] + np.arange(k)]
            best[mine], best_at[mine] = scores[kept], rows[kept]
    query, slot = np.nonzero(best_at >= 0)
    score = best[query, slot]
    score[np.isinf(score)] = np.nan
    return query, by_cell[best_at[query, slot]], score


def laid_out(counts: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """Cell, first part and number of parts of each cell: parts hold about `most` rows at most, neighbouring cells share one."""
    out, part, filled = [], 0, 0
    for cell, n in sorted(counts.items()):
        if filled and filled + n > most:
            part, filled = part + 1, 0
        cuts = -(-n // most)
        out.append((cell, part, cuts))
        part, filled = (part + cuts, 0) if cuts > 1 else (part, filled + n)
    return out


def parts_of(places: list[tuple[int, int, int]]) -> int:
    return max((part + cuts for _, part, cuts in places), default=1)


class VectorIndex:
    """An index in a folder. kind: the SQL type of the keys."""

    def __init__(self, spark: SparkSession, folder: str, kind: str) -> None:
        self.spark, self.folder, self.kind = spark, folder, kind

    @staticmethod
    def build(rows: DataFrame, folder: str, cells: int | None = None) -> VectorIndex:
        """rows: key, project, embedding."""
        index = VectorIndex(rows.sparkSession, folder, rows.schema["key"].dataType.simpleString())
        known = rows.where("key is not null and embedding is not null")
        total = known.count()
        share = min(1.0, SAMPLE_ROWS / max(total, 1))
        drawn = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("key")).limit(SAMPLE_ROWS).select(unit(F.col("embedding")).alias("unit")).collect()
        sample = np.array([r["unit"] for r in drawn], float)
        sample = sample[~np.isnan(sample).any(axis=1)] if len(sample) else sample
        n = min(MOST_CELLS, max(1, len(sample)), cells or max(1, int(np.sqrt(total)))) if len(sample) else 0
        found = centroids_of(sample, n) if n else np.zeros((0, 0))
        rows_ = [(i, c.tolist()) for i, c in enumerate(found)]
        index.spark.createDataFrame(rows_, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
        probes = probes_for(sample, found) if n else 1
        index.spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.parquet(f"{folder}/settings")
        index._write(rows, 0)
        return index

    def _centroids(self) -> np.ndarray:
        """At most MOST_CELLS rows."""
        rows = self.spark.read.schema("cell int, centroid array<double>").parquet(f"{self.folder}/centroids").orderBy("cell").collect()
        return np.array([r["centroid"] for r in rows], float)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Adds cell: the nearest one of `unit`."""
        centres = self.spark.sparkContext.broadcast(self._centroids())  # MOST_CELLS rows at most

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([c[0] for c in nearest_cells(batch, centres.value, 1)], dtype="int32")

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return rows.withColumn("cell", F.pandas_udf(run, "int")("unit"))

    def _sent(self, queries: DataFrame, probes: int, places: list[tuple[int, int, int]]) -> DataFrame:
        """Adds part and cells: a row for each part that holds some of the nearest cells of `asked`, with these."""
        first, cuts = np.zeros((2, 1 + max((p[0] for p in places), default=MOST_CELLS)), np.int64)
        for cell, part, n in places:
            first[cell], cuts[cell] = part, n
        shared = self.spark.sparkContext.broadcast((self._centroids(), first, cuts))  # MOST_CELLS rows at most
        step = max(1, min(BLOCK_ROWS, PART_ROWS // parts_of(places)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, first, cuts = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    some = batch.slice(at, step)
                    cells = _ranked(_matrix(some["asked"]), centres, probes)
                    query, cell = np.repeat(np.arange(len(cells)), cells.shape[1]), cells.ravel()
                    query, cell = query[held := cell < len(cuts)], cell[held]  # the others hold no rows
                    times = cuts[cell]
                    query, cell, nth = np.repeat(query, times), np.repeat(cell, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    part = (first[cell] + nth).astype(np.int32)
                    order = np.lexsort((part, query))
                    query, cell, part = query[order], cell[order], part[order]
                    edges = np.flatnonzero((np.diff(query, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(edges, len(cell)), pa.int32()), pa.array(cell, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*some.take(pa.array(query[edges])).columns, pa.array(part[edges], pa.int32()), lists], names=[*some.schema.names, "part", "cells"])

        return queries.mapInArrow(run, T.StructType([*queries.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))]))

    def _batches(self) -> list[int]:
        rows = self._deletes().select("batch").distinct().collect()
        return sorted({0, *(r["batch"] for r in rows)})

    def _deletes(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"key {self.kind}, project string, batch int").parquet(f"{self.folder}/deletes")
        except Exception as error:  # noqa: BLE001 - Spark has one class for all analysis errors
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], f"key {self.kind}, project string, batch int")

    def _write(self, rows: DataFrame, batch: int) -> None:
        known = rows.where("key is not null and embedding is not null").select("key", F.col("project").cast("string").alias("project"), unit(F.col("embedding")).alias("unit"))
        # a cell goes to one task, or to several where it is large: few files, however many tasks there are
        self._placed(known).hint("rebalance", "cell").sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/vectors/batch={batch}")

    def upsert(self, rows: DataFrame) -> None:
        """Adds rows, or replaces those of their keys."""
        batch = self._batches()[-1] + 1
        self._write(rows, batch)
        self._enter(rows.select("key", F.lit(None).cast("string").alias("project")).where("key is not null").distinct(), batch)

    def delete_project(self, project: str) -> None:
        batch = self._batches()[-1] + 1
        self._enter(self.spark.createDataFrame([(None, project)], f"key {self.kind}, project string"), batch)

    def _enter(self, deletes: DataFrame, batch: int) -> None:
        """The rows that make a batch count; without them its vectors are not read."""
        deletes.write.mode("overwrite").parquet(f"{self.folder}/deletes/batch={batch}")

    def _written(self, batches: list[int]) -> DataFrame:
        """The rows of these batches."""
        return self.spark.read.schema(f"key {self.kind}, project string, unit array<double>, batch int, cell int").parquet(f"{self.folder}/vectors").where(F.col("batch").isin(*batches))

    def _vectors(self) -> DataFrame:
        """All rows that count: of batches that were entered, not deleted by a later one."""
        batches = self._batches()
        rows = self._written(batches)
        if batches == [0]:
            return rows  # nothing was deleted, so there is nothing to deal out by key for
        deletes = self._deletes()
        by_key = deletes.where("key is not null").select(F.col("key").alias("dead_key"), F.col("batch").alias("dead_from"))
        by_project = deletes.where("key is null").select(F.col("project").alias("dead_project"), F.col("batch").alias("dead_from"))
        rows = rows.join(by_key, (F.col("key") == F.col("dead_key")) & (F.col("batch") < F.col("dead_from")), "left_anti")
        return rows.join(by_project, (F.col("project") == F.col("dead_project")) & (F.col("batch") < F.col("dead_from")), "left_anti")

    def probes(self) -> int:
        return self.spark.read.schema("probes int").parquet(f"{self.folder}/settings").first()[0]

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """query_id, key, score, rank: the k most similar vectors of each query (query_id, embedding; with a project: of that one only).

        A query looks into its nearest cells. Queries of a part are cut into blocks where they are many, and meet a copy of the part in each.
        """
        probes = self.probes() if probes is None else probes
        own = [c for c in ("project",) if c in queries.columns]
        counts = {r["cell"]: r["count"] for r in self._written(self._batches()).groupBy("cell").count().collect()}  # MOST_CELLS rows at most
        most = min(PART_ROWS, max(LEAST_ROWS, -(-sum(counts.values()) // (4 * self.spark.sparkContext.defaultParallelism))))
        places = laid_out(counts, most)
        blocks = max(1, -(-queries.count() // min(PART_ROWS, max(1, KEPT // max(1, min(k, most))))))
        asked = queries.where("embedding is not null").select("query_id", *(F.col(c).cast("string").alias("own_project") for c in own), unit(F.col("embedding")).alias("asked"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
        layout = F.broadcast(self.spark.createDataFrame(places, "cell int, first int, cuts int"))
        rows = self._vectors().join(layout, "cell").select("key", *own, "unit", "cell", (F.col("first") + F.pmod(F.xxhash64("key"), "cuts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        kind = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("key", rows.schema["key"].dataType), T.StructField("score", T.DoubleType())])

        def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
            cells = asked["cells"].combine_chunks()
            askers = np.repeat(np.arange(len(cells)), pc.list_value_length(cells).to_numpy(zero_copy_only=False))
            places = np.empty(rows.num_rows, np.int64)
            places[pc.sort_indices(rows["key"]).to_numpy()] = np.arange(rows.num_rows)
            groups = None
            if own:
                codes = {p: i for i, p in enumerate(dict.fromkeys(rows["project"].to_pylist()))}
                groups = np.array([codes[p] for p in rows["project"].to_pylist()]), np.array([codes.get(p, -1) for p in asked["own_project"].to_pylist()])
            query, row, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            if rows.num_rows and asked.num_rows and k > 0:
                query, row, score = nearest_rows(_matrix(rows["unit"]), rows["cell"].to_numpy(), places, _matrix(asked["asked"]), askers, cells.flatten().to_numpy(), k, groups)
            return pa.table({"query_id": asked["query_id"].take(pa.array(query)), "key": rows["key"].take(pa.array(row)), "score": pa.array(score)})

        tasks = min(4096, blocks * parts_of(places))
        dealt = [df.repartition(tasks, "part", "block").groupBy("part", "block") for df in (rows, self._sent(asked, probes, places))]
        best = dealt[0].cogroup(dealt[1]).applyInArrow(meet, kind)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def scan(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The same by all cells: exact."""
        return self.search(queries, k, MOST_CELLS)

    def recall(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> float:
        """The share of the exact k nearest that a search finds."""
        exact = self.scan(queries, k).select("query_id", "key")
        n, hits = exact.count(), exact.join(self.search(queries, k, probes), ["query_id", "key"]).count()
        return hits / n if n else 1.0
