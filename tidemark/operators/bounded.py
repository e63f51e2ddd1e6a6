"""Exact inner-product top-K that skips blocks by their bounds.

Items are put into blocks around centres.  With centre c, radius r, largest norm
m and the box from l to h, no item of a block scores more than ``min(q.c + |q| r,
|q| m, sum of max(q_i l_i, q_i h_i))`` for a query q.  The box tells apart blocks
of few coordinates that reach far along one of them.  A first pass answers each
query from the blocks with its highest bounds until they hold K items; the K-th
score found there is a floor, and a second pass looks only into those other
blocks whose bound reaches it.  Centres and block bounds are small tables of a
bounded size.

Blocks that lie together travel together as a *tile* of bounded bytes: a query
is sent once to a tile that holds any of its blocks, whatever their number, and
the blocks of a tile that are asked at all once for every chunk of its queries.
Inside, a block meets the queries that visit it, and only rows that can still be
among the K best are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import top_k
from tidemark.session import materialise

#: Bytes, as doubles, of the vectors of one tile of items, and of the vectors and answers of one chunk of queries.
ITEM_BYTES, QUERY_BYTES = 32 << 20, 64 << 20
#: Chunks of the queries of a tile before chunks grow.
CHUNKS = 16
#: Centres at most, and blocks at most before blocks grow.
CENTRES, BLOCKS = 2048, 2048
#: Boxes are kept of vectors of up to this width.
BOXED = 128
#: Bounds are raised by this share, far above what rounding can take away.
SLACK = 1e-9
#: Tasks of a step at most, and queries of a task that looks for their blocks, and items of one that looks for their centre.
PARTS, ROUTED, PLACED = 1000, 4096, 32_768
#: Queries whose answers are gathered together, and queries whose bounds are.
STRIP, ROUTE = 16_384, 128
#: Items of one product, and scores of one.
SEGMENT, SCORES = 2048, 1 << 19
FOUND = "query_id bigint, item_id bigint, score double"


@dataclass(frozen=True)
class BoundedTopK:
    """``found``: (query_id, item_id, score, rank); ``visits``: (queries, items, blocks, visited) in one row."""

    found: DataFrame
    visits: DataFrame


class _Best:
    """The K best items of each query of a strip, of those seen so far; ties fall to the smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor, self.waiting = k, floor, 0
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.limit = 4 * queries * k

    def look(self, vectors: np.ndarray, rows: np.ndarray, items: np.ndarray, ids: np.ndarray) -> None:
        """Scores the items, in the order of their ids, for some different queries of the strip."""
        for start in range(0, len(items), SEGMENT):
            part, names = items[start : start + SEGMENT], ids[start : start + SEGMENT]
            step = max(SCORES // len(part), 1)
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                self._add(some, vectors[some] @ part.T, names)

    def _add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        low = self.floor[rows]
        reach = scores >= low[:, None]  # what is not a number never does
        many = np.flatnonzero(np.count_nonzero(reach, axis=1) > self.k)
        if len(many):  # the K-th score among them is a floor too
            seen = scores[many]
            low[many] = np.partition(np.where(np.isnan(seen), -np.inf, seen), -self.k, axis=1)[:, -self.k]
            reach[many] = seen >= low[many, None]
            self.floor[rows[many]] = low[many]
        row, at = np.nonzero(reach)
        found = scores[row, at]
        if len(row) > self.k * len(rows):  # of those that score the floor itself, the K smallest ids
            tied = found == low[row]
            nth, starts = np.cumsum(tied), np.searchsorted(row, row)
            kept = ~tied | (nth - nth[starts] + tied[starts] <= self.k)
            row, at, found = row[kept], at[kept], found[kept]
        self.rows.append((rows[row], ids[at], found))
        self.waiting += len(row)
        if self.waiting > self.limit:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, ids, scores = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], scores[last])
        kept = place < self.k
        self.rows, self.waiting = [(row[kept], ids[kept], scores[kept])], 0
        return self.rows[0]


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width as doubles."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks]
    return np.concatenate(flat).astype(np.float64).reshape(len(vectors), -1)


def _answers(queries: pa.Table, items: pa.Table, strips: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """Answers by place as rows with ids, which may be null."""
    columns = [np.concatenate(c) for c in zip(*strips)] if strips else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    taken = [t.column(n).take(pa.array(c)) for t, n, c in zip((queries, items), ("query_id", "item_id"), columns)]
    return pa.table(dict(zip(("query_id", "item_id", "score"), [*taken, pa.array(columns[2])])))


def tile_scan(k: int):
    """The K best items of a tile for each query of a chunk."""

    def scan(queries: pa.Table, items: pa.Table) -> pa.Table:
        strips = []
        if queries.num_rows and items.num_rows:
            items = items.sort_by("item_id")
            vectors, matrix, ids = _matrix(queries.column("query_vector")), _matrix(items.column("item_vector")), np.arange(items.num_rows)
            for start in range(0, len(vectors), STRIP):
                part = vectors[start : start + STRIP]
                best = _Best(len(part), k, np.full(len(part), -np.inf))
                best.look(part, np.arange(len(part)), matrix, ids)
                row, *found = best.fold()
                strips.append((row + start, *found))
        return _answers(queries, items, strips)

    return scan


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _assigned(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """Items with their nearest centre, their distance from it and their norm."""
    half = (centres * centres).sum(1) / 2

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _stacked(batch["vector"])
                cell = np.argmax(x @ centres.T - half, axis=1)
                away = np.linalg.norm(x - centres[cell], axis=1)
                yield batch.assign(cell=cell.astype("int32"), away=away, norm=np.linalg.norm(x, axis=1))

    kind = items.schema["vector"].dataType.simpleString()
    return items.mapInPandas(nearest, f"item_id bigint, vector {kind}, cell int, away double, norm double")


def _blocks(items: DataFrame, n: int, rows: int, width: int) -> tuple[DataFrame, np.ndarray, pd.DataFrame]:
    """Stored items with their block, the centres, and the bounds of each block."""
    wanted = min(max(math.ceil(n / rows), 2), CENTRES)
    drawn = items.orderBy(F.xxhash64("item_id"), "item_id").limit(wanted).select("vector")
    centres = _stacked(drawn.toPandas()["vector"])
    tasks = min(math.ceil(n / PLACED), PARTS)
    placed = materialise(_assigned(items.repartition(tasks), centres))
    # A crowded cell is cut by distance from its centre, so that its inner blocks keep small radii.
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("held")).withColumn("parts", F.ceil(F.col("held") / rows).cast("int"))
    ranges = F.percentile_approx("away", F.lit([i / 8 for i in range(1, 8)]), 256)
    cuts = cells.where("parts > 1").join(placed.groupBy("cell").agg(ranges.alias("cuts")), "cell").select("cell", "parts", "cuts")
    ring = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("away"))) * F.least("parts", F.lit(8)) / 8)
    ring = F.coalesce(ring, F.lit(0))
    part = F.coalesce(F.pmod(F.xxhash64("item_id"), F.greatest(F.ceil(F.col("parts") / 8), F.lit(1))), F.lit(0))
    key = F.concat_ws(".", "cell", ring, part).alias("key")
    named = materialise(placed.join(F.broadcast(cuts), "cell", "left").select("item_id", "vector", "cell", "away", "norm", key))
    parts = [F.get("vector", F.lit(i)).cast("double") for i in range(width if width <= BOXED else 0)]
    sides = [side(x).alias(f"{name}_{i}") for name, side in (("low", F.min), ("high", F.max)) for i, x in enumerate(parts)]
    bounds = named.groupBy("key", "cell").agg(
        F.count(F.lit(1)).alias("held"), F.max("away").alias("radius"), F.max("norm").alias("norm"), *sides
    )
    # At most CENTRES cells of 8 rings and n / rows parts: small numbers of a bounded table.
    table = bounds.toPandas()
    table = table.sort_values(["cell", "key"]).reset_index(drop=True)
    table["block"] = np.arange(len(table))
    # Blocks of neighbouring numbers fill a tile.
    table["tile"] = (table["held"].cumsum() - table["held"]) // tile_rows(width)
    numbers = items.sparkSession.createDataFrame(
        table[["key", "block", "tile"]].astype({"block": "int32", "tile": "int32"}), "key string, block int, tile int"
    )
    stored = materialise(named.join(F.broadcast(numbers), "key").select("item_id", F.col("vector").alias("item_vector"), "block", "tile"))
    return stored, centres, table


class _Bounds:
    """The highest score that a query can have in each block."""

    def __init__(self, centres: np.ndarray, table: pd.DataFrame):
        centres = centres[table["cell"].to_numpy()]
        radius, norm, self.held, self.tile = (table[c].to_numpy() for c in ("radius", "norm", "held", "tile"))
        slack = SLACK * (np.linalg.norm(centres, axis=1) + radius + norm)
        self.ball, self.norm = np.column_stack([centres, radius + slack]), norm + slack
        low, high = (table[[c for c in table if c.startswith(side)]].to_numpy(np.float64) for side in ("low_", "high_"))
        self.box = np.column_stack([low, high, slack]) if low.size else None
        self.starts = np.searchsorted(self.tile, np.arange(self.tile.max() + 1))

    def of(self, queries: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(queries, axis=1)[:, None]
        high = np.hstack([queries, size]) @ self.ball.T
        np.minimum(high, size * self.norm, out=high)
        if self.box is not None:
            np.minimum(high, np.hstack([np.minimum(queries, 0), np.maximum(queries, 0), size]) @ self.box.T, out=high)
        return high

    def span(self, tile: int) -> tuple[int, int]:
        """First block of a tile, and the one behind its last."""
        return self.starts[tile], np.searchsorted(self.tile, tile, "right")


def _highest(bounds: _Bounds, high: np.ndarray, k: int) -> list[np.ndarray]:
    """Blocks with the highest bounds of each row, as many as hold ``k`` items."""
    high = np.fmax(high, -np.inf)  # a broken vector's bounds come last
    lists = list(np.argmax(high, axis=1)[:, None])
    short = np.flatnonzero([bounds.held[x[0]] < k for x in lists])
    if len(short):
        high, some = high[short], min(max(k, 1), high.shape[1])  # every block holds an item
        top = np.argpartition(-high, some - 1, axis=1)[:, :some] if some < high.shape[1] else np.tile(np.arange(some), (len(high), 1))
        order = np.lexsort((top, -np.take_along_axis(high, top, 1)), axis=1)
        top = np.take_along_axis(top, order, 1)
        before = np.cumsum(bounds.held[top], axis=1) - bounds.held[top]
        for i, t, b in zip(short, top, before):
            lists[i] = t[b < k]
    return lists


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("query_vector")
    if column.null_count:
        raise ValueError("a query has no vector")
    return _matrix(pa.chunked_array([column]))


def _first_route(queries: DataFrame, bounds: _Bounds, k: int) -> DataFrame:
    """(query_id, query_vector, blocks): the blocks with the highest bounds."""
    kind = queries.schema["query_vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors, lists = _vectors(batch), []
                for at in range(0, len(vectors), ROUTE):
                    lists += _highest(bounds, bounds.of(vectors[at : at + ROUTE]), k)
                cuts = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
                blocks = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(lists).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("query_vector"), blocks], ["query_id", "query_vector", "blocks"])

    return queries.mapInArrow(run, f"query_id bigint, query_vector {kind}, blocks array<int>")


def _listed(lists: pa.Array | pa.ChunkedArray, shape: tuple[int, int], first: int = 0) -> np.ndarray:
    """Whether a row's list, of blocks counted from ``first``, has a block."""
    out, lists = np.zeros(shape, bool), lists.to_pylist()
    row, block = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([b for x in lists for b in x], int) - first
    inside = (block >= 0) & (block < shape[1])
    out[row[inside], block[inside]] = True
    return out


def _second_route(queries: DataFrame, bounds: _Bounds) -> DataFrame:
    """(query_id, query_vector, floor, tile, blocks, visited): one row for each tile with blocks that reach the floor.

    ``blocks`` has a bit for each block of the tile; those of the first pass are not visited again.
    """
    kind = queries.schema["query_vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, rows, tiles, bits, counts = _vectors(batch), [], [], [], []
            floors = batch.column("floor").fill_null(-np.inf)
            for at in range(0, len(vectors), ROUTE):
                high, floor = bounds.of(vectors[at : at + ROUTE]), floors.slice(at, ROUTE).to_numpy()
                take = (high >= floor[:, None]) & ~_listed(batch.column("blocks").slice(at, ROUTE), high.shape)
                visited = np.add.reduceat(take, bounds.starts, axis=1, dtype=np.int64)
                for tile in np.flatnonzero(visited.any(axis=0)):
                    row = np.flatnonzero(visited[:, tile])
                    rows.append(row + at)
                    tiles.append(np.full(len(row), tile, np.int32))
                    bits += map(bytes, np.packbits(take[row, slice(*bounds.span(tile))], axis=1))
                    counts.append(visited[row, tile])
            if rows:
                kept = [batch.column(c).take(pa.array(np.concatenate(rows))) for c in ("query_id", "query_vector")]
                floors = floors.take(pa.array(np.concatenate(rows)))
                columns = [*kept, floors, pa.array(np.concatenate(tiles)), pa.array(bits, pa.binary()), pa.array(np.concatenate(counts))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "query_vector", "floor", "tile", "blocks", "visited"])

    return queries.mapInArrow(run, f"query_id bigint, query_vector {kind}, floor double, tile int, blocks binary, visited bigint")


def _bits(blocks: pa.Array | pa.ChunkedArray, count: int) -> np.ndarray:
    """Whether a row's bits, one for each of ``count`` blocks, have a block."""
    packed = np.frombuffer(b"".join(blocks.to_pylist()), np.uint8).reshape(len(blocks), -1)
    return np.unpackbits(packed, axis=1, count=count).astype(bool)


def _asked_blocks(second: DataFrame, bounds: _Bounds) -> DataFrame:
    """(block): the blocks that any query visits in the second pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.zeros(len(bounds.tile), bool)
        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            for tile in np.unique(tiles):
                first, last = bounds.span(tile)
                asked[first:last] |= _bits(batch.column("blocks").filter(pa.array(tiles == tile)), last - first).any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(asked).astype(np.int32))], ["block"])

    return second.select("tile", "blocks").mapInArrow(run, "block int").distinct()


def _visit_scan(bounds: _Bounds, k: int, again: bool):
    """The K best items of each query in the blocks of a tile that it visits: the listed ones, or those of its bits."""

    def scan(queries: pa.Table, items: pa.Table) -> pa.Table:
        strips = []
        if queries.num_rows and items.num_rows:
            items = items.sort_by("item_id")
            ids = np.argsort(items.column("block").to_numpy(), kind="stable")  # places in the order of ids
            first, last = bounds.span(items.column("tile")[0].as_py())
            block, matrix = items.column("block").to_numpy()[ids] - first, _matrix(items.column("item_vector"))[ids]
            cuts = np.searchsorted(block, np.arange(last - first + 1))
            vectors, blocks = _matrix(queries.column("query_vector")), queries.column("blocks")
            for start in range(0, len(vectors), STRIP):
                part, asked = vectors[start : start + STRIP], blocks.slice(start, STRIP)
                if again:
                    floor, take = queries.column("floor").slice(start, STRIP).to_numpy().copy(), _bits(asked, last - first)
                    floor -= np.where(np.isfinite(floor), SLACK * np.abs(floor), 0)  # products of another shape may round otherwise
                else:
                    floor, take = np.full(len(part), -np.inf), _listed(asked, (len(part), last - first), first)
                best, take = _Best(len(part), k, floor), np.ascontiguousarray(take.T)
                for b in np.flatnonzero(take.any(axis=1) & (np.diff(cuts) > 0)):
                    best.look(part, np.flatnonzero(take[b]), matrix[cuts[b] : cuts[b + 1]], ids[cuts[b] : cuts[b + 1]])
                row, *found = best.fold()
                strips.append((row + start, *found))
        return _answers(queries, items, strips)

    return scan


def _answered(asked: DataFrame, blocks: DataFrame, items: DataFrame, chunk: int, scan) -> DataFrame:
    """(query_id, item_id, score): the best rows of each tile (``tile``) for the queries that ask it, of the blocks asked at all."""
    counts = asked.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    chunks = materialise(counts.select("tile", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    left = asked.join(F.broadcast(chunks), "tile").withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int"))
    asked_items = items.join(F.broadcast(materialise(blocks)), "block", "left_semi")
    right = asked_items.join(F.broadcast(chunks), "tile").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = chunks.agg(F.coalesce(F.sum("chunks"), F.lit(1))).first()[0]
    return cell_answers(left.drop("chunks"), right.drop("chunks"), ["tile", "chunk"], cells, scan)


def cell_answers(left: DataFrame, right: DataFrame, keys: list[str], cells: int, scan) -> DataFrame:
    """The scan of each cell.  Cells are few bytes and much work, so they are dealt by number and not put together by size."""
    parts = min(4 * cells, PARTS)
    left, right = left.repartition(parts, *keys), right.repartition(parts, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, FOUND)


def tile_rows(width: int) -> int:
    return max(ITEM_BYTES // (8 * (width + 1)), 1)


def chunk_size(queries: int, wanted: int | None, width: int, k: int) -> int:
    """Queries of a chunk: as wanted while chunks are few, then growing to what a task holds with the answers."""
    most = max(QUERY_BYTES // (8 * (width + 3 * k)), 1)
    return max(wanted or 1, min(math.ceil(queries / CHUNKS), most))


def bounded_top_k(queries: DataFrame, items: DataFrame, k: int, block_rows: int | None = None, chunk_rows: int | None = None) -> BoundedTopK:
    """Exact top-K items (item_id, vector) per query (query_id, vector), of finite vectors of one width.

    ``block_rows`` is the size a block of items should have; by default it
    follows from the vectors' width.
    """
    items = materialise(items.select(F.col("item_id").cast("bigint").alias("item_id"), "vector"))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    n, width = size["n"], size["width"] or 1
    spark = items.sparkSession
    queries = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").alias("query_vector"))
    if not n:
        found = spark.createDataFrame([], "query_id bigint, item_id bigint, score double, rank int")
        return BoundedTopK(found, queries.agg(F.count(F.lit(1)).alias("queries"), *[F.lit(0).cast("bigint").alias(c) for c in ("items", "blocks", "visited")]))
    rows = max(block_rows or (8 << 20) // (8 * width), math.ceil(n / BLOCKS), 1)
    stored, centres, table = _blocks(items, n, rows, width)
    bounds = _Bounds(centres, table)
    queries = materialise(queries)
    asking = queries.count()
    chunk, tasks = chunk_size(asking, chunk_rows, width, k), min(max(math.ceil(asking / ROUTED), 1), PARTS)
    first = materialise(_first_route(queries.repartition(tasks, "query_id"), bounds, k))
    tiles = F.array(*[F.lit(int(t)) for t in table["tile"]])
    asked = first.withColumn("tile", F.explode(F.array_distinct(F.transform("blocks", lambda i: F.get(tiles, i)))))
    listed = first.select(F.explode("blocks").alias("block")).distinct()
    partial = materialise(_answered(asked, listed, stored, chunk, _visit_scan(bounds, k, False)))
    kept = top_k(partial, ["query_id"], [F.col("score").desc(), "item_id"], k)
    floors = kept.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    second = materialise(_second_route(first.join(floors, "query_id", "left").repartition(tasks, "query_id"), bounds))
    rest = _answered(second, _asked_blocks(second, bounds), stored, chunk, _visit_scan(bounds, k, True))
    found = top_k(partial.unionByName(rest), ["query_id"], [F.col("score").desc(), "item_id"], k)
    looked = first.agg(F.coalesce(F.sum(F.size("blocks")), F.lit(0)).cast("bigint").alias("_one"))
    again = second.agg(F.coalesce(F.sum("visited"), F.lit(0)).cast("bigint").alias("_two"))
    visits = first.agg(F.count(F.lit(1)).alias("queries")).crossJoin(looked).crossJoin(again).select(
        "queries", F.lit(n).cast("bigint").alias("items"), F.lit(len(table)).cast("bigint").alias("blocks"), (F.col("_one") + F.col("_two")).alias("visited")
    )
    return BoundedTopK(found, visits)
