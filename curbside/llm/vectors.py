"""Near-duplicate vectors: inverted lists with product-quantised residuals, and exact cosines for what they let pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from curbside.llm.components import connected_components
from curbside.sources.staging import stage

#: Members of a list that are compared in one step, with each other or with so many visitors.
BLOCK = 1024
VISITORS = 4096


@dataclass
class ProductIndex:
    """Centres of the coarse lists, and for each subspace of the residual its codewords."""

    centres: np.ndarray  # lists x dimensions
    bounds: np.ndarray  # where each subspace begins, and the end
    codewords: list[np.ndarray]  # by subspace: codes x its dimensions

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest list of each unit vector, the codes of its residual, and how far these are off."""
        nearest = _nearest(unit, self.centres)
        rest = unit - self.centres[nearest]
        codes = np.empty((len(unit), len(self.codewords)), np.uint8)
        for s, words in enumerate(self.codewords):
            part = slice(self.bounds[s], self.bounds[s + 1])
            codes[:, s] = _nearest(rest[:, part], words)
            rest[:, part] -= words[codes[:, s]]
        return nearest, codes, np.sqrt((rest**2).sum(axis=1))

    def probes(self, unit: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
        """For each vector (rows) the lists (columns), its own left out, that may hold a vector within `reach` of it.

        Such a vector lies on its list's side of the plane between that list's centre and the own one, so the
        vector itself is at most `reach` away from that side.
        """
        square = (self.centres**2).sum(axis=1)
        far = square[None] - 2 * unit @ self.centres.T
        apart = np.sqrt(np.maximum(square[own][:, None] + square[None] - 2 * self.centres[own] @ self.centres.T, 0)) + 1e-7
        row = np.arange(len(unit))
        near = far - far[row, own][:, None] <= 2 * reach * apart + 1e-9
        near[row, own] = False
        return near


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)


def _centres(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 12) -> np.ndarray:
    out = x[random.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, out)
        many = np.bincount(own, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        out[many > 0] = sums[many > 0] / many[many > 0, None]
    return out


def fit_index(unit: np.ndarray, lists: int, subspaces: int = 8, seed: int = 11) -> ProductIndex:
    """An index fitted on the rows of `unit`."""
    random = np.random.default_rng(seed)
    centres = _centres(unit, lists, random)
    rest = unit - centres[_nearest(unit, centres)]
    bounds = np.linspace(0, unit.shape[1], min(subspaces, unit.shape[1]) + 1).astype(int)
    words = [_centres(rest[:, a:b], 256, random) for a, b in zip(bounds[:-1], bounds[1:])]
    return ProductIndex(centres, bounds, words)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def near_vectors(vectors: DataFrame, least: float = 0.98, sample: int = 20_000, per_list: int = 512, lists: int = 1024) -> DataFrame:
    """For each row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows are linked when their labels are equal and not null and the cosine of their vectors, in double
    precision, is `least` or more. A vector that is null, empty, zero or holds null or non-finite components
    links with nothing, nor do vectors of different lengths. A component is all that links reach; its name
    is its smallest vec_id, and that row is kept. Repeated rows link like any others. A null vec_id is
    linked with nothing, has a null component and is kept. Other columns are not read.

    Equal vectors are one entry with a count. An index for each length of vector is fitted on about `sample`
    entries, with a list for every `per_list` entries and `lists` at most; every entry is in it. The lists probed
    are all that can hold a link, and a pair is dropped by its table-lookup distance only if the known error
    of the codes allows no link, so no link is lost. A pair in two lists meets in one of them: the members of a
    list are compared with each other and with its visitors, in blocks inside tasks, and a task sends counts and
    one row for each entry and block, never pairs.
    """
    spark = vectors.sparkSession
    good = F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label"
    )
    linked = F.coalesce(good, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = stage(rows.withColumn("linked", linked), "vectors")
    valid = rows.where("linked")
    entries = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("entry"), F.count("*").alias("many"))
    entries = stage(entries.withColumn("width", F.size("embedding")), "entries")
    indexes = {}
    for width, n in entries.groupBy("width").count().orderBy(F.desc("count")).limit(64).collect():
        share = F.pmod(F.xxhash64(F.lit("index sample"), "entry"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = entries.where((F.col("width") == width) & (share <= min(1.0, sample / n))).select("entry", "embedding").toArrow().sort_by("entry")
        if drawn.num_rows:
            x = _matrix(drawn["embedding"])
            indexes[width] = fit_index(x / np.linalg.norm(x, axis=1, keepdims=True), int(np.clip(n // per_list, 1, lists)))
    shared = spark.sparkContext.broadcast(indexes)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy()
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                for at in range(0, part.num_rows, 256):
                    own = part.slice(at, 256)
                    x = _matrix(own.column("embedding"))
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    index = shared.value.get(int(w))
                    if index is None:  # a length of vector without an index: one list
                        places, enters = np.zeros(len(x), np.int64), np.ones((len(x), 1), bool)
                    else:
                        places, lists_ = _nearest(unit, index.centres), np.arange(len(index.centres))
                        # of two lists, the one of the higher number is entered if their sum is even, else the other
                        enters = index.probes(unit, places, reach) & ((lists_[None] > places[:, None]) == ((lists_[None] + places[:, None]) % 2 == 0))
                        enters[np.arange(len(x)), places] = True
                    row, cell = np.nonzero(enters)
                    yield pa.RecordBatch.from_arrays(
                        [
                            own.column(c).take(pa.array(row)) for c in ("label", "width", "entry", "many", "embedding")
                        ] + [pa.array(cell, pa.int32()), pa.array(cell == places[row])],
                        names=["label", "width", "entry", "many", "embedding", "cell", "member"],
                    )

    label = entries.schema["label"].dataType.simpleString()
    vector = entries.schema["embedding"].dataType.simpleString()
    schema = f"label {label}, width int, entry bigint, many bigint, embedding {vector}, cell int, member boolean"
    entered = stage(entries.select("label", "width", "entry", "many", "embedding").mapInArrow(enter, schema), "list-entries")
    group = ["label", "width", "cell"]
    members, visitors = F.count_if("member"), F.count_if(~F.col("member"))
    blocks = entered.groupBy(*group).agg(
        F.ceil(members / BLOCK).cast("int").alias("blocks"), F.ceil(visitors / VISITORS).cast("int").alias("visits"), F.count("*").alias("rows")
    )
    cut = entered.join(blocks.where("blocks > 0 AND rows > 1").drop("rows"), group)
    # blocks of visitors have negative numbers and meet blocks of members only
    dealt = lambda n: F.pmod(F.xxhash64("entry"), F.greatest(F.lit(1), F.col(n))).cast("int")
    cut = cut.withColumn("own", F.when(F.col("member"), dealt("blocks")).otherwise(-1 - dealt("visits")))
    cut = cut.withColumn("turn", F.explode(F.sequence(F.when(F.col("member"), -F.col("visits")).otherwise(0), F.col("blocks") - 1)))
    cut = cut.withColumns({"i": F.greatest("own", "turn"), "j": F.least("own", "turn")})
    step = F.xxhash64(*group, "i", "j")  # rows of one step have one hash; steps that share a hash are told apart by `group`
    cut = cut.select(*group, "i", "j", "own", "entry", "many", "embedding").withColumn("step", step)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            ends = _bounds(held)
            if len(ends) > 2:
                yield _linked(held, ends[:-1], shared.value, least, reach)
                held = held.slice(ends[-2])
        if held is not None:
            yield _linked(held, _bounds(held), shared.value, least, reach)

    order = ["step", *group, "i", "j"]
    links = cut.repartition("step").sortWithinPartitions(*order).mapInArrow(compare, "entry bigint, links bigint, root bigint")
    links = stage(links, "vector-links")
    counts = links.groupBy("entry").agg(F.sum("links").alias("links"))
    names = connected_components(links.select("entry", "root"))
    done = entries.join(counts, "entry", "left").join(names.withColumnRenamed("node", "entry"), "entry", "left").select(
        "label", "embedding",
        (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
        F.coalesce("component", "entry").alias("component"),
    )
    done = stage(done, "entry-components")
    found = valid.select("vec_id", "label", "embedding").join(done, ["label", "embedding"]).select("vec_id", "n_links", "component")
    alone = rows.where("not linked").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component"))
    return found.unionByName(alone).select(
        "vec_id", "n_links", F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def _bounds(table: pa.Table) -> np.ndarray:
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for c in ("label", "width", "cell", "i", "j"):
        codes = table[c].combine_chunks().dictionary_encode().indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(new), n)


def _linked(table: pa.Table, ends: np.ndarray, indexes: dict[int, ProductIndex], least: float, reach: float) -> pa.RecordBatch:
    """For each entry of each step: links found there (equal vectors counted each) and the smallest entry they reach."""
    width, cell, i, j, own, entry, many = (table[c].to_numpy() for c in ("width", "cell", "i", "j", "own", "entry", "many"))
    vectors = table["embedding"].combine_chunks()
    out_entry, out_links, out_root = [], [], []
    for a, b in zip(ends[:-1], ends[1:]):
        x = _matrix(vectors.slice(a, b - a))
        norm = np.linalg.norm(x, axis=1)
        unit = x / norm[:, None]
        index = indexes.get(int(width[a]))
        one = np.flatnonzero(own[a:b] == i[a])
        two = np.flatnonzero(own[a:b] == j[a])
        ids = entry[a:b]
        total = np.zeros(b - a, np.int64)
        near: list[tuple[np.ndarray, np.ndarray]] = []
        if index is not None:
            centre = index.centres[cell[a]]
            rest = unit[two] - centre
            codes = np.empty((len(two), len(index.codewords)), np.uint8)
            for s, words in enumerate(index.codewords):
                part = slice(index.bounds[s], index.bounds[s + 1])
                codes[:, s] = _nearest(rest[:, part], words)
                rest[:, part] -= words[codes[:, s]]
            error = np.sqrt((rest**2).sum(axis=1))
        for at in range(0, len(one), 128):
            rows = one[at : at + 128]
            open_ = ids[rows][:, None] < ids[two][None] if i[a] == j[a] else np.ones((len(rows), len(two)), bool)
            if index is not None:
                seen = unit[rows] - centre
                far = np.zeros((len(rows), len(two)))
                for s, words in enumerate(index.codewords):
                    part = slice(index.bounds[s], index.bounds[s + 1])
                    far += ((seen[:, None, part] - words[None]) ** 2).sum(axis=2)[:, codes[:, s]]
                open_ &= far <= (reach + error[None] + 1e-9) ** 2
            if open_.any():
                cosine = (x[rows] @ x[two].T) / (norm[rows][:, None] * norm[two][None])
                p, q = np.nonzero(open_ & (cosine >= least))
                near.append((rows[p], two[q]))
        if near:
            p, q = np.concatenate([n[0] for n in near]), np.concatenate([n[1] for n in near])
            np.add.at(total, p, many[a:b][q])
            np.add.at(total, q, many[a:b][p])
            root = ids.copy()
            while True:
                low = np.minimum(root[p], root[q])
                before = root.copy()
                np.minimum.at(root, p, low)
                np.minimum.at(root, q, low)
                if (root == before).all():
                    break
            hit = np.flatnonzero(total)
            out_entry.append(ids[hit])
            out_links.append(total[hit])
            out_root.append(root[hit])
    cat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([cat(out_entry), cat(out_links), cat(out_root)], names=["entry", "links", "root"])
