"""Near-duplicate documents: b-bit MinHash signatures, bands for candidates, full shingle sets to confirm."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from curbside.llm.bitmap import bitmap, passes, place
from curbside.llm.components import connected_components
from curbside.llm.text import distinct, slices, split_words
from curbside.sources.staging import stage

#: 32 bands of 5 minima: at a similarity of 0.8 a pair has no common band with a probability of 3e-6.
BANDS, ROWS = 32, 5
PERMUTATIONS = BANDS * ROWS
#: Bits kept of each minimum.
BITS = 4
LONGS = PERMUTATIONS * BITS // 64
#: A candidate is compared in full unless its estimate lies this many standard errors below the threshold.
ERRORS = 4.5
#: Members of a band that are compared in one step: so many, with so many shingles together.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_DRAW = np.random.default_rng(20240607)
_FACTORS = _DRAW.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _DRAW.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and the sorted distinct 64-bit fingerprints of each text's shingles.

    A-Z is lower-cased; words are runs of characters other than ASCII white space. A text with fewer words
    than a shingle has its whole sequence as one; a text without words has none.
    """
    offsets, found = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    codes, known = distinct(found)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))[codes]
    many = np.diff(offsets)
    count = np.where(many >= words, many - words + 1, np.minimum(many, 1))
    ends = np.concatenate(([0], np.cumsum(count)))
    first = np.arange(ends[-1]) - np.repeat(ends[:-1], count) + np.repeat(offsets[:-1], count)
    size = np.repeat(np.minimum(many, words), count)
    out = size.astype(np.uint64)
    for k in range(words):
        inside = k < size
        out = np.where(inside, _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashed[np.where(inside, first + k, 0)]), out) if len(hashed) else out
    kept, sizes = [], []
    for a, b in zip(ends[:-1], ends[1:]):
        own = np.sort(out[a:b])
        own = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
        kept.append(own)
        sizes.append(len(own))
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int64), np.concatenate(kept) if kept else out


def minima(offsets: np.ndarray, sets: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """The minima (rows x permutations) of non-empty sets, a cache-sized block of rows at a time."""
    rows = len(offsets) - 1
    out = np.empty((PERMUTATIONS, rows), np.uint64)
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1)
        own, begin = sets[offsets[at] : offsets[to]], offsets[at:to] - offsets[at]
        buffer = np.empty_like(own)
        for p in range(PERMUTATIONS):
            np.multiply(own, _FACTORS[p], out=buffer)
            np.add(buffer, _SHIFTS[p], out=buffer)
            out[p, at:to] = np.minimum.reduceat(buffer, begin)
        at = to
    return out.T


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


SIGNATURE = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, packed array<bigint>"


def set_digests(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each set, in two halves; 0 for an empty one."""
    many = np.diff(offsets)
    full = np.flatnonzero(many)
    begin = offsets[:-1][full]
    a, b = np.zeros(len(many), np.uint64), np.zeros(len(many), np.uint64)
    if len(full):
        a[full] = _mix(np.add.reduceat(_mix(sets), begin) + many[full].astype(np.uint64))
        b[full] = _mix(np.add.reduceat(_mix(sets ^ np.uint64(0xD6E8FEB86659FD93)), begin))
    return a, b


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """For each row of `docs` (doc_id, text): the size and a 128-bit digest of its shingle set, a key for each
    band of minima, and the lowest bits of all minima packed into longs (empty arrays for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                offsets, sets = shingle_sets(part.column("text"), words)
                many = np.diff(offsets)
                full = np.flatnonzero(many)
                own = np.concatenate(([0], np.cumsum(many[full])))
                mins = minima(own, sets)
                set_a, set_b = set_digests(sets, offsets)
                key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                key = np.repeat(key, len(full), axis=0)
                for r in range(ROWS):
                    key = _mix(key + mins[:, r::ROWS])
                low = (mins & np.uint64((1 << BITS) - 1)).reshape(len(full), LONGS, 64 // BITS)
                packed = np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)
                lists = []
                for values, width in ((key, BANDS), (packed, LONGS)):
                    ends = np.concatenate(([0], np.cumsum(np.where(many > 0, width, 0))))
                    lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(values).ravel())))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(many, pa.int64()), pa.array(_signed(set_a)), pa.array(_signed(set_b)), *lists],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "packed"],
                )

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(sign, SIGNATURE)


def estimated_similarity(one: Column, other: Column) -> Column:
    """Similarity from two packed signatures: the share of equal b-bit values, less those equal by chance."""
    ones = F.lit(0x1111111111111111)  # the lowest bit of each of the 4-bit values in a long
    differ = F.lit(0)
    for i in range(LONGS):
        x = F.get(one, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(ones))
    chance = 2.0**-BITS
    return ((1 - differ / F.lit(float(PERMUTATIONS))) - chance) / (1 - chance)


def _first_shared(one: Column, other: Column) -> Column:
    """The key of the first band in which two lists of band keys agree."""
    return F.get(F.array_compact(F.zip_with(one, other, lambda x, y: F.when(x == y, x))), F.lit(0))


def _cutoff(least: Fraction) -> float:
    """Pairs with a lower estimate are taken to be below the threshold."""
    threshold, chance = float(least), 2.0**-BITS
    equal = threshold + (1 - threshold) * chance
    return threshold - ERRORS * (equal * (1 - equal) / PERMUTATIONS) ** 0.5 / (1 - chance)


def _full_sets(wanted: DataFrame, heads: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node and shingles (the sorted set, 8 bytes each) of the nodes `wanted`, made again from the text of one of their
    documents (`heads`: node, doc_id, set_a, set_b), so that sets of all documents are never stored and texts are not
    shuffled. Where a doc_id has several texts, the digest tells which one it is."""
    asked = stage(wanted.select("node").distinct().join(heads, "node"), "wanted-sets")
    known = bitmap(asked, "doc_id")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(known.value, batch.column("place").to_numpy())))
            for part in slices(batch, most=4 << 20):
                offsets, sets = shingle_sets(part.column("text"), words)
                raw, digests = sets.tobytes(), set_digests(sets, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), *[pa.array(_signed(x)) for x in digests],
                        pa.array([raw[8 * a : 8 * b] for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
                    ],
                    names=["doc_id", "set_a", "set_b", "shingles"],
                )

    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    sets = texts.withColumn("place", place("doc_id")).mapInArrow(collect, "doc_id bigint, set_a bigint, set_b bigint, shingles binary")
    mine = sets.join(asked, ["doc_id", "set_a", "set_b"])
    return stage(mine.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets")


def _similar(x: np.ndarray, y: np.ndarray, least: Fraction) -> bool:
    both = len(x) + len(y)
    union = len(np.union1d(x, y))
    return (both - union) * least.denominator >= union * least.numerator


def _confirmed(pairs: DataFrame, packed: DataFrame, heads: DataFrame, docs: DataFrame, words: int, least: Fraction) -> DataFrame:
    """Those of `pairs` (a, b; each once) whose full sets are similar enough. packed: node, packed."""
    one = packed.select(F.col("node").alias("a"), F.col("packed").alias("pa"))
    other = packed.select(F.col("node").alias("b"), F.col("packed").alias("pb"))
    near = pairs.join(one, "a").join(other, "b").where(estimated_similarity(F.col("pa"), F.col("pb")) >= _cutoff(least))
    near = stage(near.select("a", "b"), "near-pairs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                _similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least)
                for x, y in zip(batch.column("one"), batch.column("other"))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    sets = _full_sets(near.select(F.explode(F.array("a", "b")).alias("node")), heads, docs, words)
    full = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a")
    full = full.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("other")), "b")
    return stage(full.select("a", "b", "one", "other").mapInArrow(compare, "a bigint, b bigint"), "links")


def _joining(members: DataFrame, heads: DataFrame, docs: DataFrame, words: int, least: Fraction) -> DataFrame:
    """Links (a, b) between nodes that share a band and lie in different components, enough to join all
    components that such links join. members: key, node, n, component, bands, packed.

    A pair that shares several bands is compared in the first of them. A member goes on only if some other
    in its band may be similar enough and shares no earlier band with it; it is looked for block by block of the band, so
    a band with many members is many keys. What goes on is compared in blocks of a band, inside tasks: no pair leaves
    a task unless it is a link that joins two components there.
    """
    cuts = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts"))
    cut = members.join(stage(cuts, "band-cuts"), "key")
    a = cut.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).alias("a")
    b = cut.withColumn("turn", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")).alias("b")
    n_a, n_b = F.col("a.n"), F.col("b.n")
    partner = (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.turn") == F.col("b.turn"))
        & (F.col("a.component") != F.col("b.component"))
        & (F.least(n_a, n_b) * least.denominator >= F.greatest(n_a, n_b) * least.numerator)
        & (estimated_similarity(F.col("a.packed"), F.col("b.packed")) >= _cutoff(least))
        & (_first_shared(F.col("a.bands"), F.col("b.bands")) == F.col("a.key"))
    )
    near = a.join(b, partner, "left_semi").drop("turn", "cuts").dropDuplicates(["key", "node"])
    near = stage(near, "near-members")
    sets = _full_sets(near, heads, docs, words)
    blocks = near.groupBy("key").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    cut = near.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select(
        "key", F.least("own", "turn").alias("i"), F.greatest("own", "turn").alias("j"), "own", "node", "component", "bands", "packed"
    ).join(sets, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            bounds = _group_bounds(held)
            if len(bounds) > 2:  # the last group may go on in the next batch
                yield _group_links(held, bounds[:-1], least)
                held = held.slice(bounds[-2])
        if held is not None:
            yield _group_links(held, _group_bounds(held), least)

    sorted_groups = cut.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return stage(sorted_groups.mapInArrow(compare, "a bigint, b bigint"), "joining-links")


def _group_bounds(table: pa.Table) -> np.ndarray:
    parts = np.stack([table[c].to_numpy() for c in ("key", "i", "j")])
    return np.append(np.flatnonzero(np.append(True, (parts[:, 1:] != parts[:, :-1]).any(axis=0))[: table.num_rows]), table.num_rows)


def _group_links(table: pa.Table, bounds: np.ndarray, least: Fraction) -> pa.RecordBatch:
    """For each group of rows: links between members of different components, fewest that join them."""
    key, i, j, own, node, component = (table[c].to_numpy() for c in ("key", "i", "j", "own", "node", "component"))
    bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    packed = table["packed"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)
    raw = table["shingles"].combine_chunks()
    width = np.uint64(0x1111111111111111)
    cutoff, chance, out = _cutoff(least), 2.0**-BITS, []
    for start, end in zip(bounds[:-1], bounds[1:]):
        parent = {c: c for c in component[start:end].tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        sets: dict[int, np.ndarray] = {}
        place = np.arange(start, end)
        for x in place[own[start:end] == i[start]] if i[start] != j[start] else place:
            later = place[own[start:end] == j[start]] if i[start] != j[start] else place[place > x]
            later = later[component[later] != component[x]]
            same = bands[later] == bands[x]
            later = later[bands[later, same.argmax(axis=1)] == key[x]] if len(later) else later
            if not len(later):
                continue
            differ = packed[later] ^ packed[x]
            differ |= differ >> np.uint64(1)
            differ |= differ >> np.uint64(2)
            equal = 1 - np.bitwise_count(differ & width).sum(axis=1) / PERMUTATIONS
            for y in later[(equal - chance) / (1 - chance) >= cutoff]:
                p, q = root(int(component[x])), root(int(component[y]))
                if p == q:
                    continue
                for z in (x, y):
                    if z not in sets:
                        sets[z] = np.frombuffer(raw[int(z)].as_buffer(), np.uint64)
                if _similar(sets[x], sets[y], least):
                    parent[max(p, q)] = min(p, q)
                    out.append((int(node[x]), int(node[y])))
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"]
    )


def near_duplicates(docs: DataFrame, words: int = 5, similarity: str = "0.8") -> DataFrame:
    """For each row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their sets of distinct shingles of `words` words is at
    least `similarity` (an exact decimal); a component is all that links reach, named by its smallest doc_id.
    Empty and null texts have no shingles and are linked with nothing. Rows with the same doc_id are one document, which
    has the links of all its texts. A row without doc_id has a null component and is kept. Columns of `docs` other than
    doc_id and text are not read. An empty table gives no rows.

    Documents with equal sets are one node. Nodes that share a band are candidates: first each against the
    smallest and largest node of the band, then, where a band still holds different components, the nodes
    of different ones in blocks. No pair that shares a band and could join components is left out.
    """
    least = Fraction(similarity)
    signed = stage(signatures(docs, words), "signatures")
    keyed = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "set_a", "set_b")
    groups = keyed.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    # a set's number is fixed when the table is written; documents come in only by their sets
    groups = stage(groups.withColumn("node", F.monotonically_increasing_id()), "sets")
    heads = groups.select("node", "doc_id", "set_a", "set_b")
    nodes = stage(
        signed.join(heads, ["doc_id", "set_a", "set_b"])
        .groupBy("node").agg(F.max(F.struct("n_shingles", "bands", "packed")).alias("s"))
        .select("node", F.col("s.n_shingles").alias("n"), "s.bands", "s.packed"),
        "nodes",
    )
    packed = nodes.select("node", "packed")
    banded = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("rows"), F.min("node").alias("low"), F.max("node").alias("high"))
    shared = stage(shared.where("rows > 1").drop("rows"), "shared-bands")
    members = stage(banded.join(shared, "key"), "band-members")

    hubs = members.select("node", "n", F.explode(F.array("low", "high")).alias("hub")).where("node <> hub")
    first = hubs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    first = stage(first, "star-pairs")
    links = _confirmed(first, packed, heads, docs, words, least)
    found = connected_components(links)
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stage(placed.select("key", "node", "n", "component"), "placed-members")
    mixed = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    rest = placed.join(mixed.select("key"), "key", "left_semi").join(nodes.select("node", "bands", "packed"), "node")
    more = _joining(stage(rest, "mixed-members"), heads, docs, words, least)
    # the sets of rows with one doc_id are joined: they are one document
    digest = F.struct("set_a", "set_b")
    several = keyed.groupBy("doc_id").agg(F.min(digest).alias("x"), F.max(digest).alias("y")).where("x <> y").select("doc_id")
    versions = keyed.join(several, "doc_id", "left_semi").distinct()
    versions = stage(versions.join(groups.drop("doc_id"), ["set_a", "set_b", "n_shingles"]).select("doc_id", "node"), "versions")
    least_node = versions.groupBy("doc_id").agg(F.min("node").alias("a"))
    versions = versions.join(least_node, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    final = connected_components(links.union(more).union(versions))
    # by set, not by document, until the last join: a set may belong to many documents
    linked = groups.join(final, "node")
    names = stage(linked.groupBy("component").agg(F.min("doc_id").alias("name")), "component-names")
    linked = linked.join(names, "component").select("node", "name")
    named = groups.join(linked, "node", "left")
    named = named.select("set_a", "set_b", "n_shingles", F.coalesce("name", "doc_id").alias("component"))
    out = signed.join(stage(named, "set-components"), ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: str = "0.8") -> DataFrame:
    """The rows of `docs` that `near_duplicates` keeps, with all their columns."""
    dropped = near_duplicates(docs, words, similarity).where("not kept").select(F.col("doc_id").alias("_dropped_id")).distinct()
    return docs.join(dropped, docs["doc_id"].cast("bigint") == dropped["_dropped_id"], "left_anti")
