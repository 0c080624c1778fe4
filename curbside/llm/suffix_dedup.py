"""Repeated passages: suffixes sorted by a difference cover, neighbours compared, repeated bytes removed.

Two strings of `length` bytes that are equal have the same smallest k-gram (by a hash) at the same place.
That k-gram is their anchor, so equal strings lie in the surroundings of equal anchors. Only surroundings whose
anchor occurs twice or more are sorted, those of equal anchors together, equal surroundings once.

Passages counted in words are found by the same anchors, over hashes of words in place of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from curbside.llm.bitmap import BITS, bitmap, passes, place
from curbside.llm.text import slices
from curbside.sources.staging import stage

GRAM = 64
#: Words of a k-gram of words.
WORD_GRAM = 12
#: Bytes that part words: ASCII white space.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes whose powers are at hand when words are hashed; longer texts go through in blocks of that many.
BLOCK = 1 << 15
#: Bytes of surroundings of one anchor that are sorted in one step. Anchors with more of them are compared by window.
SORTED = 1 << 20
#: Bytes from which surroundings of several anchors are not put together any more (fits the processor's cache).
STEP = 1 << 17
#: Low bits of a composite that hold a place; texts are worked through in runs of fewer bytes than that.
PLACES = 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(data: np.ndarray, length: int, factor: int) -> np.ndarray:
    """Polynomial hashes of the `length` bytes from each place (those at the end take in what is there)."""
    power, known = factor, data.astype(np.uint64) + np.uint64(1)
    out, done = np.zeros(len(data), np.uint64), 0
    left, width = length, 1
    while left:
        if left & 1:
            out[: len(data) - done] = out[: len(data) - done] * np.uint64(power) + known[done:]
            done += width
        left >>= 1
        if left:
            known[:-width] = known[:-width] * np.uint64(power) + known[width:]
            power, width = power * power % (1 << 64), width * 2
    return out


def anchors(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a window of `length` symbols in `data`: where its anchor is, and the hashes of all k-grams."""
    grams = _mix(_rolling(data, gram, 0x9E3779B97F4A7C15))
    width, starts = length - gram + 1, len(data) - length + 1
    low = np.uint64((1 << PLACES) - 1)
    value = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(value) // width)
    grid = np.full(blocks * width, np.uint64(2**64 - 1))
    grid[: len(value)] = value
    grid = grid.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:starts], before[width - 1 : width - 1 + starts])
    return (least & low).astype(np.int64), grams


def _anchor_runs(data: np.ndarray, size: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The runs of windows with one anchor in texts of `size` symbols, laid into `data`: for each run the place of its
    anchor, its first and last window, the hash, the text it is in."""
    first, many = np.cumsum(size) - size, np.maximum(size - length + 1, 0)
    place_, grams = anchors(data, length, gram)
    text = np.repeat(np.arange(len(size)), many)
    start = np.arange(len(text)) + np.repeat(first - np.cumsum(many) + many, many)
    at = place_[start]
    head = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    tail = np.append(head[1:], len(at)) - 1
    return at[head], start[head], start[tail], grams[at[head]], text[head]


def _runs(part: pa.RecordBatch, length: int) -> Iterator[tuple]:
    """Pieces of texts, and the runs of windows with one anchor: the row and the offset of each text laid into
    `data`, then for each run the place of its anchor, its first and last window, the hash, the text it is in."""
    texts = pc.fill_null(part.column("text"), "").cast(pa.binary())
    most = max(1 << 16, 2 * length) - length  # fits the processor's cache
    room: list[tuple[int, int, bytes]] = []

    def work() -> tuple:
        data = np.frombuffer(b"".join(x for _, _, x in room), np.uint8)
        size = np.array([len(x) for _, _, x in room], np.int64)
        return list(room), np.cumsum(size) - size, data, *_anchor_runs(data, size, length, GRAM)

    held = 0
    for row in range(part.num_rows):
        whole = texts[row].as_py()
        for cut in range(0, len(whole) - length + 1, most):
            piece = whole[cut : cut + most + length - 1]
            if held and held + len(piece) > most:
                yield work()
                room, held = [], 0
            room.append((row, cut, piece))
            held += len(piece)
    if room:
        yield work()


@cache
def _powers(factor: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number that a block takes, and of its inverse (modulo 2**64)."""
    return tuple(
        np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(BLOCK - 1, x, np.uint64)))) for x in (factor, pow(factor, -1, 1 << 64))
    )


def _sums(data: np.ndarray, places: np.ndarray, factor: int) -> np.ndarray:
    """For each of the ascending `places`: the sum of the bytes before it, each times the power of its own place."""
    out, total = np.zeros(len(places), np.uint64), 0
    cuts = np.searchsorted(places, np.arange(0, len(data) + BLOCK, BLOCK), side="right")
    for low, high, at in zip(cuts[:-1], cuts[1:], range(0, len(data), BLOCK)):
        step = pow(factor, at, 1 << 64)
        part = data[at : at + BLOCK].astype(np.uint64)
        part += np.uint64(1)
        part *= _powers(factor)[0][: len(part)]
        np.cumsum(part, out=part)
        out[low:high] = part[places[low:high] - at - 1] * np.uint64(step) + np.uint64(total)
        total = (total + int(part[-1]) * step) % (1 << 64)
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets into the words of all texts, and a hash of each word. Null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))
    first[offsets[full]] = inside[offsets[full]]  # words end with their text
    last[offsets[full + 1] - 1] = inside[offsets[full + 1] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    factor = 0x9E3779B97F4A7C15
    inverse = pow(factor, -1, 1 << 64)
    blocks = np.array([pow(inverse, at, 1 << 64) for at in range(0, len(data), BLOCK)], np.uint64)
    back = _powers(factor)[1][starts % BLOCK] * blocks[starts // BLOCK]
    # the places of both, in order: a word begins at or behind the end of the one before
    sums = _sums(data, np.column_stack((starts, ends)).ravel(), factor)
    return np.searchsorted(starts, offsets), _mix((sums[1::2] - sums[::2]) * back)


def _word_runs(part: pa.RecordBatch, words: int) -> Iterator[tuple]:
    """The same over words (between ASCII white space): the row of each text laid into `data`, the hashes of its words,
    and the runs of windows of `words` words with one anchor."""
    offsets, hashed = word_hashes(part.column("text"))
    most = max(1 << 14, 2 * words) - words
    room: list[tuple[int, int, int]] = []

    def work() -> tuple:
        data = np.concatenate([hashed[a:b] for _, a, b in room])
        return [row for row, _, _ in room], data, *_anchor_runs(data, np.array([b - a for _, a, b in room], np.int64), words, WORD_GRAM)

    held = 0
    for row in np.flatnonzero(np.diff(offsets) >= words):
        begin, end = int(offsets[row]), int(offsets[row + 1])
        for cut in range(begin, end - words + 1, most):
            piece = (int(row), cut, min(end, cut + most + words - 1))
            if held and held + piece[2] - cut > most:
                yield work()
                room, held = [], 0
            room.append(piece)
            held += piece[2] - cut
    if room:
        yield work()


def difference_cover_order(text: np.ndarray, need: int) -> np.ndarray:
    """Rank of each suffix of `text` (integers > 0) by its first `need` symbols or more; equal ranks are not told apart.

    The suffixes at places 1 and 2 modulo 3 are sorted by their first three symbols; where that leaves ties,
    the names of these triples, written as a text of their own, are ranked the same way. The others are then
    merged in: each is compared by its first symbol, or first two, and the rank of the suffix behind them.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(5, text.dtype)))
    if need <= 1 or n < 4:
        return _ranks(*[padded[i : i + n] for i in range(max(1, min(need, 4)))])
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    names = _ranks(padded[sample], padded[sample + 1], padded[sample + 2])
    if need > 3 and len(sample) and names.max() < len(sample) - 1:
        # the two halves are texts of their own, so a closing symbol parts them
        deeper = difference_cover_order(np.concatenate((names[: len(one)] + 2, [1], names[len(one) :] + 2)), -(-need // 3))
        names = np.concatenate((deeper[: len(one)], deeper[len(one) + 1 :]))
    rank = np.zeros(n + 5, np.int64)
    rank[sample] = names + 1
    zero = np.arange(0, n, 3)
    # places 0 and 1 by (symbol, rank behind it); places 0 and 2 by (two symbols, rank behind them)
    with_one, with_two = np.concatenate((zero, one)), np.concatenate((zero, two))
    rank_one = _ranks(padded[with_one], rank[with_one + 1])
    rank_two = _ranks(padded[with_two], padded[with_two + 1], rank[with_two + 2])
    z = len(zero)
    # how many of places 1 and 2 come before each suffix of place 0, and the other way round; equal ones share a place
    ones, twos, names_below = _below(rank_one[z:]), _below(rank_two[z:]), _below(names)
    zeros_one, zeros_two = _below(rank_one[:z]), _below(rank_two[:z])
    low_zero = ones(rank_one[:z]) + twos(rank_two[:z])
    low_sample = names_below(names)
    before_one, before_two, before_zero = zeros_one(rank_one[z:]), zeros_two(rank_two[z:]), zeros_one(rank_one[:z])
    out = np.empty(n, np.int64)
    out[zero] = low_zero + before_zero
    out[one] = low_sample[: len(one)] + before_one
    out[two] = low_sample[len(one) :] + before_two
    return out


def _below(ranks: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """For given ranks, how many of `ranks` are smaller."""
    counted = np.concatenate(([0], np.cumsum(np.bincount(ranks)))) if len(ranks) else np.zeros(1, np.int64)
    return lambda x: counted[np.minimum(x, len(counted) - 1)]


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows given by columns of integers from 0 on; columns are packed into one while they fit."""
    packed, width = keys[0], int(keys[0].max(initial=0)) + 1
    for key in keys[1:]:
        size = int(key.max(initial=0)) + 1
        if width * size >= 1 << 63:
            packed = _dense(packed)
            width = int(packed.max(initial=0)) + 1
        packed, width = packed * size + key, width * size
    return _dense(packed)


def _dense(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    moved = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.append(False, moved[1:] != moved[:-1])[: len(order)])
    return out


def repeated_windows(contexts: list[bytes], windows: np.ndarray, times: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context the starts, out of its first `windows`, of strings of `length` bytes that occur elsewhere too.

    The contexts are one text, parted by symbols that differ; its suffixes are sorted, and neighbours are compared.
    times: how often each context occurs; all of its windows are repeated if that is more than once.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    first = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int(sizes.sum()) + len(contexts), np.int64)
    inside = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(contexts)), sizes)
    text[inside] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + len(contexts) + 1
    text[first + sizes] = np.arange(1, len(contexts) + 1)
    rank = difference_cover_order(text, length)
    start = np.arange(int(windows.sum())) + np.repeat(first - (np.cumsum(windows) - windows), windows)
    order = start[np.argsort(rank[start], kind="stable")]
    # neighbours whose first `length` symbols agree: compared by hashes of the strings
    one, two = _rolling_ints(text, length, 0x9E3779B97F4A7C15), _rolling_ints(text, length, 0xC2B2AE3D27D4EB4F)
    same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    hit = np.zeros(len(text), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    out = []
    for at, many, twice in zip(first, windows, times):
        out.append(np.arange(many) if twice > 1 else np.flatnonzero(hit[at : at + many]))
    return out


def _rolling_ints(text: np.ndarray, length: int, factor: int) -> np.ndarray:
    return _rolling(text, length, factor)


def _spans(starts: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """The bytes that windows cover, as runs."""
    if not len(starts):
        return [], []
    gap = np.flatnonzero(np.diff(starts) > length)
    return starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + length).tolist()


def _surroundings(texts: DataFrame, length: int, words: int) -> DataFrame:
    """The surroundings of anchors that occur twice or more, of strings of `length` bytes and, if `words` is not 0, of
    that many words (`by_word`: `windows` holds the hash of each string, `run` one of them all, and `row` tells the rows
    of `texts` apart)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                found = [run[-2] for run in _runs(part, length)]
                if words:
                    found += [run[-2] for run in _word_runs(part, words)]
                for keys in found:
                    key, n = np.unique(keys.view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    keys = texts.select("text").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    keys = stage(keys.where("n > 1").select("key"), "repeated-anchors")
    known = bitmap(keys, "key")
    schema = "doc_id bigint, text_hash bigint, row bigint, by_word boolean, begin bigint, key bigint, name binary, context binary, run bigint, windows array<bigint>"
    columns = [x.split()[0] for x in schema.split(", ")]

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                same = [part.column(c) for c in ("doc_id", "text_hash", "row")]
                for room, offset, data, at, low, high, key, text in _runs(part, length):
                    good = np.flatnonzero(passes(known.value, _place(key)))
                    raw = data.tobytes()
                    rows = pa.array([room[text[i]][0] for i in good], pa.int64())
                    context = [raw[low[i] : high[i] + length] for i in good]
                    name = [hashlib.blake2b(c, digest_size=16, key=int(at[i] - low[i]).to_bytes(8, "little", signed=True)).digest() for c, i in zip(context, good)]
                    begin = [int(low[i] - offset[text[i]]) + room[text[i]][1] for i in good]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[c.take(rows) for c in same], pa.array(np.zeros(len(good), bool)), pa.array(begin, pa.int64()),
                            pa.array(key[good].view(np.int64)), pa.array(name, pa.binary()), pa.array(context, pa.binary()),
                            pa.nulls(len(good), pa.int64()), pa.nulls(len(good), pa.list_(pa.int64())),
                        ],
                        names=columns,
                    )
                for room, data, at, low, high, key, text in _word_runs(part, words) if words else ():
                    good = np.flatnonzero(passes(known.value, _place(key)))
                    if not len(good):
                        continue
                    many = high[good] - low[good] + 1
                    first = np.cumsum(many) - many
                    turn = np.arange(many.sum()) - np.repeat(first, many)
                    hashes = _rolling(data, words, 0xC2B2AE3D27D4EB4F)[turn + np.repeat(low[good], many)]
                    run = np.add.reduceat(_mix(hashes) * (_mix(turn.astype(np.uint64) + np.uint64(1)) | np.uint64(1)), first)
                    rows = pa.array(np.array(room, np.int64)[text[good]])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[c.take(rows) for c in same], pa.array(np.ones(len(good), bool)), pa.nulls(len(good), pa.int64()),
                            pa.array(key[good].view(np.int64)), pa.nulls(len(good), pa.binary()), pa.nulls(len(good), pa.binary()),
                            pa.array(run.view(np.int64)),
                            pa.ListArray.from_arrays(np.append(first, len(hashes)).astype(np.int32), pa.array(hashes.view(np.int64))),
                        ],
                        names=columns,
                    )

    return stage(texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(surround, schema), "surroundings")


def _shared_places(found: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shared: the places of each text where a string of words starts that another row has too."""
    found = found.where("by_word")
    once = found.groupBy("key", "run").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.max("windows").alias("windows"))
    once = stage(once, "distinct-passages")
    # surroundings that two rows have are shared as a whole; those of one row are compared with all of their anchor
    groups = once.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or(F.expr("lo = hi")).alias("open"))
    groups = stage(groups.where("lo < hi and open").select("key"), "passage-groups")
    windows = once.join(groups, "key", "left_semi").select("key", "run", "lo", "hi", F.explode("windows").alias("window"))
    again = windows.groupBy("key", "window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    again = stage(again.select("key", "window"), "shared-windows")
    single = windows.where("lo = hi").join(again, ["key", "window"], "left_semi").groupBy("key", "run").agg(F.count("*").alias("n"))
    whole = once.where("lo < hi").select("key", "run", F.size("windows").cast("bigint").alias("n"))
    marked = stage(whole.unionByName(single), "marked-passages")
    rows = found.select("doc_id", "text_hash", "row", "key", "run").join(marked, ["key", "run"])
    return rows.groupBy("doc_id", "text_hash", "row").agg(F.sum("n").alias("n_shared")).drop("row")


def repeated_spans(docs: DataFrame, length: int = 400, words: int = 0) -> DataFrame:
    """doc_id, text_hash, runs: the runs of bytes of each text that repeated strings of `length` bytes cover.

    `docs` has doc_id and text; rows without such bytes are left out. A string is repeated if it also starts
    anywhere else, in the same text or another row's, overlapping or not; strings do not cross texts.
    n_shared, if `words` is not 0: the places where a string of that many words starts that another row has too;
    rows with such places are there too.
    """
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    everything = _surroundings(texts, length, words)
    found = everything.where("not by_word").select("doc_id", "text_hash", "begin", "key", "name", "context")
    once = found.groupBy("key", "name").agg(F.count("*").alias("times"), F.max("context").alias("context"))
    once = stage(once, "distinct-surroundings")
    size = once.groupBy("key").agg(F.sum(F.length("context")).alias("bytes"), F.sum("times").alias("n"), F.count("*").alias("kinds"))
    size = stage(size.where("n > 1").select("key", "bytes", "kinds"), "anchor-groups")
    once = once.join(size, "key")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0

        def done(table: pa.Table) -> pa.RecordBatch:
            contexts = table["context"].to_pylist()
            windows = np.fromiter(map(len, contexts), np.int64, len(contexts)) - length + 1
            spans = [_spans(x, length) for x in repeated_windows(contexts, windows, table["times"].to_numpy(), length)]
            return pa.RecordBatch.from_arrays(
                [
                    table["key"].combine_chunks(), table["name"].combine_chunks(),
                    pa.array([a for a, _ in spans], pa.list_(pa.int64())), pa.array([b for _, b in spans], pa.list_(pa.int64())),
                ],
                names=["key", "name", "starts", "ends"],
            )

        for batch in batches:
            for part in slices(batch, "context", STEP):
                held.append(part)
                waiting += part.column("context").nbytes
                if waiting >= STEP:  # up to the last change of anchor
                    table = pa.Table.from_batches(held)
                    change = np.flatnonzero(np.diff(table["key"].to_numpy()))
                    if len(change):
                        yield done(table.slice(0, change[-1] + 1))
                        held = table.slice(change[-1] + 1).to_batches()
                        waiting = sum(x.column("context").nbytes for x in held)
        if held:
            yield done(pa.Table.from_batches(held))

    schema = "key bigint, name binary, starts array<bigint>, ends array<bigint>"
    usual = once.where((F.col("bytes") <= SORTED) & (F.col("kinds") > 1)).select("key", "name", "times", "context")
    marked = usual.repartition("key").sortWithinPartitions("key").mapInArrow(sort, schema)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "context", 1 << 18):
                for key, name, context in zip(*(part.column(c).to_pylist() for c in ("key", "name", "context"))):
                    data = np.frombuffer(context, np.uint8)
                    n = len(data) - length + 1
                    one, two = _rolling(data, length, 0x9E3779B97F4A7C15)[:n], _rolling(data, length, 0xC2B2AE3D27D4EB4F)[:n]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([key] * n, pa.int64()), pa.array([name] * n, pa.binary()), pa.array(np.arange(n))],
                        names=["one", "two", "key", "name", "at"],
                    )

    # copies of one surrounding: all of it is repeated
    whole = once.where("kinds = 1").select(
        "key", "name", F.array(F.lit(0).cast("bigint")).alias("starts"), F.array(F.length("context").cast("bigint")).alias("ends")
    )
    hot = once.where((F.col("bytes") > SORTED) & (F.col("kinds") > 1))
    windows = hot.select("key", "name", "context").mapInArrow(explode, "one bigint, two bigint, key bigint, name binary, at bigint")
    again = stage(windows.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated-windows")
    single = windows.join(again, ["one", "two"]).groupBy("key", "name").agg(F.sort_array(F.collect_list("at")).alias("starts"))
    every = F.when(F.col("times") > 1, F.array(F.lit(0).cast("bigint")))
    hot = hot.join(single, ["key", "name"], "left").select(
        "key", "name",
        F.coalesce(every, "starts", F.array().cast("array<bigint>")).alias("starts"),
        F.when(F.col("times") > 1, F.array(F.length("context").cast("bigint"))).otherwise(
            F.transform(F.coalesce("starts", F.array().cast("array<bigint>")), lambda s: s + length)
        ).alias("ends"),
    )
    marked = stage(marked.unionByName(hot).unionByName(whole).where("size(starts) > 0"), "marked-surroundings")
    placed = found.select("doc_id", "text_hash", "begin", "key", "name").join(marked, ["key", "name"])
    runs = placed.select(
        "doc_id", "text_hash",
        F.explode(F.arrays_zip(F.transform("starts", lambda s: s + F.col("begin")).alias("s"), F.transform("ends", lambda e: e + F.col("begin")).alias("e"))).alias("run"),
    )
    if words:
        runs = runs.unionByName(_shared_places(everything), allowMissingColumns=True)
    counts = [F.coalesce(F.max("n_shared"), F.lit(0).cast("bigint")).alias("n_shared")] if words else []
    listed = runs.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("run")).alias("runs"), *counts)
    return stage(listed, "repeated-spans")


def _place(keys: np.ndarray) -> np.ndarray:
    """`bitmap.place` of long keys, as Spark's xxhash64 gives it (seed 42)."""
    one, two, three, four, five = (
        np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
    )

    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return x << np.uint64(n) | x >> np.uint64(64 - n)

    out = turn(keys.view(np.uint64) * two, 31) * one ^ (five + np.uint64(42 + 8))
    out = turn(out, 27) * one + four
    out = (out ^ out >> np.uint64(33)) * two
    out = (out ^ out >> np.uint64(29)) * three
    return ((out ^ out >> np.uint64(32)) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def remove_repeats(docs: DataFrame, length: int = 400, words: int = 0) -> DataFrame:
    """For each row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay).

    Each byte of a text in UTF-8 goes that a string of `length` bytes covers which also starts anywhere else.
    Null and empty texts have no bytes. Rows stay one for one; repeated rows repeat each other, so they lose all
    that is covered. Other columns of `docs` are not read.
    n_shared, if `words` is not 0: the places where a string of that many words starts that another row has too,
    however few bytes it has; nothing is removed for it.
    """
    spans = repeated_spans(docs, length, words)
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    known = bitmap(spans, "doc_id", "text_hash")

    def untouched(batches: Iterator[pa.RecordBatch], want: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = passes(known.value, batch.column("place").to_numpy())
            yield batch.drop_columns(["place"]).filter(pa.array(hit == want))

    schema = "doc_id bigint, text string, text_hash bigint"
    placed = texts.withColumn("place", place("doc_id", "text_hash"))
    plain = placed.mapInArrow(lambda x: untouched(x, False), schema)
    touched = placed.mapInArrow(lambda x: untouched(x, True), schema)
    joined = touched.alias("t").join(
        spans.alias("s"), F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.text_hash") == F.col("s.text_hash")), "left"
    ).select("t.doc_id", "t.text", "s.runs", *([F.coalesce("s.n_shared", F.lit(0).cast("bigint")).alias("n_shared")] if words else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs"))):
                data = (text or "").encode()
                kept, at, removed, many = [], 0, 0, 0
                last = -1
                for run in runs or []:
                    start, end = run["s"], run["e"]
                    if start > last:
                        many += 1
                    if end > at:
                        kept.append(data[at : max(at, start)])
                        removed += end - max(at, start)
                        at = end
                    last = max(last, end)
                rows.append((doc_id, len(data), removed, many, b"".join([*kept, data[at:]])))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            out = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            if words:
                out, names = [*out, batch.column("n_shared")], [*names, "n_shared"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    shared = ", n_shared bigint" if words else ""
    changed = joined.mapInArrow(cut, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary{shared}")
    whole = F.coalesce("text", F.lit("")).cast("binary")
    zero = F.lit(0).cast("bigint")
    same = plain.select(
        "doc_id", F.length(whole).cast("bigint").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), whole.alias("kept"),
        *([zero.alias("n_shared")] if words else []),
    )
    return changed.unionByName(same)
