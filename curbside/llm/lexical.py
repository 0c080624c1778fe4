"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from curbside.llm.text import resident, slices, split_words
from curbside.sources.staging import stage

#: Postings of a block.
BLOCK = 128
#: A shard is closed when it has so many documents or so many bytes of text.
SHARD_DOCS, SHARD_BYTES = 8192, 16 << 20
#: Documents of a shard looked at between two looks at the threshold.
STEP = 1024
#: (item, term) pairs searched for in one pass over the index.
PASS_PAIRS = 200_000

INDEX = """shard bigint, term binary, df bigint, n_docs bigint, n_terms bigint,
    last_doc binary, most_tf binary, least_n binary, spot binary, widths binary, payload binary"""
FOUND = "item bigint, doc_id bigint, score bigint"

#: Letters and digits, and every byte of a character beyond ASCII, stay; A-Z turn to a-z; the rest parts terms.
_FOLD = np.array([c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower()], np.uint8)


def split_terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row offsets into the terms, and the terms, as bytes of UTF-8: maximal runs of ASCII letters and digits and of
    characters beyond ASCII, only A-Z in lower case. Null has none."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] if len(offsets) else 0 : offsets[-1] if len(offsets) else 0]
    folded = pa.Array.from_buffers(
        pa.string(), len(texts), [None, pa.py_buffer((offsets - offsets[:1]).astype(np.int32)), pa.py_buffer(_FOLD[data])]
    )
    at, terms = split_words(folded)
    return at, terms.cast(pa.binary())


def _widths(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many bytes (1, 2, 4) the largest value of each run needs."""
    most = np.maximum.reduceat(values, starts) if len(starts) else values
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.int64)


def _scatter(out: np.ndarray, at: np.ndarray, values: np.ndarray, widths: np.ndarray) -> None:
    """Each value as `widths` little-endian bytes from position `at`."""
    for b in range(4):
        deep = widths > b
        out[at[deep] + b] = values[deep] >> np.uint32(8 * b) & np.uint32(255)


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value for each run of `values`."""
    size = values.dtype.itemsize
    return pa.Array.from_buffers(
        pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    )


def _shard(number: int, parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> pa.RecordBatch:
    """The rows of a shard: its documents (term null; payload: ids, flags of missing ids, numbers of terms), then its terms.

    Documents are numbered by their number of terms, so the documents of a block are about equally long and the highest
    count with the fewest terms is close to what one of them really scores. A block holds gaps and counts at the
    narrowest width that fits.
    """
    ids = pa.concat_arrays([x[0] for x in parts])
    n = np.concatenate([np.diff(x[1]) for x in parts])
    order = np.argsort(n, kind="stable")
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n))
    coded = pa.chunked_array([x[2] for x in parts], pa.binary()).dictionary_encode().combine_chunks()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.chunk(0) if coded.num_chunks else pa.array([], pa.binary()).dictionary_encode()
    n_docs = len(n)
    key = coded.indices.to_numpy().astype(np.int64) * n_docs + place[np.repeat(np.arange(n_docs), n)]
    key, tf = np.unique(key, return_counts=True)
    term, doc = key // max(n_docs, 1), key % max(n_docs, 1)
    first = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(np.append(first, len(key)))
    n_blocks = -(-df // BLOCK)
    within = np.arange(len(key)) - np.repeat(first, df)
    heads = np.flatnonzero(within % BLOCK == 0)
    sizes = np.diff(np.append(heads, len(key)))
    gaps = np.where(within % BLOCK == 0, doc, doc - np.concatenate(([0], doc[:-1]))).astype(np.uint32)
    counts = np.minimum(tf, (1 << 32) - 1).astype(np.uint32)
    gap_w, tf_w = _widths(gaps, heads), _widths(counts, heads)
    ends = np.cumsum(sizes * (gap_w + tf_w))
    begins = ends - sizes * (gap_w + tf_w)
    payload = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    nth = np.arange(len(key)) - np.repeat(heads, sizes)
    wide, base = np.repeat(gap_w, sizes), np.repeat(begins, sizes)
    _scatter(payload, base + nth * wide, gaps, wide)
    wide2 = np.repeat(tf_w, sizes)
    _scatter(payload, base + np.repeat(sizes * gap_w, sizes) + nth * wide2, counts, wide2)
    cuts = np.concatenate(([0], np.cumsum(n_blocks)))
    from_ = begins[cuts[:-1]] if len(begins) else begins
    spans = np.concatenate((from_, ends[-1:])) if len(ends) else np.zeros(1, np.int64)
    longs = n[order].astype(np.int64)
    maxima = [np.maximum.reduceat(x, heads) if len(heads) else x for x in (doc, counts)]
    least = np.minimum.reduceat(longs[doc], heads) if len(heads) else longs[:0]
    held = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("<i8")[order]
    none = ids.is_null().to_numpy(zero_copy_only=False)[order]
    documents = held.tobytes() + none.astype(np.uint8).tobytes() + longs.tobytes()
    n_terms = len(df)
    block = [
        _binary(maxima[0].astype("<u4"), cuts), _binary(maxima[1].astype("<u4"), cuts), _binary(least.astype("<u4"), cuts),
        _binary((begins - np.repeat(from_, n_blocks)).astype("<u4"), cuts), _binary((gap_w * 16 + tf_w).astype(np.uint8), cuts),
        _binary(payload, spans),
    ]
    alone = [pa.array([number]), pa.array([None], pa.binary()), pa.array([0]), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])]
    head = [*alone, *[pa.array([None], pa.binary())] * 5, pa.array([documents], pa.binary())]
    body = [pa.array(np.full(n_terms, number)), coded.dictionary.cast(pa.binary()), pa.array(df), *[pa.nulls(n_terms, pa.int64())] * 2, *block]
    names = ["shard", "term", "df", "n_docs", "n_terms", "last_doc", "most_tf", "least_n", "spot", "widths", "payload"]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(head, body)], names)


def build_index(docs: DataFrame) -> DataFrame:
    """The inverted index of `docs` (doc_id, text) over all terms, as a table in the shared folder; see `_shard`.

    Every task closes a shard when it has enough documents or bytes, so a shard's memory is bounded (a longer text is
    a shard of its own) and nothing is shuffled. Bounds are kept as counts and lengths, not as scores, so an index
    stays right when others are added to it and the collection's averages change.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, rows, size = TaskContext.get().partitionId() << 32, [], 0, 0
        for whole in batches:
            for batch in slices(whole.select(["doc_id", "text"]), most=SHARD_BYTES // 4):
                for at in range(0, batch.num_rows, SHARD_DOCS // 4):
                    some = batch.slice(at, SHARD_DOCS // 4)
                    parts.append((some.column("doc_id"), *split_terms(some.column("text"))))
                    rows += some.num_rows
                    size += pc.sum(pc.binary_length(some.column("text"))).as_py() or 0
                    if rows >= SHARD_DOCS or size >= SHARD_BYTES:
                        yield _shard(number, parts)
                        number, parts, rows, size = number + 1, [], 0, 0
        if parts:
            yield _shard(number, parts)

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(narrow.mapInArrow(index, INDEX), "lexical-index")


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term) once each. Rows of one item are one item with the terms of all; null texts have none."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                at, terms = split_terms(batch.column("text"))
                rows = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(at)))
                yield pa.RecordBatch.from_arrays([batch.column("item").take(rows), terms], ["item", "term"])

    named = items.select(F.col(item).cast("bigint").alias("item"), F.col(text).cast("string").alias("text"))
    return named.mapInArrow(split, "item bigint, term binary").distinct()


def term_weight(df: Column, n: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double"))).cast("bigint")


class Search:
    """The k best documents of each item over shards one after another; what is found so far bars what comes."""

    def __init__(self, items: dict, n: int, length: int, k: int):
        """`items`: for each item its terms as {term: weight}."""
        self.items, self.n, self.length, self.k = items, n, length, k
        self.best = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for i in items}

    def parts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a term adds for a weight of 1."""
        m = 10 + (90 * n * self.n) // max(self.length, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)

    def shard(self, rows: dict[bytes, dict], documents: bytes) -> None:
        count = len(documents) // 17
        self.ids = np.frombuffer(documents, "<i8", count)
        self.none = np.frombuffer(documents, np.uint8, count, 8 * count).astype(bool)
        self.longs = np.frombuffer(documents, "<i8", count, 9 * count)
        self.open: dict = {}
        lists = {}
        for term, row in rows.items():
            last, most, least, spot = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("last_doc", "most_tf", "least_n", "spot"))
            lists[term] = (last, self.parts(most, least), spot, np.frombuffer(row["widths"], np.uint8), row["payload"])
        self.lists = lists
        for item, weights in self.items.items():
            held = [(w, t) for t, w in weights.items() if w > 0 and t in lists]
            if held:
                self.search(item, held)

    def block(self, term: bytes, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and what the term adds to each for a weight of 1; unpacked when first asked for."""
        known = self.open.get((term, at))
        if known is None:
            last, _, spot, widths, payload = self.lists[term]
            gap_w, tf_w = divmod(int(widths[at]), 16)
            begin = int(spot[at])
            size = (int(spot[at + 1] if at + 1 < len(spot) else len(payload)) - begin) // (gap_w + tf_w)
            docs = np.cumsum(np.frombuffer(payload, f"<u{gap_w}", size, begin).astype(np.int64))
            tf = np.frombuffer(payload, f"<u{tf_w}", size, begin + size * gap_w).astype(np.int64)
            known = self.open[term, at] = docs, self.parts(tf, self.longs[docs])
        return known

    def keep(self, item, docs: np.ndarray, scores: np.ndarray) -> None:
        """The k best of those so far and these: by score, then by doc_id, rows without one last."""
        s, i, e = self.best[item]
        s, i, e = np.append(s, scores), np.append(i, self.ids[docs]), np.append(e, self.none[docs])
        top = np.lexsort((i, e, -s))[: self.k]
        self.best[item] = s[top], i[top], e[top]

    def search(self, item, held: list[tuple[int, bytes]]) -> None:
        """MaxScore over a shard. Lists are in order of the most they can add. Those at the front whose sum stays below the
        threshold are not essential: no document with only these can enter. Candidates come from the others. A candidate
        goes on to a list in front only while its score, the bound of the block it would stand in and the sum of the
        lists before that can reach the threshold; only blocks that a candidate still needs are unpacked. A bound
        equal to the threshold passes, since a smaller doc_id wins a tie."""
        bounds = sorted((int(self.lists[t][1].max()) * w, w, t) for w, t in held)
        sums = np.concatenate(([0], np.cumsum([b for b, _, _ in bounds])))
        count = len(self.ids)
        for low in range(0, count, STEP):
            high = min(low + STEP, count)
            scores = self.best[item][0]
            bar = int(scores[-1]) if len(scores) == self.k else 1
            first = int(np.searchsorted(sums[1:], bar, "left"))  # sums[first] < bar
            if first == len(bounds):
                return
            partial = np.zeros(high - low, np.int64)
            for _, w, t in bounds[first:]:
                last = self.lists[t][0]
                for at in range(int(np.searchsorted(last, low)), min(int(np.searchsorted(last, high - 1)) + 1, len(last))):
                    docs, adds = self.block(t, at)
                    a, b = np.searchsorted(docs, (low, high))
                    partial[docs[a:b] - low] += w * adds[a:b]
            alive = np.flatnonzero((partial > 0) & (partial + sums[first] >= bar))
            score = partial[alive]
            for nth in range(first - 1, -1, -1):
                if not len(alive):
                    break
                _, w, t = bounds[nth]
                last, most = self.lists[t][:2]
                place = np.searchsorted(last, alive + low)
                inside = place < len(last)
                there = np.minimum(place, len(last) - 1)
                hope = score + np.where(inside, w * most[there], 0) + sums[nth]
                stay = hope >= bar
                alive, score, there, inside = alive[stay], score[stay], there[stay], inside[stay]
                for at in np.unique(there[inside]):
                    docs, adds = self.block(t, int(at))
                    mine = np.flatnonzero(inside & (there == at))
                    spot = np.searchsorted(docs, alive[mine] + low)
                    spot[spot == len(docs)] = 0
                    hit = docs[spot] == alive[mine] + low
                    score[mine[hit]] += w * adds[spot[hit]]
            won = score >= bar
            if won.any():
                self.keep(item, alive[won] + low, score[won])

    def found(self) -> pa.RecordBatch:
        sizes = [len(x[0]) for x in self.best.values()]
        items = [i for i, size in zip(self.best, sizes) for _ in range(size)]
        ids = np.concatenate([x[1] for x in self.best.values()] or [np.zeros(0, np.int64)])
        none = np.concatenate([x[2] for x in self.best.values()] or [np.zeros(0, bool)])
        scores = np.concatenate([x[0] for x in self.best.values()] or [np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array(ids, mask=none), pa.array(scores)], ["item", "doc_id", "score"]
        )


def _search_pass(index: DataFrame, asked: DataFrame, n: int, length: int, k: int) -> DataFrame:
    """The k best of each task for the items of `asked` (item, term, weight), which is bounded by `PASS_PAIRS`."""
    pairs = asked.toArrow()
    items: dict = {}
    for i, t, w in zip(*(pairs.column(c).to_pylist() for c in ("item", "term", "weight"))):
        items.setdefault(i, {})[t] = w
    terms = asked.select("term").distinct()
    needed = index.where("term IS NULL").unionByName(index.join(terms, "term", "left_semi").select(index.columns))
    shards = needed.select("shard", "term", "last_doc", "most_tf", "least_n", "spot", "widths", "payload")
    together = shards.repartition("shard").sortWithinPartitions(F.col("shard"), F.col("term").asc_nulls_first())
    shared = index.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Search(shared.value, n, length, k)
        shard, documents, rows = None, b"", {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["term"] is None:
                    if rows:
                        engine.shard(rows, documents)
                    shard, documents, rows = row["shard"], row["payload"], {}
                else:
                    rows[row["term"]] = row
        if rows:
            engine.shard(rows, documents)
        yield engine.found()

    return together.mapInArrow(search, FOUND)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The `k` documents of `docs` (doc_id, text) that score highest for each item of `items` (item_id, text).

    A term weighs floor(1000 ln((2N+2)/(2df+1))) and adds weight * (10^9 tf div (1000 tf + 8 m)), m = 10 + 90 n N div L;
    N documents with a term, L terms, n terms of the document. Equal scores: by doc_id, rows without one last. Repeated
    rows are documents of their own. Null or empty documents are never found; null or empty items find nothing. Rows
    of items with one item_id are one item. Scores of 0 are left out. Other columns are not looked at. Empty tables
    give no rows. 90 n N must stay below 2^63.

    Items are searched in passes of at most `PASS_PAIRS` (item, term) pairs, which go to every task; each task keeps k
    documents an item over all its shards, and these heaps are merged in the end.
    """
    index = build_index(docs)
    whole = index.where("term IS NULL").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, length = whole[0] or 0, whole[1] or 0
    pairs = stage(item_terms(items), "item-terms")
    counted = index.where("term IS NOT NULL").join(pairs.select("term").distinct(), "term", "left_semi")
    weights = counted.groupBy("term").agg(F.sum("df").alias("df")).withColumn("weight", term_weight(F.col("df"), F.lit(n)))
    passes = max(1, -(-pairs.count() * 2 // PASS_PAIRS))
    dealt = stage(
        pairs.join(weights.select("term", "weight"), "term").withColumn("pass", F.pmod(F.xxhash64("item"), F.lit(passes))), "item-weights"
    )
    found = None
    for number in range(passes):
        some = _search_pass(index, dealt.where(F.col("pass") == number), n, length, k)
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
