"""Toxicity of whole texts: a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from curbside.llm.language_id import letter_words
from curbside.llm.text import distinct, gather, slices
from curbside.sources.staging import stage


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum w_i + sum_{i<j} <v_i, v_j>) over the terms present that were chosen in training."""

    bits: int
    chosen: np.ndarray  # sorted hashes
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, offsets: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """For each row, the probability of class 1. terms: positions in `chosen`, once per row."""
        rows = len(offsets) - 1
        row = np.repeat(np.arange(rows), np.diff(offsets))
        linear = np.bincount(row, self.weights[terms], rows)
        out = self.bias + linear
        for f in range(self.factors.shape[1]):
            v = self.factors[terms, f]
            out += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return 1.0 / (1.0 + np.exp(-np.clip(out, -40, 40)))


#: Lengths of the prefixes that are terms besides the whole word.
PREFIXES = range(3, 9)


class Terms:
    """Distinct hashed terms of texts, hashed to 2**bits values: lower-case runs of letters and their prefixes."""

    def __init__(self, bits: int, chosen: np.ndarray | None = None):
        self.mask = (1 << bits) - 1
        self.table = None
        if chosen is not None:
            self.table = np.full(1 << bits, -1, np.int64)
            self.table[chosen] = np.arange(len(chosen))

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row offsets and the terms of each text (positions in `chosen`, if given), each once and in order."""
        offsets, words = letter_words(texts)
        codes, known = distinct(words)
        terms = [[zlib.crc32(t) for t in [w.encode(), *[b"^" + w[:k].encode() for k in PREFIXES if len(w) > k]]] for w in known]
        many = np.fromiter(map(len, terms), np.int64, len(terms))
        flat = np.fromiter((t for own in terms for t in own), np.int64, int(many.sum())) & self.mask
        owner = np.repeat(np.arange(len(known)), many)
        if self.table is not None:
            flat = self.table[flat]
            owner, flat = owner[flat >= 0], flat[flat >= 0]
            many = np.bincount(owner, minlength=len(known))
        start = np.cumsum(many) - many
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        used = many[codes] > 0
        row, codes = row[used], codes[used]
        term = gather(start[codes], many[codes], flat) if len(codes) else np.zeros(0, np.int64)
        pair = np.unique(np.repeat(row, many[codes]) * (self.mask + 1) + term)
        row, term = pair // (self.mask + 1), pair % (self.mask + 1)
        return np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts))))), term


def _fit(
    offsets: np.ndarray, terms: np.ndarray, labels: np.ndarray, n: int, rank: int, epochs: int, seed: int, least_steps: int = 800
) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the logistic loss in mini-batches, with weight decay."""
    random = np.random.default_rng(seed)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    epochs = max(epochs, -(-least_steps * 256 // max(1, len(labels))))
    params = [np.array([np.log(share / (1 - share))]), np.zeros(n), random.normal(0, 0.05, (n, rank))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    many, step = np.diff(offsets), 0
    for epoch in range(epochs):
        order = random.permutation(len(labels))
        rate = 0.03 / (1 + 10 * epoch / epochs)
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            own = np.repeat(np.arange(len(rows)), many[rows])
            begin = np.cumsum(many[rows]) - many[rows]
            term = terms[np.arange(len(own)) - np.repeat(begin, many[rows]) + np.repeat(offsets[:-1][rows], many[rows])]
            v = params[2][term]
            sums = np.zeros((len(rows), rank))
            np.add.at(sums, own, v)
            squares = np.zeros(len(rows))
            np.add.at(squares, own, (v * v).sum(axis=1))
            raw = params[0][0] + np.bincount(own, params[1][term], len(rows)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = (1.0 / (1.0 + np.exp(-np.clip(raw, -40, 40))) - labels[rows]) / len(rows)
            grad_v = np.zeros_like(params[2])
            np.add.at(grad_v, term, error[own, None] * (sums[own] - v))
            grads = [np.array([error.sum()]), np.bincount(term, error[own], n), grad_v]
            step += 1
            for p, g, (m, s) in zip(params, grads, moments):
                g = g + 1e-5 * p if p.ndim and len(p) > 1 else g
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def train(
    docs: DataFrame, labels: DataFrame, sample: int = 20_000, bits: int = 20, terms: int = 4096, least: float = 20.0,
    rank: int = 8, epochs: int = 15, seed: int = 7,
) -> FactorizationMachine:
    """A factorization machine fitted on the texts of `docs` (doc_id, text) by `labels` (doc_id, label 0/1).

    A sample of about `sample` labelled doc_ids is chosen by a hash; whole texts of it are used. A doc_id with several
    labels has the largest; labels without doc_id or of another value are left out. Only the sampled labels are sent
    to where the texts are: no text is shuffled, however many rows there are. Of the hashed terms, the `terms` with
    the highest chi-square against the label, `least` or more, enter the model. Without rows of both labels the model
    always gives the share of label 1 (0 without rows).
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = known.count()
    place = F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = stage(known.where(place < min(1.0, sample / max(sizes, 1))), "toxicity-sample")
    # the draw is bounded by `sample`, give or take its chance error, whatever the input
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    chosen_rows = stage(texts, "toxicity-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Terms(bits)
        total = np.zeros((2, 1 << bits), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            for part in slices(batch):
                offsets, term = found.rows(part.column("text"))
                label = part.column("label").to_numpy()
                np.add.at(total, (np.repeat(label, np.diff(offsets)), term), 1)
                rows += np.bincount(label, minlength=2)
        label, term = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(term, [-1, -1]), pa.int64()),
                pa.array(np.append(np.where(label == 1, 0, total[label, term]), rows[0:1].tolist() + [0]), pa.int64()),
                pa.array(np.append(np.where(label == 1, total[label, term], 0), [0] + rows[1:2].tolist()), pa.int64()),
            ],
            names=["term", "n0", "n1"],
        )

    counted = chosen_rows.select("text", "label").mapInArrow(count, "term bigint, n0 bigint, n1 bigint")
    counted = counted.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # 2**bits rows at most
    term, n0, n1 = (counted[c].to_numpy().astype(float) for c in ("term", "n0", "n1"))
    rows0, rows1 = n0[term < 0].sum(), n1[term < 0].sum()
    if not rows0 or not rows1:
        bias = 40.0 if rows1 else -40.0
        return FactorizationMachine(bits, np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, rank)))
    good = (term >= 0) & (n0 + n1 >= 3) & (n0 + n1 < rows0 + rows1)
    term, n0, n1 = term[good], n0[good], n1[good]
    total, seen = rows0 + rows1, n0 + n1
    chi = total * (n1 * (rows0 - n0) - n0 * (rows1 - n1)) ** 2 / (rows0 * rows1 * seen * (total - seen))
    top = np.lexsort((term, -chi))[:terms]
    top = top[chi[top] >= least]
    chosen = np.sort(term[top].astype(np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Terms(bits, chosen)
        for batch in batches:
            for part in slices(batch):
                offsets, term = found.rows(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(term, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, part.column("label")], names=["doc_id", "terms", "label"])

    # the bounded sample, with the terms of the model only
    encoded = chosen_rows.mapInArrow(encode, "doc_id bigint, terms array<int>, label int").toArrow().sort_by("doc_id").combine_chunks()
    lists = encoded["terms"].combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    bias, weights, factors = _fit(
        offsets - offsets[0], lists.flatten().to_numpy(), encoded["label"].to_numpy().astype(float), len(chosen), rank, epochs, seed
    )
    return FactorizationMachine(bits, chosen, bias, weights, factors)


def score_toxicity(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id and score (0 to 1) for each row of `docs` (doc_id, text), from the whole text.

    Null and empty texts, and texts without a term of the model, get the score of the bias alone. Rows stay
    one for one, repeated ones too; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        found = Terms(model.bits, model.chosen)
        for batch in batches:
            for part in slices(batch):
                offsets, term = found.rows(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(model.score(offsets, term))], names=["doc_id", "score"]
                )

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(score, "doc_id bigint, score double")
