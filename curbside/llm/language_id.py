"""Language of whole texts: piece probabilities by language, summed over all segmentations."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from curbside.llm.pieces import LATTICE_BYTES, MARK, piece_codec, runs
from curbside.llm.text import KEEP, Recent, distinct, resident, slices, split_words
from curbside.llm.trie import expected_counts, lattice, path_sums
from curbside.sources.staging import stage

UNKNOWN = "und"
#: Log probability of a character that no piece covers, the same in every language.
BARE = float(np.log(1e-9))
#: Texts whose words are held at once.
TEXT_BYTES = 2 << 20


def letter_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row offsets and the lower-case runs of letters of each text."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    return split_words(pc.replace_substring_regex(lowered, r"[^\p{L}]+", " "))


@dataclass
class LanguageModel:
    vocabulary: str
    languages: list[str]
    scores: np.ndarray  # log probabilities, pieces x languages
    prior: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scorer:
    """Log probability of words in each language; `keep` words are remembered."""

    def __init__(self, model: LanguageModel, keep: int = KEEP):
        self.model, self.codec, self.known = model, piece_codec(model.vocabulary), Recent(keep)

    def words(self, words: list[str]) -> np.ndarray:
        out = [self.known.get(w) for w in words]
        late = [i for i, sums in enumerate(out) if sums is None]
        done = 0
        for run in runs([words[i] for i in late]):
            found = lattice(self.codec.trie, [(MARK + w).encode() for w in run])
            sums = path_sums(found, self.model.scores, np.full(len(self.model.languages), BARE))[found.last]
            for at, row in zip(late[done:], sums):
                out[at] = row.tobytes()
                self.known.put(words[at], out[at])
            done += len(run)
        return np.frombuffer(b"".join(out)).reshape(-1, len(self.model.languages))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        offsets, words = letter_words(texts)
        many = np.diff(offsets)
        if not self.model.languages or not len(words):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        codes, known = distinct(words)
        each = self.words(known)[codes]
        total = np.zeros((len(texts), each.shape[1]))
        full = np.flatnonzero(many)
        total[full] = np.add.reduceat(each, offsets[:-1][full], axis=0)
        total += self.model.prior
        best = total.argmax(axis=1)
        share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.model.languages[b] if n else UNKNOWN for b, n in zip(best, many)]
        return names, np.where(many > 0, share, 0.0)


def _scorer(model: Broadcast) -> Scorer:
    return resident(("languages", model.value.name), lambda: Scorer(model.value))


def train(labelled: DataFrame, vocabulary: str, per_language: int = 4000, most: int = 256, rounds: int = 3) -> LanguageModel:
    """Piece probabilities for each language, by expectation maximisation over all segmentations of the words.

    `labelled` has doc_id, text and lang; rows without a language are not used, nor those without a doc_id.
    The model is fitted on a sample of about `per_language` documents of each language, chosen by a hash
    of doc_id; whole texts of these are used. More than `most` languages are an error: none is left out. Without
    labelled rows the model has no language and predicts `und` for every text.
    """
    spark = labelled.sparkSession
    labelled = labelled.select("doc_id", "text", "lang").where("lang is not null and doc_id is not null")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"there are more than {most} labelled languages")
    languages = sorted(r["lang"] for r in sizes)
    codec = piece_codec(vocabulary)
    if not languages:
        return LanguageModel(vocabulary, [], np.zeros((len(codec.pieces), 0)), np.zeros(0))
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_language / r["count"]))) for r in sizes], F.lit(0.0))
    place = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                offsets, words = letter_words(part.column("text"))
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                coded = part.column("lang").dictionary_encode()
                lang = coded.indices.to_numpy()[row]
                codes, known = distinct(words)
                pair, many = np.unique(lang.astype(np.int64) * max(1, len(known)) + codes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        coded.dictionary.take(pa.array(pair // max(1, len(known)))),
                        pa.array(known, pa.string()).take(pa.array(pair % max(1, len(known)))),
                        pa.array(many, pa.int64()),
                    ],
                    names=["lang", "word", "n"],
                )

    sample = labelled.where(place < share).select("text", "lang")
    words = sample.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stage(words, "language-words")
    scores = np.repeat(codec.scores[:, None], len(languages), axis=1)
    for _ in range(rounds):
        counts = _expected(words, vocabulary, scores, number)
        pooled = counts.sum(axis=1, keepdims=True)
        mass = counts + 0.1 + 50.0 * pooled / max(pooled.sum(), 1.0)
        scores = np.log(mass / mass.sum(axis=0))
    total = np.array([next(r["count"] for r in sizes if r["lang"] == x) for x in languages], float)
    return LanguageModel(vocabulary, languages, scores, np.log(total / total.sum()))


def _expected(words: DataFrame, vocabulary: str, scores: np.ndarray, number: dict[str, int]) -> np.ndarray:
    """Expected piece counts by language; tasks send one row for each piece and language that they met."""
    shared = words.sparkSession.sparkContext.broadcast(scores)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, scores = piece_codec(vocabulary), shared.value
        total = np.zeros(scores.shape)
        for batch in batches:
            for part in slices(batch, "word", LATTICE_BYTES):
                weight = np.zeros((part.num_rows, scores.shape[1]))
                lang = np.array([number[x] for x in part.column("lang").to_pylist()], np.int64)
                weight[np.arange(part.num_rows), lang] = part.column("n").to_numpy()
                found = lattice(codec.trie, [(MARK + w).encode() for w in part.column("word").to_pylist()])
                total += expected_counts(found, scores, np.full(scores.shape[1], BARE), weight)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], names=["piece", "lang", "n"]
        )

    summed = words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
    out = np.zeros(scores.shape)
    rows = summed.toArrow()  # pieces x languages at most
    out[rows["piece"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
    return out


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1: the posterior share) for each row of `docs` (doc_id, text).

    The whole text counts. `und` with score 0 if the text is null or has no letters. Of equal languages the
    first in order wins. Rows stay one for one, repeated ones too; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                names, score = scorer.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
                )

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(
        predict, "doc_id bigint, lang_pred string, score double"
    )


def keep_known_languages(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose language is found with a score of `least` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                names, score = scorer.predict(part.column("text"))
                good = (np.array(names, object) != UNKNOWN) & (score >= least)
                yield part.filter(pa.array(good))

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(keep, docs.schema)
