"""Encoding and decoding with a vocabulary of pieces: best path under a unigram model, bytes where no piece fits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from curbside.llm.text import KEEP, Recent, distinct, gather, resident, slices
from curbside.llm.trie import DoubleArrayTrie, best_paths, lattice

MARK = "▁"
#: How much worse than the worst piece a character without a piece is.
BARE = 10.0
#: A lattice takes some hundred bytes for each byte of its strings.
LATTICE_BYTES = 64 << 10


def zipf_scores(n: int) -> np.ndarray:
    """Log probabilities that fall with the rank by Zipf's law."""
    score = -np.log(np.arange(n) + 2.7)
    return score - np.log(np.exp(score).sum())


class PieceCodec:
    """Pieces of a SentencePiece file with log scores.

    A unigram file brings its own scores. Other files only rank their pieces: those get `zipf_scores` in the
    order of their ids. Text gets one mark in front, each space becomes a mark; nothing else is changed.
    """

    def __init__(self, path: str, keep: int = KEEP):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = {x.type for x in model.pieces}
        if model.normalizer_spec.precompiled_charsmap or not model.normalizer_spec.add_dummy_prefix or 6 not in kinds:
            raise ValueError("the file must leave text as it is, add a mark in front and hold byte pieces")
        normal = [i for i, x in enumerate(model.pieces) if x.type == 1]
        self.ids = np.asarray(normal, "<u4")
        self.pieces = [model.pieces[i].piece.encode() for i in normal]
        if model.trainer_spec.model_type == 1:
            self.scores = np.array([model.pieces[i].score for i in normal])
        else:
            self.scores = zipf_scores(len(normal))
        self.bytes = np.zeros(256, "<u4")
        self.text = [b""] * len(model.pieces)
        for i, x in enumerate(model.pieces):
            if x.type == 1:
                self.text[i] = x.piece.replace(MARK, " ").encode()
            elif x.type == 6:
                self.bytes[int(x.piece[1:-1], 16)] = i
                self.text[i] = bytes([int(x.piece[1:-1], 16)])
        # Text falls apart before each run of marks and around line ends, if no piece reaches over such places.
        inner = re.compile(f"[^{MARK}]{MARK}|\n")
        if any(inner.search(p.decode()) for p in self.pieces):
            raise ValueError("pieces that reach over a space or a line end are not supported")
        self.trie = DoubleArrayTrie(self.pieces)
        self.known = Recent(keep)

    def segment(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk (marks in place) as little-endian unsigned 32-bit integers."""
        if not chunks:
            return []
        strings = [x.encode() for x in chunks]
        found = lattice(self.trie, strings)
        edges, many = best_paths(found, self.scores, self.scores.min() - BARE)
        key, start, end = found.key[edges], found.start[edges], found.end[edges]
        size = np.where(key >= 0, 1, end - start)
        ids = np.repeat(np.where(key >= 0, self.ids[key], 0), size).astype("<u4")
        data = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
        bare = key < 0
        if bare.any():
            places = np.repeat(bare, size)
            ids[places] = self.bytes[gather(start[bare], (end - start)[bare], data)]
        ends = np.cumsum(np.concatenate(([0], size)))[np.cumsum(np.concatenate(([0], many)))]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:])]

    def coded(self, chunks: list[str]) -> list[bytes]:
        """`segment`, with a memory of chunks."""
        out = [self.known.get(x) for x in chunks]
        late = [i for i, ids in enumerate(out) if ids is None]
        done = 0
        for run in runs([chunks[i] for i in late]):
            for at, ids in zip(late[done:], self.segment(run)):
                out[at] = ids
                self.known.put(chunks[at], ids)
            done += len(run)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row offsets into the ids, and the ids of all texts. Null and empty texts have none."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring(texts, MARK), pc.starts_with(texts, " ")))
        odd = odd.to_numpy(zero_copy_only=False)
        blank = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        marked = pc.binary_join_element_wise(MARK, pc.replace_substring(texts, " ", f" {MARK}"), "")
        lists = pc.split_pattern(pc.replace_substring(marked, "\n", " \n "), " ")
        words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        good = pc.not_equal(words, "").to_numpy(zero_copy_only=False) & ~odd[row] & ~blank[row]
        words, row = words.filter(pa.array(good)), row[good]
        if odd.any():
            more_words, more_rows = [], []
            for at in np.flatnonzero(odd):
                own = re.findall(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+", MARK + texts[at].as_py().replace(" ", MARK))
                more_words += own
                more_rows += [at] * len(own)
            row = np.concatenate((row, np.asarray(more_rows, np.int64)))
            order = np.argsort(row, kind="stable")
            words = pa.concat_arrays([words, pa.array(more_words, words.type)]).take(pa.array(order))
            row = row[order]
        codes, known = distinct(words)
        if not known:
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, "<u4")
        coded = self.coded(known)
        size = np.fromiter((len(x) >> 2 for x in coded), np.int64, len(coded))
        lengths = size[codes]
        ids = gather((np.cumsum(size) - size)[codes], lengths, np.frombuffer(b"".join(coded), "<u4"))
        return np.concatenate(([0], np.cumsum(np.bincount(row, lengths, len(texts)).astype(np.int64)))), ids

    def columns(self, texts: pa.Array) -> tuple[list[bytes], list[pa.Array]]:
        """The ids of each text, and as columns: ids, how many, how many of these are bytes."""
        low, high = self.bytes.min(), self.bytes.max()
        offsets, ids = self.encode(texts)
        raw = ids.tobytes()
        spare = np.concatenate(([0], np.cumsum((ids >= low) & (ids <= high))))[offsets]
        own = [raw[4 * a : 4 * b] for a, b in zip(offsets[:-1], offsets[1:])]
        return own, [pa.array(own, pa.binary()), pa.array(np.diff(offsets), pa.int64()), pa.array(np.diff(spare), pa.int64())]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of one document's ids in UTF-8, without the space in front that encoding added."""
        text = b"".join([self.text[i] for i in ids.tolist()])
        return text[1:] if text[:1] == b" " else text


def piece_codec(path: str) -> PieceCodec:
    return resident(("pieces", path), lambda: PieceCodec(path))


def runs(strings: list[str], most: int = LATTICE_BYTES) -> Iterator[list[str]]:
    """`strings` in runs of about `most` bytes; a longer one is a run of its own."""
    if strings:
        size = np.fromiter((len(x.encode()) for x in strings), np.int64, len(strings))
        cut = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
        for a, b in zip([0, *cut], [*cut, len(strings)]):
            yield strings[a:b]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, text, ids (binary: little-endian unsigned 32-bit integers), n_tokens and n_bytes (byte pieces among them).

    `docs` has doc_id and text; other columns are not read. Null and empty texts have no ids. Of segmentations
    with equal scores, the one whose last differing piece is longest. Rows stay one for one.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(model)
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                _, columns = codec.columns(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), *columns], names=["doc_id", "text", "ids", "n_tokens", "n_bytes"]
                )

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(
        encode, "doc_id bigint, text string, ids binary, n_tokens bigint, n_bytes bigint"
    )


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes as `encode_documents` gives them, and round_trip: whether the ids decode to the text
    (null: empty). Encoded and decoded in one pass; texts stay where they are, so nothing but ids leaves the worker."""

    def there_and_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(model)
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                ids, columns = codec.columns(part.column("text"))
                texts = (x or "" for x in part.column("text").to_pylist())
                same = [codec.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") == text for x, text in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *columns, pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "n_bytes", "round_trip"]
                )

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(
        there_and_back, "doc_id bigint, ids binary, n_tokens bigint, n_bytes bigint, round_trip boolean"
    )


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """`encoded` (with ids as `encode_documents` writes them) with a column `decoded`, replacing one of that name.

    Bytes that are not UTF-8 become U+FFFD; null ids give an empty text. A mark in the original text comes back as a space.
    """
    kept = [c for c in encoded.columns if c != "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(model)
        for batch in batches:
            texts = [
                codec.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") if x else ""
                for x in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, "decoded"])

    return encoded.select(*[f"`{c}`" for c in kept]).mapInArrow(decode, f"{schema}, decoded string")
