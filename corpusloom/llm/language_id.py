"""Language identification with segmentation-marginalised unigrams.

The pieces of a public vocabulary are the alphabet. A language is a probability for each
piece; the probability of a word is the sum over all ways to cut it into pieces, found by a
forward pass over the word's lattice, and the score of a text is the sum of its words' log
probabilities. No single segmentation is ever chosen.

The probabilities are learned by expectation: under equal piece probabilities, a
forward-backward pass gives the expected number of times that each piece is used in a word;
these are summed over all words of a language and smoothed. Counting touches each document
once, and what is shuffled is a row for each language, piece and task at most.

Lattices of many words are worked through together as numpy arrays, and a worker remembers
the words that it has met.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LETTER_RUN, MEMORY_WORDS, Memory, once_per_worker, vocabulary

VOCABULARY = "piece_bpe_32k.model"
UNDETERMINED = "und"
#: A longer run of letters is scored in stretches of this many.
WORD_CHARS = 32
#: Longest piece that is looked up; the vocabulary has few longer ones.
PIECE_CHARS = 12
#: Classes of the characters that are no piece of the vocabulary.
UNKNOWN = 256
#: Added to the expected count of every piece.
SMOOTHING = 0.5
#: Languages that a model may hold; each has a row of probabilities on every worker.
MAX_LANGUAGES = 200
#: Words worked through together.
WORDS = 8192
START = "▁"
#: Base of the hashes by which numpy looks up pieces.
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary, and lattices of words over it."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and len(piece) <= PIECE_CHARS:
                self.ids.setdefault(piece.lower(), len(self.ids))
        self.size = len(self.ids) + UNKNOWN
        # For each number of characters: hashes of its pieces, sorted, and their ids.
        self.by_chars: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for chars in range(1, PIECE_CHARS + 1):
            pieces = [w for w in self.ids if len(w) == chars]
            codes = np.array(pieces, f"U{chars}").view(np.uint32).reshape(len(pieces), chars)
            keys = np.zeros(len(pieces), np.uint64)
            for i in range(chars):
                keys = keys * HASH_BASE + codes[:, i]
            order = np.argsort(keys)
            ids = np.fromiter((self.ids[w] for w in pieces), np.int64, len(pieces))
            self.by_chars[chars] = (np.append(keys[order], np.uint64(2**64 - 1)), np.append(ids[order], -1))

    def lattice(self, words: Sequence[str]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """Lengths of the words, and their edges by end and number of characters.

        An edge group is (end, characters, rows, piece ids); a row has one edge of each kind.
        """
        marked = [START + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        width = int(lengths.max())
        codes = np.array(marked, f"U{width}").view(np.uint32).reshape(len(marked), width).T.copy()
        keys = np.zeros(codes.shape, np.uint64)
        edges = []
        for chars in range(1, min(width, PIECE_CHARS) + 1):
            starts = width - chars + 1
            keys = keys[:starts] * HASH_BASE + codes[chars - 1 :]
            known, ids = self.by_chars[chars]
            at = np.searchsorted(known, keys)
            found = np.where(known[at] == keys, ids[at], -1)
            if chars == 1:
                found = np.where(found < 0, len(self.ids) + (codes % UNKNOWN).astype(np.int64), found)
            inside = np.arange(chars, width + 1)[:, None] <= lengths
            hit = inside & (found >= 0)
            for start in np.flatnonzero(hit.any(1)):
                rows = np.flatnonzero(hit[start])
                edges.append((int(start) + chars, chars, rows, found[start, rows]))
        edges.sort(key=lambda e: e[:2])
        return lengths, edges

    def log_probabilities(self, words: Sequence[str], table: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language; ``table`` is pieces by languages."""
        out = np.empty((len(words), table.shape[1]))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))  # little padding
        for k in range(0, len(words), WORDS):
            at = order[k : k + WORDS]
            part = [words[i] for i in at]
            lengths, edges = self.lattice(part)
            forward = np.zeros((int(lengths.max()) + 1, len(part), table.shape[1]))
            forward[0] = 1.0
            for end, chars, rows, pieces in edges:
                forward[end, rows] += forward[end - chars, rows] * table[pieces]
            out[at] = np.log(forward[lengths, np.arange(len(part))])
        return out

    def expected_counts(self, words: Sequence[str], weights: np.ndarray, out: np.ndarray) -> None:
        """Add the expected use of each piece in the words, under equal piece probabilities."""
        p = 1.0 / self.size
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for k in range(0, len(words), WORDS):
            at = order[k : k + WORDS]
            part = [words[i] for i in at]
            lengths, edges = self.lattice(part)
            width = int(lengths.max()) + 1
            forward, backward = np.zeros((width, len(part))), np.zeros((width, len(part)))
            forward[0] = 1.0
            for end, chars, rows, _ in edges:
                forward[end, rows] += forward[end - chars, rows] * p
            backward[lengths, np.arange(len(part))] = 1.0
            for end, chars, rows, _ in reversed(edges):
                backward[end - chars, rows] += backward[end, rows] * p
            scale = weights[at] / forward[lengths, np.arange(len(part))] * p
            for end, chars, rows, pieces in edges:
                used = forward[end - chars, rows] * backward[end, rows] * scale[rows]
                out += np.bincount(pieces, used, len(out))


def pieces_of(path: str) -> Pieces:
    return once_per_worker(f"pieces {path}", lambda: Pieces(path))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; long ones in stretches."""
    words = LETTER_RUN.findall(text.lower())
    if any(len(w) > WORD_CHARS for w in words):
        words = [w[i : i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)]
    return words


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # piece probabilities, pieces by languages
    priors: np.ndarray  # log shares of the documents
    path: str


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", path: str | None = None) -> Model:
    """Learn from all rows whose text and language are not null.

    The model holds a number for each language and piece. No such rows give a model without
    languages; more than ``MAX_LANGUAGES`` raise.
    """
    path = path or vocabulary(VOCABULARY)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    shares = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(shares) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["lang"] for r in shares]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(path)
        sums: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def settle() -> None:
            for language, found in words.items():
                if language not in sums:
                    sums[language] = np.zeros(own.size)
                own.expected_counts(list(found), np.fromiter(found.values(), float, len(found)), sums[language])
            words.clear()

        for batch in batches:
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if language not in words:
                    words[language] = Counter()
                words[language].update(words_of(body))
                if sum(map(len, words.values())) > MEMORY_WORDS:
                    settle()
        settle()
        for language, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.float64())],
                names=["lang", "piece", "n"],
            )

    counted = rows.mapInArrow(count, "lang string, piece int, n double")
    # At most a number for each language and piece comes to the driver.
    sums = counted.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    table = np.full((pieces_of(path).size, len(languages)), SMOOTHING)
    column = {language: i for i, language in enumerate(languages)}
    np.add.at(table, (np.array(sums["piece"], np.int64), np.array([column[x] for x in sums["lang"]], np.int64)), np.array(sums["n"]))
    table /= table.sum(0)
    total = sum(r["n"] for r in shares)
    return Model(languages, table, np.log([r["n"] / total for r in shares]), path)


class _Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.memory = Memory()
        self.scores = np.empty((0, len(model.languages)))

    def scores_of(self, texts: Sequence[list[str]]) -> Iterator[np.ndarray]:
        """Log posterior scores of each text, from its words."""
        new = list(self.memory.missing(set().union(*texts)))
        known = self.memory.known
        if new:
            used = len(known)
            fresh = pieces_of(self.model.path).log_probabilities(new, self.model.table)
            if used + len(new) > len(self.scores):  # grow by doubling
                larger = np.empty((max(2 * len(self.scores), used + len(new)), fresh.shape[1]))
                larger[:used] = self.scores[:used]
                self.scores = larger
            self.scores[used : used + len(new)] = fresh
            known.update(zip(new, range(used, used + len(new))))
        for words in texts:
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            yield self.scores[at].sum(0) + self.model.priors


#: Characters of text scored together; a longer text is its own group.
GROUP_CHARS = 4_000_000


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", extra: Sequence[Column] = ()) -> DataFrame:
    """Language of each text: the id column, ``extra`` columns, ``lang_pred`` and ``score``.

    ``score`` is the posterior share of the predicted language. A null text, one without a
    letter, and any text under a model without languages are ``und`` with score 0. Ties go
    to the language that sorts first. Nothing but the text takes part. Repeated rows are
    predicted each, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    name = f"scorer {uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        scorer = once_per_worker(name, lambda: _Scorer(model))
        languages = model.languages
        for batch in batches:
            predicted: list[str] = []
            shares: list[float] = []
            texts = batch.column(batch.num_columns - 1).to_pylist()
            at = 0
            while at < len(texts):
                group: list[list[str]] = []
                size = 0
                while at < len(texts) and (not group or size + len(texts[at] or "") <= GROUP_CHARS):
                    words = words_of(texts[at] or "")
                    size += len(texts[at] or "")
                    group.append(words if languages and any(any(map(str.isalpha, w)) for w in words) else [])
                    at += 1
                for words, scores in zip(group, scorer.scores_of(group)):
                    if not words:
                        predicted.append(UNDETERMINED)
                        shares.append(0.0)
                        continue
                    best = int(scores.argmax())
                    predicted.append(languages[best])
                    shares.append(1.0 / float(np.exp(np.maximum(scores - scores[best], -700)).sum()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(predicted, pa.string()), pa.array(shares, pa.float64())],
                names=names,
            )

    kept = [F.col(id_column), *extra]
    rows = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(kept)], F.col(text).cast("string").alias("text"))
    names = [*rows.columns[:-1], "lang_pred", "score"]
    schema = ", ".join([*[f"{c} {t}" for c, t in rows.dtypes[:-1]], "lang_pred string, score double"])
    out = docs.select(*kept).columns
    return rows.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(out)], "lang_pred", "score")
