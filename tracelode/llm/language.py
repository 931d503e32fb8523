"""Language identification by unigram pieces, all segmentations summed.

Every language has a probability for each piece of a fixed public vocabulary.  The
probability of a word is the sum over all its segmentations into pieces, computed by
the forward algorithm; a text's is the product over its words.  Piece probabilities are
fitted by expectation maximisation: words of labelled texts are counted by language in
Spark, expected piece counts come from a forward-backward pass over distinct words, and
only the piece table (vocabulary x languages) reaches the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.frames import bounded_sample, held_out, over_batches
from tracelode.session import materialize

VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 3, 1
FIT_ROWS = 20_000  # labelled rows that a fit looks at, chosen by hash; all when there are fewer
ROUNDS = 3
SMOOTHING = 0.05  # pseudo-count of each piece
LONGEST_PIECE = 12  # characters; longer pieces of the vocabulary are left out
LONGEST_WORD = 24  # characters the forward table spans; longer words are cut into parts
UNKNOWN = 1e-7  # probability of a character without a piece
CACHE_ENTRIES = 300_000
WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def pieces(name: str = VOCABULARY) -> list[str]:
    """Pieces of letters, without the vocabulary's word mark, and all single letters among them."""
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    found = {library.id_to_piece(k).lstrip("▁").lower() for k in range(library.get_piece_size()) if not (library.is_control(k) or library.is_unknown(k) or library.is_byte(k))}
    return sorted(p for p in found if 0 < len(p) <= LONGEST_PIECE and WORD.fullmatch(p))


_KEY = np.uint64(0x9E3779B97F4A7C15)


def _extend(key: np.ndarray, codes: np.ndarray) -> np.ndarray:
    key = (key ^ codes) * _KEY
    return key ^ (key >> np.uint64(29))


class Lattice:
    """Where pieces lie in words: a lookup of substrings by 64-bit keys that grow by one character."""

    def __init__(self, known: list[str]):
        self.size = len(known)
        keys = np.zeros(self.size, np.uint64)
        for k, piece in enumerate(known):
            key = np.zeros(1, np.uint64)
            for c in piece:
                key = _extend(key, np.array([ord(c)], np.uint64))
            keys[k] = key[0]
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], order
        if len(np.unique(keys)) != self.size:
            raise ValueError("two pieces share a key")

    def find(self, words: list[str]) -> list[tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]]:
        """Groups of words of one length: their indices, and for each (start, length) the piece of each word, ``size`` for none."""
        lengths = np.array([len(w) for w in words])
        groups = []
        for n in np.unique(lengths):
            index = np.flatnonzero(lengths == n)
            codes = np.array([[ord(c) for c in words[i]] for i in index], np.uint64).reshape(len(index), n)
            spots = {}
            for start in range(n):
                key = np.zeros(len(index), np.uint64)
                for length in range(1, min(LONGEST_PIECE, n - start) + 1):
                    key = _extend(key, codes[:, start + length - 1])
                    at = np.minimum(np.searchsorted(self.keys, key), self.size - 1)
                    hit = self.keys[at] == key
                    if hit.any() or length == 1:
                        spots[start, length] = np.where(hit, self.numbers[at], self.size)
            groups.append((index, spots))
        return groups


def _table(probabilities: np.ndarray) -> np.ndarray:
    """A last row for substrings that are no piece."""
    return np.vstack([probabilities, np.zeros(probabilities.shape[1])])


def _weights(table: np.ndarray, spots: dict, start: int, length: int) -> np.ndarray:
    own = table[spots[start, length]]
    if length == 1:
        own = np.maximum(own, UNKNOWN)
    return own


def forward(words: list[str], lattice: Lattice, table: np.ndarray) -> np.ndarray:
    """Logarithm of each word's probability in each language, all segmentations summed."""
    out = np.zeros((len(words), table.shape[1]))
    for index, spots in lattice.find(words):
        n = len(words[index[0]])
        sums = [np.ones((len(index), table.shape[1]))]
        for end in range(1, n + 1):
            total = np.zeros_like(sums[0])
            for length in range(1, min(LONGEST_PIECE, end) + 1):
                if (end - length, length) in spots:
                    total += sums[end - length] * _weights(table, spots, end - length, length)
            sums.append(total)
        out[index] = np.log(sums[n])
    return out


def expected(words: list[str], counts: np.ndarray, lattice: Lattice, table: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language; ``counts``: words x languages."""
    used = np.zeros(table.shape)
    for index, spots in lattice.find(words):
        n = len(words[index[0]])
        ahead = [np.ones((len(index), table.shape[1]))]
        for end in range(1, n + 1):
            ahead.append(sum(ahead[end - k] * _weights(table, spots, end - k, k) for k in range(1, min(LONGEST_PIECE, end) + 1) if (end - k, k) in spots))
        behind = [np.ones_like(ahead[0])] * (n + 1)
        for start in range(n - 1, -1, -1):
            behind[start] = sum(behind[start + k] * _weights(table, spots, start, k) for k in range(1, min(LONGEST_PIECE, n - start) + 1) if (start, k) in spots)
        share = counts[index] / ahead[n]
        for (start, length), numbers in spots.items():
            np.add.at(used, numbers, share * ahead[start] * _weights(table, spots, start, length) * behind[start + length])
    return used[:-1]


def words_of(text: str | None) -> list[str]:
    """Lower-case words; a long one in parts."""
    found = WORD.findall((text or "").lower())
    if found and max(map(len, found)) > LONGEST_WORD:
        found = [w[k : k + LONGEST_WORD] for w in found for k in range(0, len(w), LONGEST_WORD)]
    return found


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    probabilities: np.ndarray  # pieces x languages
    priors: np.ndarray


def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, lang, n), pre-aggregated in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[tuple[str, str]] = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame([(w, lang, n) for (w, lang), n in held.items()], columns=["word", "lang", "n"])

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                held.update((w, lang) for w in words_of(text))
                if len(held) > 200_000:
                    yield out()
                    held.clear()
        yield out()

    return rows.select("text", "lang").mapInPandas(run, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, rows: int = FIT_ROWS, vocabulary: str = VOCABULARY) -> Model:
    """Piece probabilities of each language from rows with text and lang outside the held-out fold, ``rows`` of them at most."""
    own = docs.filter("text is not null and lang is not null").filter(~held_out("doc_id", FOLDS, HELD_OUT)).select("doc_id", "text", "lang")
    counts = {row["lang"]: row["n"] for row in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    known = pieces(vocabulary)
    if not languages:
        return Model([], known, np.zeros((len(known), 0)), np.zeros(0))
    counted = materialize(_word_counts(bounded_sample(own, "doc_id", rows, sum(counts.values()))))
    probabilities = np.full((len(known), len(languages)), 1 / len(known))
    context = docs.sparkSession.sparkContext
    place = {lang: k for k, lang in enumerate(languages)}
    for _ in range(ROUNDS):
        shared = context.broadcast((known, _table(probabilities)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, table = shared.value
            lattice = Lattice(names)
            used = np.zeros((len(names), len(place)))
            for batch in batches:
                number, words = pd.factorize(batch["word"])
                held = np.zeros((len(words), len(place)))
                np.add.at(held, (number, batch["lang"].map(place).to_numpy()), batch["n"].to_numpy())
                for k in range(0, len(words), 20_000):
                    used += expected(list(words[k : k + 20_000]), held[k : k + 20_000], lattice, table)
            piece, lang = np.nonzero(used)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": used[piece, lang]})

        found = counted.mapInPandas(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect()
        used = np.full(probabilities.shape, SMOOTHING)
        for row in found:
            used[row["piece"], row["lang"]] += row["n"]
        probabilities = used / used.sum(0)
    total = np.array([counts[lang] for lang in languages], np.float64)
    return Model(languages, known, probabilities, np.log(total / total.sum()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (probability of the language given the text, 0 to 1).

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned; ties go to the language first in
    order; repeated rows and null doc_ids are predicted each; other columns are ignored; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces, _table(model.probabilities)))
    languages, priors = model.languages, model.priors

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        names, table = shared.value
        lattice = Lattice(names)
        known: dict[str, int] = {}
        scores = np.zeros((min(CACHE_ENTRIES, 4_000_000 // max(1, len(languages))), len(languages)))
        for batch in batches:
            texts = [words_of(text) for text in batch["text"]]
            at = 0
            values, labels = [], []
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size < 50_000 or end == at):
                    size += len(texts[end])
                    end += 1
                _score_words(texts[at:end], known, scores, lattice, table)
                for found in texts[at:end]:
                    value, label = _decide(found, known, scores, languages, priors, lattice, table)
                    values.append(value)
                    labels.append(label)
                at = end
            yield {"doc_id": batch["doc_id"], "lang_pred": labels, "score": values}

    found = over_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")
    return found.withColumn("held_out", held_out("doc_id", FOLDS, HELD_OUT)).select("doc_id", "held_out", "lang_pred", "score")


def _score_words(texts: list[list[str]], known: dict[str, int], scores: np.ndarray, lattice: Lattice, table: np.ndarray) -> None:
    """Put the words of some texts into the cache; it starts anew when full."""
    if not scores.shape[1]:
        return
    new = list({w for found in texts for w in found if w not in known})
    if len(known) + len(new) > len(scores):
        known.clear()
        new = list({w for found in texts for w in found})[: len(scores)]
    base = len(known)
    for k in range(0, len(new), 20_000):
        part = new[k : k + 20_000]
        scores[base + k : base + k + len(part)] = forward(part, lattice, table)
    known.update(zip(new, range(base, base + len(new)), strict=True))


def _decide(found: list[str], known: dict, scores: np.ndarray, languages: list[str], priors: np.ndarray, lattice: Lattice, table: np.ndarray) -> tuple[float, str]:
    if not found or not languages:
        return 0.0, UNDETERMINED
    at = [known[w] for w in found if w in known]
    total = priors + scores[at].sum(0)
    if len(at) < len(found):  # a single text with more distinct words than the cache holds
        rest = list(Counter(w for w in found if w not in known).items())
        for k in range(0, len(rest), 20_000):
            part = rest[k : k + 20_000]
            total = total + np.array([n for _, n in part]) @ forward([w for w, _ in part], lattice, table)
    best = int(np.argmax(total))
    return float(1 / np.exp(total - total[best]).sum()), languages[best]
