"""Token counts by a map-side two-tier lookup.

Tier one is a compact table, broadcast once: the frequent pre-tokens of the corpus and
how many ids each has.  Tier two is a worker's own cache of what it had to encode.
Pre-tokens themselves are never shuffled: a first pass keeps a bounded summary of
frequent words per task, and only summaries meet.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.bpe import VOCABULARY, encoder
from tracelode.llm.frames import over_batches

LIMIT = 1024
FREQUENT = 50_000  # entries of the broadcast table, about 2 MB
PER_TASK = 8_192  # entries a task reports
IN_FLIGHT = 200_000  # counters a task keeps before it drops the rare half
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def frequent_words(docs: DataFrame, per_task: int = PER_TASK, most: int = FREQUENT) -> list[str]:
    """Frequent space-separated words over all documents, most frequent first, from bounded summaries of each task.

    The list decides how fast counting is, never what it returns."""

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    seen.update(text.split(" "))
                    if len(seen) > IN_FLIGHT:
                        seen = Counter(dict(seen.most_common(IN_FLIGHT // 2)))
        top = [(w, n) for w, n in seen.most_common(per_task) if 0 < len(w) <= 32]
        yield pd.DataFrame(top, columns=["word", "n"])

    counts = docs.select("text").mapInPandas(summary, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [row["word"] for row in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` ids).

    No added begin or end ids.  A null or empty text has 0 bytes and 0 tokens; repeated rows and null doc_ids are
    counted each; other columns are ignored; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, vocabulary))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        worker = encoder(vocabulary)
        frequent = shared.value
        for batch in batches:
            sizes, counts = [], []
            for text in batch["text"]:
                text = text or ""
                pieces = worker.pieces(text)
                if pieces is None:
                    count = len(worker.whole(text)) // 4
                else:
                    lengths = [frequent.get(p, 0) for p in pieces]
                    count = sum(lengths)
                    if rare := [p for p, n in zip(pieces, lengths, strict=True) if not n]:
                        held = list(map(worker.cache.get, rare))
                        if None in held:
                            found = worker.learn({p for p, ids in zip(rare, held, strict=True) if ids is None})
                            held = [found[p] if ids is None else ids for p, ids in zip(rare, held, strict=True)]
                        count += sum(map(len, held)) // 4
                sizes.append(len(text.encode()))
                counts.append(count)
            yield {"doc_id": batch["doc_id"], "n_bytes": sizes, "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return over_batches(docs.select("doc_id", "text"), run, SCHEMA)


def frequent_lengths(docs: DataFrame, vocabulary: str) -> dict[str, int]:
    """Pre-token -> number of ids, for the pre-tokens of the frequent words as they stand after a space."""
    known = encoder(vocabulary)
    pieces = {p for word in frequent_words(docs) for p in known.pieces(" " + word) or ()}
    return {p: len(ids) // 4 for p, ids in known.learn(pieces).items()}
