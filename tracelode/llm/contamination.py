"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by k edits.  Cut into k + 1
pieces, one of them must then stand in the passage unchanged.  All pieces are searched
at once by an automaton; around each hit the item is verified with Myers' bit-parallel
edit distance.  Letters and digits count; case, punctuation and white space do not.
An item too short for a single edit must stand in the passage as whole words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.frames import ddl, fresh
from tracelode.session import materialize

ERROR_RATE = 0.05  # edits allowed for each character of an item
SHORTEST = 1  # characters of an item: one without letters or digits cannot be searched
BOUNDED = 24  # characters under which an item without an edit to spare is matched as whole words only
BLOCK_CHARS = 8_000_000  # of items searched in one pass; more items take more passes

# Upper case to lower case, ASCII punctuation, symbols and control characters to spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def _fold() -> dict[str, str]:
    """Punctuation, white space and accents on their own beyond ASCII as spaces, invisible characters as nothing."""
    kinds = {chr(c): unicodedata.category(chr(c)) for c in [*range(128, 0x20000), *range(0xE0000, 0xE0200)]}
    return {c: "" if kind == "Cf" else " " for c, kind in kinds.items() if kind[0] in "PZ" or kind in ("Cc", "Cf", "Sk")}


_FOLD = _fold()
# Scripts that put no spaces between words: Thai, Lao, Tibetan, Burmese, Khmer, kana, Chinese characters.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af"
_GAPS = re.compile(f" (?<=[{_UNSPACED}] )(?=[{_UNSPACED}])")
_OPEN = re.compile(f"[ {_UNSPACED}]")


def plain(text: str | None) -> str:
    """Words in lower case with one space between; none between characters of scripts that put no spaces."""
    lower = (text or "").lower()
    folded = not lower.isascii()
    if folded:
        for c in _FOLD.keys() & set(lower):
            lower = lower.replace(c, _FOLD[c])
    words = b" ".join(lower.encode("utf-8", "surrogatepass").translate(_PLAIN).split()).decode("utf-8", "surrogatepass")
    return _GAPS.sub("", words) if folded else words


def whole(text: str, start: int, end: int) -> bool:
    """Whether a word starts at ``start`` and one ends at ``end``; any character may in scripts without spaces."""
    return (start == 0 or bool(_OPEN.match(text[start - 1]) or _OPEN.match(text[start]))) and (end == len(text) or bool(_OPEN.match(text[end]) or _OPEN.match(text[end - 1])))


def pieces(item: str, rate: float = ERROR_RATE) -> list[tuple[int, str]]:
    """The error budget plus one consecutive pieces of an item, with their offsets."""
    count = int(len(item) * rate) + 1
    edges = [len(item) * k // count for k in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False) if b > a]


class Pattern:
    """An item as bit masks, one bit for each character."""

    def __init__(self, item: str):
        self.size = len(item)
        self.masks: dict[str, int] = defaultdict(int)
        for k, c in enumerate(item):
            self.masks[c] |= 1 << k

    def distance(self, text: str, limit: int) -> int:
        """The least edit distance to any substring of ``text``, or limit + 1; stops at the first 0."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score = full, 0, self.size
        best = min(self.size, limit + 1)
        masks = self.masks
        for c in text:
            same = masks[c] if c in masks else 0
            vertical = same | down
            across = (((same & up) + up) ^ up) | same
            plus = down | (full & ~(across | up))
            minus = up & across
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
                if score < best:
                    best = score
                    if not best:
                        return 0
            plus = (plus << 1) & full
            minus = (minus << 1) & full
            up = minus | (full & ~(vertical | plus))
            down = plus & vertical
        return best


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = {key: (Pattern(item), int(len(item) * rate)) for key, item in items}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for key, item in items:
            for offset, piece in pieces(item, rate):
                places[piece].append((key, offset))
        self.finder = ahocorasick.Automaton()
        for piece, where in places.items():
            self.finder.add_word(piece, (len(piece), where))
        if places:
            self.finder.make_automaton()

    def match(self, text: str) -> list[tuple[int, int]]:
        """(item, distance) of the items that the text holds within their budget, by item."""
        if not len(self.finder):
            return []
        windows: dict[int, set[int]] = defaultdict(set)
        best: dict[int, int] = {}
        for last, (size, where) in self.finder.iter(text):
            for key, offset in where:
                if best.get(key) == 0:
                    continue
                pattern, budget = self.items[key]
                start = last - size + 1 - offset  # where the item starts if nothing before the hit was edited
                if size == pattern.size:  # the whole item
                    if budget or size >= BOUNDED or whole(text, start, last + 1):
                        best[key] = 0
                    continue
                if start in windows[key]:
                    continue
                windows[key].add(start)
                found = pattern.distance(text[max(0, start - budget) : start + pattern.size + budget], budget)
                if found <= budget:
                    best[key] = min(found, best.get(key, found))
        return sorted(best.items())


def item_blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """Items (item_id, text) in blocks small enough to be sent to every worker."""
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-2 * total // chars) if total > chars else 1
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) for k in range(count)]


def matched(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with a last column (named so that it meets no other) of the benchmark items each text holds, as item:distance
    in item order.

    Several texts of one item_id count as one item each; the least distance is reported."""
    at = docs.columns.index("text")
    held = fresh(docs, "items")
    out = docs.withColumn(held, F.array().cast("array<string>"))
    last = len(docs.columns)
    for passes, block in enumerate(item_blocks(benchmark)):
        rows = [(row["item_id"], plain(row["text"])) for row in block.collect()]
        items = [(k, text) for k, (_, text) in enumerate(rows) if len(text) >= shortest]
        shared = docs.sparkSession.sparkContext.broadcast((items, [key for key, _ in rows]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, keys = shared.value
            matcher = Matcher(items, rate)
            for batch in batches:
                lists = []
                for text, before in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True):
                    best = {int(k): int(d) for k, d in (x.split(":") for x in before)}
                    for number, distance in matcher.match(plain(text)):
                        best[keys[number]] = min(distance, best.get(keys[number], distance))
                    lists.append([f"{k}:{d}" for k, d in sorted(best.items())])
                yield batch.set_column(last, batch.schema.field(last), pa.array(lists, pa.list_(pa.string())))

        if passes:
            out = materialize(out)
        out = out.mapInArrow(run, ddl(docs, f"`{held}` array<string>"))
    return out


def find_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, items (item_id:edit distance, comma-joined by item).

    A null or empty text holds nothing; items that are null or without letters and digits are not searched; items under
    ``BOUNDED`` characters that have no edit to spare are matched as whole words; an empty benchmark finds nothing; repeated rows and null doc_ids are searched each; other columns are
    ignored; an empty table gives no rows."""
    found = matched(docs.select("doc_id", "text"), benchmark, rate)
    return found.select("doc_id", (F.size(found.columns[-1]) > 0).alias("contaminated"), F.size(found.columns[-1]).cast("long").alias("n_items"), F.array_join(found.columns[-1], ",").alias("items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no benchmark item.

    A row with a null or empty text stays; repeated rows and null doc_ids are judged each; very long texts are searched whole;
    columns of any name are kept; an empty table stays empty."""
    found = matched(docs, benchmark, rate)
    return found.filter(F.size(F.col(f"`{found.columns[-1]}`")) == 0).select(*(F.col(f"`{name}`") for name in docs.columns))
