"""Repeated byte strings by suffix arrays over shards of the corpus.

Every string of ``length`` bytes belongs to the least hash among its ``GRAM``-byte
grams, wherever it occurs, so equal strings meet in one shard and no string is in two.
Strings of a text that follow each other and have the same least hash form one slice.

1. Hashes that occur in two documents or more are found from packed (hash, document)
   records; nothing else can be repeated.
2. Slices of those hashes go to their shard.  A shard sorts its distinct slices by the
   two-stage method, compares neighbours in the array, and knows for each string the
   least document that holds it.
3. Spans found return to their documents, which are cut and hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm.frames import membership, over_batches, scatter, shuffle_width
from tracelode.llm.shingles import mixed
from tracelode.session import materialize

LENGTH = 50
GRAM = 16
SLICE_STRINGS = 256  # strings of one slice at most
BUFFER = 500_000  # records a worker packs at a time
SHARD_RECORDS = 1_000_000
SHARD_SLICES = 40_000  # about 3 MB of text
DOC_BUCKET = 20_000
CODE_BITS = 9
WORD = 7  # codes in one 63-bit key

MARK = np.dtype([("mark", "<u4"), ("doc", "<i8")])
SPAN = np.dtype([("doc", "<i8"), ("start", "<i8"), ("end", "<i8")])
OWNED = np.dtype([("doc", "<i8"), ("mark", "<u8")])
PLACE = np.dtype([("doc", "<i8"), ("pos", "<i8"), ("slice", "<u4")])


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` codes at least.

    Two-stage sorting: a suffix smaller than its successor is sorted directly; any other starts with a run of its first
    code and takes its place, when the buckets are scanned in order, from the suffix behind the run, which is in an
    earlier bucket.  ``codes`` are 0..256 and end with 0."""
    codes = codes.astype(np.int64)
    n = len(codes)
    change = np.flatnonzero(np.r_[codes[1:] != codes[:-1], True])
    run_end = change[np.searchsorted(change, np.arange(n))]  # last position of the run a suffix starts with
    after = np.minimum(run_end + 1, n - 1)
    direct = (codes[run_end] < codes[after]) & (run_end < n - 1)

    keys = word_keys(codes)
    place = np.flatnonzero(direct)
    place = place[np.argsort(keys[place])]
    key = keys[place]
    tied = np.r_[key[1:] == key[:-1], False]
    for step in range(WORD, depth, WORD):
        if not tied.any():
            break
        open_ = np.flatnonzero(tied | np.r_[False, tied[:-1]])
        head = np.r_[True, ~tied[:-1]][open_]
        group = np.cumsum(head)
        key = keys[np.minimum(place[open_] + step, n - 1)]
        order = np.lexsort((key, group))
        place[open_] = place[open_][order]
        key = key[order]
        still = np.zeros(len(tied), bool)
        still[open_[:-1]] = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
        tied = still

    rank = np.empty(n, np.int64)
    array = np.empty(n, np.int64)
    rest = np.flatnonzero(~direct)
    rest = rest[np.argsort(codes[rest], kind="stable")]
    direct_ends = np.searchsorted(codes[place], np.arange(258))
    rest_ends = np.searchsorted(codes[rest], np.arange(258))
    filled = 0
    for code in range(257):
        induced = rest[rest_ends[code] : rest_ends[code + 1]]
        if code == 0:  # separators have no order of their own
            ordered = induced
        else:
            run = run_end[induced] - induced
            ordered = induced[np.argsort(run * n + rank[after[induced]])]
        for block in (ordered, place[direct_ends[code] : direct_ends[code + 1]]):
            array[filled : filled + len(block)] = block
            rank[block] = np.arange(filled, filled + len(block))
            filled += len(block)
    return array


def word_keys(codes: np.ndarray) -> np.ndarray:
    """The first WORD codes of every suffix as one integer."""
    padded = np.r_[codes, np.zeros(WORD, np.int64)].astype(np.int64)
    key = np.zeros(len(codes), np.int64)
    for k in range(WORD):
        key = (key << CODE_BITS) | padded[k : k + len(codes)]
    return key


def common_prefixes(codes: np.ndarray, array: np.ndarray, depth: int) -> np.ndarray:
    """Codes that each suffix of ``array`` shares with the one before it, ``depth`` at most; the first shares none."""
    keys = word_keys(codes)
    shared = np.zeros(len(array), np.int64)
    if len(array) < 2:
        return shared
    at = np.arange(1, len(array))
    left, right = array[:-1], array[1:]
    for step in range(0, depth, WORD):
        x, y = (keys[np.minimum(side + step, len(codes) - 1)] for side in (left, right))
        differ = x ^ y
        # Equal leading codes of the two keys, from the highest bit in which they differ.
        high = np.frexp(differ.astype(np.float64))[1]
        # Rounding up to the next power of two can only happen across a full code boundary's top bit; settle it exactly.
        high = np.where((differ > 0) & ((differ >> np.minimum(np.maximum(high - 1, 0), 62)) == 0), high - 1, high)
        same = np.where(differ == 0, WORD, (WORD * CODE_BITS - high) // CODE_BITS)
        shared[at] = np.minimum(step + same, depth)
        go = differ == 0
        if not go.any():
            break
        at, left, right = at[go], left[go], right[go]
    return shared


def anchors(data: np.ndarray, length: int, gram: int = GRAM) -> np.ndarray:
    """For each string of ``length`` bytes, the least hash among its grams."""
    count = len(data) - gram + 1
    codes = data.astype(np.uint64)
    hashed = np.zeros(count, np.uint64)
    for k in range(gram):
        hashed = hashed * np.uint64(0x100000001B3) + codes[k : k + count]
    least = mixed(hashed)
    width, reach = 1, length - gram + 1
    while width < reach:
        step = min(width, reach - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def runs(values: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of equal neighbours, cut to ``longest``."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    ends = np.r_[starts[1:], len(values)]
    if longest is not None and (ends - starts).max(initial=0) > longest:
        parts = -(-(ends - starts) // longest)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends = np.repeat(starts, parts) + step * longest, np.repeat(ends, parts)
        ends = np.minimum(ends, starts + longest)
    return starts, ends


def squeezed(records: np.ndarray) -> bytes:
    """Records as compressed planes of bytes: constant and slowly growing bytes take no room."""
    return zstandard.compress(np.ascontiguousarray(records.view(np.uint8).reshape(len(records), -1).T).tobytes(), 3)


def expanded(packed: list[bytes], kind: np.dtype) -> np.ndarray:
    width = kind.itemsize
    parts = [np.frombuffer(zstandard.decompress(p), np.uint8).reshape(width, -1).T for p in packed]
    return np.array(np.concatenate(parts), order="C").view(kind).ravel()


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _dealt(records: np.ndarray, groups: int) -> pd.DataFrame:
    """Records by a hash of their document, in document order, squeezed."""
    records = records[np.argsort(records["doc"], kind="stable")]
    out = scatter(records, (mixed(records["doc"].astype(np.uint64)) % np.uint64(groups)).astype(np.int64))
    out["packed"] = [squeezed(np.frombuffer(p, records.dtype)) for p in out["packed"]]
    return out


def _shared_marks(docs: DataFrame, length: int, buckets: int, groups: int) -> DataFrame:
    """(doc, held, marks) of hashes that two documents or more have; a mark is the bucket and the low half of the hash."""

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = _bytes(text)
                if len(data) >= length:
                    found = np.unique(anchors(np.frombuffer(data, np.uint8), length))
                    held.append((doc, found))
                    size += len(found)
                    if size >= BUFFER:
                        yield packed(held)
                        held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list) -> pd.DataFrame:
        found = np.concatenate([f for _, f in held])
        record = np.empty(len(found), MARK)
        record["mark"] = found & np.uint64(0xFFFFFFFF)
        record["doc"] = np.repeat(np.array([d for d, _ in held], np.int64), [len(f) for _, f in held])
        out = scatter(record, ((found >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
        # Columns after each other compress far better than records.
        out["packed"] = [x["mark"].tobytes() + x["doc"].tobytes() for x in (np.frombuffer(p, MARK) for p in out["packed"])]
        return out

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(p) // MARK.itemsize for p in pdf["packed"]]
        mark = np.concatenate([np.frombuffer(p, "<u4", n) for p, n in zip(pdf["packed"], sizes, strict=True)])
        doc = np.concatenate([np.frombuffer(p, "<i8", n, 4 * n) for p, n in zip(pdf["packed"], sizes, strict=True)])
        order = np.argsort(mark, kind="stable")
        mark, doc = mark[order], doc[order]
        starts, ends = runs(mark)
        differ = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        keep = np.repeat(differ, ends - starts)
        owned = np.empty(int(keep.sum()), OWNED)
        owned["doc"] = doc[keep]
        owned["mark"] = (np.uint64(pdf["bucket"].iloc[0]) << np.uint64(32)) | mark[keep].astype(np.uint64)
        return _dealt(owned, groups)

    def by_doc(pdf: pd.DataFrame) -> pd.DataFrame:
        owned = expanded(list(pdf["packed"]), OWNED)
        owned = owned[np.argsort(owned["doc"], kind="stable")]
        starts, ends = runs(owned["doc"])
        return pd.DataFrame({"doc": owned["doc"][starts], "held": ends - starts, "marks": [squeezed(np.sort(owned["mark"][a:b])) for a, b in zip(starts, ends, strict=True)]})

    rows = docs.filter("doc_id is not null").mapInPandas(marks, "bucket long, packed binary")
    shared_rows = rows.groupBy("bucket").applyInPandas(shared, "bucket long, packed binary")
    return shared_rows.groupBy("bucket").applyInPandas(by_doc, "doc long, held long, marks binary")


def _slices(texts: DataFrame, length: int, buckets: int, shards: int) -> DataFrame:
    """Packed slices of each shard; ``texts`` (compressed) carry the marks of their document."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, int] = {}
        where: list[np.ndarray] = []
        home: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for doc, body, marks in zip(batch["doc_id"], batch["body"], batch["marks"], strict=True):
                data = zstandard.decompress(body)
                if len(data) < length:
                    continue
                least = anchors(np.frombuffer(data, np.uint8), length)
                starts, ends = runs(least, SLICE_STRINGS)
                head = least[starts]
                wanted = expanded([marks], np.dtype("<u8"))
                own = (((head >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (head & np.uint64(0xFFFFFFFF))
                keep = np.isin(own, wanted)
                starts, ends, head = starts[keep], ends[keep], head[keep]
                place = np.empty(len(starts), PLACE)
                place["doc"], place["pos"] = doc, starts
                place["slice"] = [held.setdefault(data[a:b], len(held)) for a, b in zip(starts.tolist(), (ends + length - 1).tolist(), strict=True)]
                where.append(place)
                home.append((mixed(head) % np.uint64(shards)).astype(np.int64))
                size += len(place)
                if size >= BUFFER // 4:
                    yield packed(held, where, home)
                    held, where, home, size = {}, [], [], 0
        if where:
            yield packed(held, where, home)

    def packed(held: dict[bytes, int], where: list, home: list) -> pd.DataFrame:
        place, shard = np.concatenate(where), np.concatenate(home)
        texts = list(held)
        order = np.lexsort((place["slice"], shard))
        place, shard = place[order], shard[order]
        rows = []
        for a, b in zip(*runs(shard), strict=True):
            used, local = np.unique(place["slice"][a:b], return_inverse=True)
            part = place[a:b].copy()
            part["slice"] = local
            bodies = [texts[k] for k in used]
            rows.append((int(shard[a]), zstandard.compress(b"".join(bodies), 3), np.array([len(x) for x in bodies], "<u4").tobytes(), squeezed(part)))
        return pd.DataFrame(rows, columns=["shard", "bodies", "sizes", "places"])

    return texts.mapInPandas(cut, "shard long, bodies binary, sizes binary, places binary")


def shard_spans(bodies: list[bytes], place: np.ndarray, length: int) -> np.ndarray:
    """Spans (doc, start, end) of a shard that also start in a smaller document, from distinct slices and where they are."""
    least_doc = np.full(len(bodies), np.iinfo(np.int64).max)
    np.minimum.at(least_doc, place["slice"], place["doc"])
    sizes = np.array([len(b) for b in bodies], np.int64)
    codes = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64) + 1
    offsets = np.cumsum(sizes) - sizes
    text = np.zeros(len(codes) + len(bodies), np.int64)  # a 0 closes each slice
    owner = np.repeat(np.arange(len(bodies)), sizes)
    text[np.arange(len(codes)) + owner] = codes
    begin = offsets + np.arange(len(bodies))

    array = suffix_array(text, length + WORD)
    slice_of = np.repeat(np.arange(len(bodies)), sizes + 1)
    left = (begin + sizes)[slice_of] - np.arange(len(text))  # codes before the slice ends
    array = array[left[array] >= length]
    shared = common_prefixes(text, array, length)
    first = np.flatnonzero(shared < length)
    least = np.minimum.reduceat(least_doc[slice_of[array]], first)
    string_least = np.full(len(text), np.iinfo(np.int64).max)
    string_least[array] = np.repeat(least, np.diff(np.r_[first, len(array)]))

    # Later documents of a slice lose all of it; its first one what smaller documents have in other slices.
    later = place["doc"] > least_doc[place["slice"]]
    out = np.empty(int(later.sum()), SPAN)
    out["doc"], out["start"] = place["doc"][later], place["pos"][later]
    out["end"] = out["start"] + sizes[place["slice"][later]]
    covered = string_least < least_doc[slice_of]
    edge = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
    starts, ends = edge[::2], edge[1::2]
    runs_of = slice_of[starts]  # runs never reach over the closing 0, where no string starts
    firsts = place[~later]
    firsts = firsts[np.argsort(firsts["slice"], kind="stable")]
    low, high = np.searchsorted(firsts["slice"], runs_of), np.searchsorted(firsts["slice"], runs_of, side="right")
    many = high - low
    pick = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    more = np.empty(len(pick), SPAN)
    shift = np.repeat(begin[runs_of], many)
    more["doc"] = firsts["doc"][pick]
    more["start"] = firsts["pos"][pick] + np.repeat(starts, many) - shift
    more["end"] = firsts["pos"][pick] + np.repeat(ends, many) - shift + length - 1
    return np.concatenate([out, more])


def _found(slices: DataFrame, length: int, groups: int) -> DataFrame:
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[bytes, int] = {}
        places = []
        for body, sizes, packed in zip(pdf["bodies"], pdf["sizes"], pdf["places"], strict=True):
            ends = np.cumsum(np.frombuffer(sizes, "<u4")).tolist()
            body = zstandard.decompress(body)
            local = np.array([held.setdefault(body[a:b], len(held)) for a, b in zip([0, *ends], ends)], np.uint32)
            place = expanded([packed], PLACE)
            place["slice"] = local[place["slice"]]
            places.append(place)
        found = shard_spans(list(held), np.concatenate(places), length)
        return _dealt(found, groups)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, start, end = merge_spans(expanded(list(pdf["packed"]), SPAN))
        firsts, lasts = runs(doc) if len(doc) else (doc, doc)
        return pd.DataFrame({"doc": doc[firsts], "spans": [np.c_[start[a:b], end[a:b]].ravel() for a, b in zip(firsts, lasts, strict=True)]})

    return slices.groupBy("shard").applyInPandas(search, "bucket long, packed binary").groupBy("bucket").applyInPandas(merged, "doc long, spans array<long>")


def merge_spans(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a document as one."""
    if not len(span):
        return span["doc"], span["start"], span["end"]
    span = span[np.lexsort((span["start"], span["doc"]))]
    firsts, lasts = runs(span["doc"])
    base = np.repeat(np.arange(len(firsts)), lasts - firsts) * (int(span["end"].max()) + 1)
    reach = np.maximum.accumulate(span["end"] + base)
    new = np.r_[True, (span["start"] + base)[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return span["doc"][at], span["start"][at], (reach - base)[np.r_[at[1:] - 1, len(span) - 1]]


def text_digest() -> Column:
    return F.unhex(F.md5("text"))


def whole_copies(docs: DataFrame) -> DataFrame:
    """(doc, digest) of documents whose whole text is that of a document with a smaller doc_id."""
    named = docs.filter("doc_id is not null and text is not null").select("doc_id", text_digest().alias("digest"))
    least = named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first")
    return named.join(least, "digest").filter("doc_id > first").select(F.col("doc_id").alias("doc"), "digest").distinct()


def without_copies(docs: DataFrame, copies: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """Rows that are not whole copies, and the test for doc_ids that may be of copies.

    Which rows of those doc_ids stay is settled by digests; only texts of rows that stay (a doc_id may stand for several
    texts) are shuffled, not those of the copies."""
    copied = membership(copies, "doc")
    suspects = docs.filter(copied("doc_id")).withColumn("_own", text_digest())
    others = suspects.select(F.col("doc_id").alias("_other"), F.col("_own").alias("_text")).distinct()
    others = materialize(others.join(copies, (F.col("_other") == F.col("doc")) & (F.col("_text") == F.col("digest")), "left_anti"))
    stay = suspects.filter(membership(others, "_other")("doc_id"))
    stay = stay.join(others, F.col("doc_id").eqNullSafe(F.col("_other")) & F.col("_own").eqNullSafe(F.col("_text")), "left_semi")
    return docs.filter(~copied("doc_id")).unionByName(stay.select("doc_id", "text")), copied


def compressed(docs: DataFrame) -> DataFrame:
    """(doc_id, body): texts as compressed bytes for a shuffle, which packs them better than the blocks of a shuffle are packed."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "body": [pack(_bytes(text)) for text in batch["text"]]}

    return over_batches(docs.select("doc_id", "text"), run, "doc_id long, body binary")


def with_spans(docs: DataFrame, distinct: DataFrame, length: int) -> tuple[DataFrame, Callable[[str], Column]]:
    """(doc_id, body, spans) of documents that may hold repeated strings, and the test for those; ``body`` is the compressed
    text, spans are start, end, start, end ... in bytes.  ``distinct``: ``docs`` without whole copies.

    Texts are shuffled once: the search for spans and their return to the texts read the same partitions."""
    width = shuffle_width(docs)
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    buckets = max(2 * width, (size[0] or 0) // 18 // SHARD_RECORDS + 1)
    groups = max(2 * width, size[1] // DOC_BUCKET + 1)
    shared = materialize(_shared_marks(distinct, length, buckets, groups))
    slices = shared.agg(F.sum("held")).first()[0] or 0
    shards = max(2 * width, slices // SHARD_SLICES + 1)
    may_share = membership(shared, "doc")
    texts = compressed(distinct.filter("doc_id is not null").filter(may_share("doc_id")))
    texts = texts.filter("doc_id is not null").repartition(width, "doc_id")  # the filter an inner join adds, so that both uses share one shuffle
    marked = texts.join(shared, F.col("doc_id") == F.col("doc")).select("doc_id", "body", "marks")
    found = _found(_slices(marked, length, buckets, shards), length, groups)
    return texts.join(found, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "body", "spans"), may_share


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, without bytes that a string of ``length`` bytes covers
    which also starts in a document with a smaller doc_id.

    A null or empty text has no bytes; a text shorter than ``length`` keeps all; repeated rows with one doc_id are no
    smaller than each other, and keep each what no smaller document has; a row without doc_id keeps all and removes
    nothing elsewhere; other columns are ignored; an empty table gives no rows.

    A whole copy of a smaller document is removed whole and stays out of the search: its strings are all in the other."""
    docs = docs.select("doc_id", "text")
    copies = materialize(whole_copies(docs))
    distinct, copied = without_copies(docs, copies)
    cut, may_share = with_spans(docs, distinct, length)
    none = F.lit(None).cast("array<long>")
    plain = distinct.filter(F.col("doc_id").isNull() | ~may_share("doc_id")).withColumn("spans", none)

    # A copy is either gone or too short for a string: its row needs no text, so none is shuffled.
    size, long = F.octet_length("text").cast("long"), F.octet_length("text") >= length
    gone = docs.filter(copied("doc_id")).select(
        "doc_id", size.alias("n_bytes"), F.when(long, size).otherwise(0).alias("n_removed"), F.when(long, F.lit(1)).otherwise(0).cast("long").alias("n_spans"),
        F.sha2(F.when(long, F.lit("")).otherwise(F.col("text")).cast("binary"), 256).alias("kept_sha256"), text_digest().alias("_own"),
    )
    gone = gone.join(copies, (F.col("doc_id") == F.col("doc")) & (F.col("_own") == F.col("digest")), "left_semi").drop("_own")

    def kept(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            rows = []
            for text, body, spans in zip(batch["text"], batch["body"], batch["spans"], strict=True):
                data = _bytes(text) if body is None else zstandard.decompress(body)
                edges = spans or []
                rest = memoryview(data)
                digest = hashlib.sha256()
                at = 0
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    digest.update(rest[at:a])
                    at = b
                digest.update(rest[at:])
                removed = sum(edges[1::2]) - sum(edges[::2])
                rows.append((len(data), removed, len(edges) // 2, digest.hexdigest()))
            yield {"doc_id": batch["doc_id"]} | dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), map(list, zip(*rows, strict=True)), strict=True))

    rows = plain.withColumn("body", F.lit(None).cast("binary")).unionByName(cut.withColumn("text", F.lit(None).cast("string")))
    return over_batches(rows, kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").unionByName(gone)
