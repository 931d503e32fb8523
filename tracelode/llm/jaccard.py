"""N-gram Jaccard join over a token-group matrix.

Documents of one shingle set are a class.  Classes with the same least shingle form a
group.  The matrix holds, for each group, the union of its members' leading shingles
and a hashed bitmap of the union of all of them.

1. Classes are compared with one class of each of their sketch groups; verified links
   join near copies early, so a group of thousands costs as many comparisons as
   it has members.
2. Two groups qualify when a shingle leads in both and what may follow it is long
   enough for the wanted overlap; groups of long sets, whose bitmaps are full, must
   share as many leading shingles as that overlap takes.  Shingles that many documents share come last in the
   order and therefore hardly ever lead.
3. A qualifying group is opened only for members whose overlap with the other group's
   union bitmap can reach the threshold, and only between different components.
4. What is left is verified on the full shingle sets, rebuilt from the texts: single
   pairs one by one, members of large groups block against block, so that no pairs of a
   group are emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm.components import components
from tracelode.llm.frames import ddl, fresh, membership, scatter, shuffle_width, trim, trimmed
from tracelode.llm.shingles import WORDS, column_shingles, mixed
from tracelode.session import materialize

PERCENT = 75
FREQUENT = 200_000  # shingles known to be common; only their place in the order depends on it
COMMON = 8  # counted times that make a shingle common
BAND = 1.25  # sizes of one band of sketch groups differ by less than this factor
LANES = 32  # longs of a bitmap: 2,048 hashed positions
GROUP_MASK = np.uint64((1 << 40) - 1)  # bits that name a group; groups of one name are one group
LONG = 512  # shingles beyond which a bitmap tells little and pairs of groups count the leading shingles they share
SLACK = 10  # shared shingles that may go uncounted: rounding, and two that fall in one cell
BUFFER = 300_000  # shingles a worker collects before it packs them
COUNTED = 1_000_000  # shingles a worker counts together
SEEN = 2  # times that make a shingle of those worth reporting
PER_BUCKET = 400_000
BLOCK = 512  # classes of a host, and guests, that one task compares
CELL = np.dtype([("token", "<u4"), ("least", "<u4"), ("most", "<u4"), ("rest", "<u4"), ("group", "<u8")])
BITS = [f"b{k}" for k in range(LANES)]


def over_sets(docs: DataFrame, words: int, finish, schema: str) -> DataFrame:
    """``finish`` over (doc_id, shingles) of all documents."""

    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), column_shingles(batch.column(1), words), strict=True))
        for out in trimmed(finish(sets)):
            yield pa.RecordBatch.from_pandas(out, fields, preserve_index=False)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """Common shingles, the more common later, and the number of all; from per-task counts of those seen often there."""

    def counted(sets) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = total = 0
        for _, tokens in sets:
            held.append(tokens)
            size += len(tokens)
            total += len(tokens)
            if size > COUNTED:
                yield often(held)
                held, size = [], 0
        if held:
            yield often(held)
        yield pd.DataFrame({"token": pd.array([None], "Int64"), "n": [total]})

    def often(held: list[np.ndarray]) -> pd.DataFrame:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"token": pd.array(tokens[n >= SEEN].view(np.int64), "Int64"), "n": n[n >= SEEN]})

    seen = over_sets(docs, words, counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    seen = materialize(seen.filter(F.col("token").isNull() | (F.col("n") >= COMMON)))
    total = seen.filter("token is null").agg(F.sum("n")).first()[0]
    top = seen.filter("token is not null").orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toPandas()["token"]
    return np.ascontiguousarray(top.to_numpy(np.int64)[::-1]).view(np.uint64), int(total or 0)


class Order:
    """The global order of shingles: by hash, the common ones last."""

    def __init__(self, common: np.ndarray):
        self.sorted = np.sort(common)
        self.rank = np.argsort(common, kind="stable")

    def common(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each token is common, and its place in the table."""
        if not len(self.sorted):
            return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, tokens), len(self.sorted) - 1)
        return self.sorted[at] == tokens, at

    def leading(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """The tokens of which a linked set must hold one, in order; ``tokens`` ascend."""
        common, at = self.common(tokens)
        keep = len(tokens) - -(-percent * len(tokens) // 100) + 1
        plain = tokens[~common]
        if len(plain) >= keep:
            return plain[:keep]
        rest = tokens[common][np.argsort(self.rank[at[common]], kind="stable")]
        return np.r_[plain, rest[: keep - len(plain)]]

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """Three sketch keys; the first names the group.  Common shingles say little about a text unless it has hardly any other:
        then it is one of many near copies, which only those shingles hold together."""
        common, _ = self.common(tokens)
        plain = tokens[~common] if 2 * common.sum() < len(tokens) else tokens
        other = mixed(plain * np.uint64(0xD6E8FEB86659FD93))
        every = mixed(tokens * np.uint64(0xCA5A826395121157))
        return np.array([plain[0] & GROUP_MASK, mixed(np.atleast_1d(other.min()) + np.uint64(1))[0], mixed(np.atleast_1d(every.min()) + np.uint64(2))[0]], np.uint64)


def class_of(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(LANES * 64, np.uint8)
    bits[(mixed(tokens) >> np.uint64(40)).astype(np.int64) % (LANES * 64)] = 1
    return np.packbits(bits).view(np.int64)


def summaries(docs: DataFrame, words: int, order) -> DataFrame:
    """One row per document: doc_id, n, cls, three keys, bitmap."""

    def rows(sets) -> Iterator[pd.DataFrame]:
        keys, sizes, names, numbers = [], [], [], []
        for key, tokens in sets:
            keys.append(key)
            sizes.append(len(tokens))
            names.append(class_of(tokens) if len(tokens) else None)
            numbers.append(np.r_[order.value.keys(tokens).view(np.int64), bitmap(tokens)] if len(tokens) else empty)
            if len(keys) >= 2_000:
                yield frame(keys, sizes, names, numbers)
                keys, sizes, names, numbers = [], [], [], []
        yield frame(keys, sizes, names, numbers)

    empty = np.zeros(3 + LANES, np.int64)

    def frame(keys: list, sizes: list, names: list, numbers: list) -> pd.DataFrame:
        out = pd.DataFrame(np.array(numbers, np.int64).reshape(-1, 3 + LANES), columns=["k0", "k1", "k2", *BITS])
        out.insert(0, "doc_id", pd.array(keys, "Int64"))
        out.insert(1, "n", np.array(sizes, np.int64))
        out.insert(2, "cls", pd.Series(names, dtype=object))
        return out

    return over_sets(docs, words, rows, "doc_id long, n long, cls binary, k0 long, k1 long, k2 long, " + ", ".join(f"{b} long" for b in BITS))


def qualifying_groups(docs: DataFrame, words: int, percent: int, order, buckets: int) -> DataFrame:
    """Pairs of groups (g, h), g < h, that share a leading shingle and may hold a link."""

    def cells(sets) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        place: list[np.ndarray] = []
        size = 0
        for _, tokens in sets:
            if not len(tokens):
                continue
            lead = order.value.leading(tokens, percent)
            cell = np.zeros(len(lead), CELL)
            cell["token"], cell["group"] = lead & np.uint64(0xFFFFFFFF), order.value.keys(tokens)[0]
            place.append(((lead >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
            cell["least"] = cell["most"] = len(tokens)
            cell["rest"] = len(tokens) - np.arange(len(lead))
            held.append(cell)
            size += len(cell)
            if size > BUFFER:
                yield merged(held, place)
                held, place, size = [], [], 0
        if held:
            yield merged(held, place)

    def merged(held: list[np.ndarray], place: list[np.ndarray]) -> pd.DataFrame:
        out = scatter(np.concatenate(held), np.concatenate(place))
        out["packed"] = [_planes(_unions(np.frombuffer(p, CELL))) for p in out["packed"]]
        return out

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = _unions(np.concatenate([_cells(p) for p in pdf["packed"]]))
        token = cell["token"]
        firsts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        counts = np.diff(np.r_[firsts, len(token)])
        found = [np.zeros((0, 5), np.int64)]
        for step in range(1, int(counts.max(initial=1))):  # cells ``step`` apart in the run of a token
            left = np.flatnonzero(token[step:] == token[:-step])
            if not len(left):
                break
            a, b = cell[left], cell[left + step]
            least, most = (np.c_[a[name], b[name]].astype(np.int64) for name in ("least", "most"))
            need = -(-percent * least.sum(1) // (100 + percent))
            good = np.minimum(a["rest"], b["rest"]) >= need
            # Long sets count every shared leading shingle, also those that alone could not make a link.
            keep = (100 * most.min(1) >= percent * least.max(1)) & (good | (most.min(1) > LONG))
            if keep.any():
                fewest = np.minimum(least_shared(most[:, 0], least[:, 1], percent), least_shared(least[:, 0], most[:, 1], percent))
                wanted = np.where(least.min(1) > LONG, fewest, 0)
                found.append(_tallied(np.c_[a["group"].view(np.int64), b["group"].view(np.int64), np.ones(len(a), np.int64), good, wanted][keep]))
        out = pd.DataFrame(_tallied(np.concatenate(found)), columns=["g", "h", "shared", "good", "wanted"])
        trim()
        return out

    packed = over_sets(docs, words, cells, "bucket long, packed binary")
    met = packed.groupBy("bucket").applyInPandas(pairs, "g long, h long, shared long, good long, wanted long")
    met = met.groupBy("g", "h").agg(F.sum("shared").alias("shared"), F.max("good").alias("good"), F.min("wanted").alias("wanted"))
    return met.filter("good = 1 and shared >= wanted").select("g", "h")


def least_shared(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """How many leading shingles linked sets of these sizes share at least, less ``SLACK``.

    The set whose leading shingles end first in the order has ceil(percent * size / 100) - 1 others; what the overlap wants beyond
    those is shared among the leading ones of both."""
    need = -(-percent * (n + m) // (100 + percent))
    return need - (-(-percent * np.maximum(n, m) // 100) - 1) - SLACK


def _tallied(rows: np.ndarray) -> np.ndarray:
    """(g, h, shared, good, wanted): one row for each pair of groups, with the sum, the greatest and the least."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])
    return np.c_[rows[first, :2], np.add.reduceat(rows[:, 2], first), np.maximum.reduceat(rows[:, 3], first), np.minimum.reduceat(rows[:, 4], first)]


def _planes(cell: np.ndarray) -> bytes:
    """Cells as planes of bytes, which compress better than records: sizes are small and mostly equal."""
    narrow = cell.copy()
    narrow["most"] -= cell["least"]
    narrow["rest"] = cell["most"] - cell["rest"]
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(narrow.view(np.uint8).reshape(-1, CELL.itemsize).T).tobytes())


def _cells(planes: bytes) -> np.ndarray:
    planes = zstandard.ZstdDecompressor().decompress(planes)
    cell = np.array(np.frombuffer(planes, np.uint8).reshape(CELL.itemsize, -1).T, order="C").view(CELL).ravel()
    cell["most"] += cell["least"]
    cell["rest"] = cell["most"] - cell["rest"]
    return cell


def _unions(cell: np.ndarray) -> np.ndarray:
    """One cell for each token and group, in that order, with the range of sizes and the longest rest."""
    if not len(cell):
        return cell
    cell = cell[np.lexsort((cell["group"], cell["token"]))]
    first = np.flatnonzero(np.r_[True, (cell["token"][1:] != cell["token"][:-1]) | (cell["group"][1:] != cell["group"][:-1])])
    out = cell[first].copy()
    out["least"] = np.minimum.reduceat(cell["least"], first)
    out["most"] = np.maximum.reduceat(cell["most"], first)
    out["rest"] = np.maximum.reduceat(cell["rest"], first)
    return out


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough, from the texts of one document each."""
    named = classes.select("cls", "doc")
    pairs = pairs.select("a", "b").distinct()
    pairs = pairs.join(named.select(F.col("cls").alias("a"), F.col("doc").alias("p")), "a").join(named.select(F.col("cls").alias("b"), F.col("doc").alias("q")), "b")
    pairs = materialize(pairs)

    def texts(doc: str, text: str) -> DataFrame:
        found = docs.filter(membership(pairs, doc)("doc_id"))
        return found.select(F.col("doc_id").alias(f"_{doc}"), F.col("text").alias(text))

    both = pairs.join(texts("p", "x"), F.col("p").eqNullSafe(F.col("_p"))).select("a", "b", "q", "x")
    both = both.join(texts("q", "y"), F.col("q").eqNullSafe(F.col("_q"))).select("a", "b", "x", "y")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column_shingles(batch.column(2), words), column_shingles(batch.column(3), words), strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                # A doc_id may stand for several texts; only those of the two classes count.
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared) and class_of(x) == a and class_of(y) == b)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        trim()

    return both.mapInArrow(linked, "a binary, b binary").distinct()


def _missing(one: str, other: str) -> Column:
    """Set bits of one bitmap that the other lacks: as many shingles at least are not shared."""
    return sum((F.bit_count(F.col(f"{one}_{b}").bitwiseAND(F.bitwise_not(F.col(f"{other}_{b}")))) for b in BITS), F.lit(0))


def _side(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def _sizes_allow(one: str, other: str, percent: int) -> Column:
    return (100 * F.col(one) >= percent * F.col(other)) & (100 * F.col(other) >= percent * F.col(one))


def opened(docs: DataFrame, classes: DataFrame, pairs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between classes of different components in qualifying groups (g, h).

    ``members``: cls, doc, g, root, n, bitmap.  Two groups of one class each are compared directly.  Of other pairs the
    larger group is the host and members of the smaller are guests if their overlap with the host's union can reach the
    threshold; members of a host that spans components are guests of their own group."""
    unions = materialize(
        members.groupBy("g").agg(
            F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("cls").alias("cls"), F.min("root").alias("root"),
            F.max("root").alias("other"), *[F.expr(f"bit_or({b})").alias(b) for b in BITS],
        )
    )
    slim = ["g", "size", "least", "most", "cls", "root", "other"]
    met = pairs.join(_side(unions, "x", slim), F.col("g") == F.col("x_g")).join(_side(unions, "y", slim), F.col("h") == F.col("y_g"))
    met = met.filter((100 * F.col("x_most") >= percent * F.col("y_least")) & (100 * F.col("y_most") >= percent * F.col("x_least")))
    # Groups that lie in one and the same component have nothing to find.
    met = met.filter((F.col("x_root") != F.col("y_root")) | (F.col("x_root") != F.col("x_other")) | (F.col("y_root") != F.col("y_other")))
    single = (F.col("x_size") == 1) & (F.col("y_size") == 1)
    fits = ((100 - percent) * F.col("x_least") >= 100 * _missing("x", "y")) & ((100 - percent) * F.col("y_least") >= 100 * _missing("y", "x"))
    # Bitmaps only meet pairs that sizes and components let through; each side brings its own once.
    met = materialize(met.select("g", "h", "x_size", "y_size", "x_least", "y_least", "x_cls", "y_cls"))
    bits = ["g", *BITS]
    alone = met.filter(single).join(_side(unions, "x", bits), F.col("g") == F.col("x_g")).join(_side(unions, "y", bits), F.col("h") == F.col("y_g"))
    direct = alone.filter(fits).select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b"))

    larger = F.col("x_size") >= F.col("y_size")
    hosted = met.filter(~single).select(F.when(larger, F.col("g")).otherwise(F.col("h")).alias("host"), F.when(larger, F.col("h")).otherwise(F.col("g")).alias("guest"))
    mine = ["g", "cls", "n", *BITS]
    guests = hosted.join(_side(members, "a", mine), F.col("guest") == F.col("a_g")).join(_side(unions, "y", bits), F.col("host") == F.col("y_g"))
    guests = guests.filter((100 - percent) * F.col("a_n") >= 100 * _missing("a", "y")).select("host", F.col("a_cls").alias("cls"))
    own = members.join(unions.filter("size > 1 and root <> other").select("g"), "g", "left_semi").select(F.col("g").alias("host"), "cls")
    guests = materialize(guests.unionByName(own).distinct())
    return verified(docs, classes, direct, words, percent).unionByName(_hosted(docs, guests, members, words, percent))


def _hosted(docs: DataFrame, guests: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between the members of each host and its guests, block by block; a task holds two blocks of texts."""
    sizes = members.join(guests.select(F.col("host").alias("g")).distinct(), "g", "left_semi").groupBy("g").agg(F.count("*").alias("held"))
    invited = guests.groupBy("host").agg(F.count("*").alias("invited"))
    blocks = lambda name: F.ceil(F.col(name) / BLOCK).cast("int")
    plan = materialize(sizes.join(invited, F.col("g") == F.col("host")).select("host", blocks("held").alias("p"), blocks("invited").alias("q")))
    spot = lambda parts: F.pmod(F.xxhash64("cls"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    held = members.select(F.col("g").alias("host"), "cls").join(plan, "host").select("host", "cls", F.lit(0).alias("side"), spot("p").alias("i"), every("q").alias("j"))
    come = guests.join(plan, "host").select("host", "cls", F.lit(1).alias("side"), spot("q").alias("j"), every("p").alias("i"))
    rows = held.unionByName(come).join(members.select("cls", "doc", "root"), "cls")
    wanted = materialize(rows)
    texts = docs.filter(membership(wanted, "doc")("doc_id"))
    rows = wanted.join(texts, F.col("doc").eqNullSafe(F.col("doc_id"))).select("host", "i", "j", "side", "cls", "root", "text")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = list(column_shingles(pa.array(pdf["text"], pa.large_string()), words))
        true = np.array([class_of(t) == c for t, c in zip(sets, pdf["cls"], strict=True)])  # a doc_id may stand for several texts
        x, y = (np.flatnonzero(true & (pdf["side"] == k).to_numpy()) for k in (0, 1))
        shared = overlaps([sets[k] for k in x], [sets[k] for k in y])
        n = np.array([len(s) for s in sets], np.int64)
        root, cls = pd.factorize(pdf["root"])[0], pdf["cls"].to_numpy()
        linked = (100 * shared >= percent * (n[x][:, None] + n[y][None, :] - shared)) & (root[x][:, None] != root[y][None, :])
        # Links that join what others have joined already add nothing.
        joined = {k: k for k in set(root.tolist())}

        def find(k: int) -> int:
            while joined[k] != k:
                joined[k] = k = joined[joined[k]]
            return k

        out = []
        for a, b in np.argwhere(linked).tolist():
            p, q = find(root[x[a]]), find(root[y[b]])
            if p != q:
                joined[p] = q
                out.append((cls[x[a]], cls[y[b]]))
        trim()
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.groupBy("host", "i", "j").applyInPandas(compare, "a binary, b binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 20_000) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not out.size:
        return out.astype(np.int64)
    tokens = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for start in range(0, len(tokens), width):
        part = tokens[start : start + width]
        sides = []
        for sets in (left, right):
            table = np.zeros((len(sets), len(part)), np.float32)
            for k, own in enumerate(sets):
                at = np.searchsorted(own, part)
                table[k] = own[np.minimum(at, len(own) - 1)] == part
            sides.append(table)
        out += sides[0] @ sides[1].T
    return np.rint(out).astype(np.int64)


def assigned(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per document: doc_id, n, cls, root (least class of the component, null without shingles), component_id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    common, total = frequent_shingles(docs, words)
    order = spark.sparkContext.broadcast(Order(common))
    buckets = max(shuffle_width(docs), total * (100 - percent) // 100 // PER_BUCKET + 1)

    seen = materialize(summaries(docs, words, order))
    held = seen.filter("cls is not null")
    classes = materialize(held.groupBy("cls").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("k0", "k1", "k2")], *[F.first(b).alias(b) for b in BITS]))

    # Near copies first: each class against one class of its sketch groups, of about its size and of the next larger one.
    band = F.floor(F.log("n") / math.log(BAND)).cast("int")
    keyed = classes.select("cls", "n", F.explode(F.array("k0", "k1", "k2")).alias("key"), band.alias("band"))
    leaders = keyed.groupBy("key", "band").agg(F.min(F.struct("cls", "n")).alias("first")).select("key", "band", F.col("first.cls").alias("a"), F.col("first.n").alias("m"))
    asked = keyed.select("cls", "n", "key", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    near = asked.join(leaders, ["key", "band"]).filter((F.col("cls") != F.col("a")) & _sizes_allow("n", "m", percent)).select("a", F.col("cls").alias("b")).distinct()
    sides = ["cls", "n", *BITS]
    near = near.join(_side(classes, "x", sides), F.col("a") == F.col("x_cls")).join(_side(classes, "y", sides), F.col("b") == F.col("y_cls"))
    near = near.filter(((100 - percent) * F.col("x_n") >= 100 * _missing("x", "y")) & ((100 - percent) * F.col("y_n") >= 100 * _missing("y", "x"))).select("a", "b")
    links = materialize(verified(docs, classes, near, words, percent))
    roots = materialize(components(links))

    members = classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", "doc", F.col("k0").alias("g"), F.coalesce("root", "cls").alias("root"), "n", *BITS)
    pairs = materialize(qualifying_groups(docs, words, percent, order, buckets))  # read twice below
    more = opened(docs, classes, pairs, materialize(members), words, percent)
    roots = materialize(components(links.unionByName(more)))

    named = classes.select("cls", "doc").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "root").select("cls", "root", "component_id")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return seen.select("doc_id", "n", "cls").join(named, "cls", "left").select("doc_id", "n", "cls", "root", component.alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included).

    Two documents link when 100 * shared >= percent * union of their sets of distinct ``words``-word shingles (A-Z in
    lower case, words between ASCII white space; a shorter text is one shingle).  No link is lost.  A null, empty or
    wordless text has no shingles and no links.  Repeated rows are documents of their own that link with each other; a
    null doc_id is never the least unless its component holds nothing else; other columns are ignored; an empty table
    gives no rows."""
    return assigned(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs``, all columns: of each component the row with the least doc_id (and class, if rows share it), and all
    rows without shingles.  Only rows that may go are shuffled.

    Null, empty and wordless texts stay; of repeated rows one stays; very long texts are compared whole; columns of any name
    are kept; an empty table stays empty."""
    found = materialize(assigned(docs, words, percent))
    held = found.filter("cls is not null").groupBy("root", "doc_id", "cls").agg(F.count("*").alias("rows"))
    first = held.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "cls")).alias("first"))
    held = held.join(first, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("cls") == F.col("first.cls")))
    doc, cls, kind, stays = (fresh(docs, name) for name in ("stays_doc", "stays_cls", "own_cls", "stays"))
    doubtful = materialize(held.filter("not stays or rows > 1").select(F.col("doc_id").alias(doc), F.col("cls").alias(cls), F.col("stays").alias(stays)))
    may_go = membership(doubtful, doc)
    names = docs.columns
    kept = [F.col(f"`{name}`") for name in names]

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = column_shingles(batch.column(names.index("text")), words)
            yield batch.append_column(kind, pa.array([class_of(t) if len(t) else None for t in sets], pa.binary()))

    judged = docs.filter(may_go("doc_id")).mapInArrow(classed, ddl(docs, f"`{kind}` binary"))
    judged = judged.join(doubtful, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(kind) == F.col(cls)), "left")
    clear = judged.filter(F.col(stays).isNull()).select(*kept)
    repeated = judged.filter(F.col(stays)).dropDuplicates(["doc_id", kind]).select(*kept)
    return docs.filter(~may_go("doc_id")).unionByName(clear).unionByName(repeated)
