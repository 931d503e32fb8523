"""Personal data: fixed formats, and identifiers found by bootstrapped contexts.

The base formats (email, ip, card, phone) are read by their patterns.  All other strings
with digits, in one piece or in groups, and all that follows a label with a separator are
candidates.  Candidates and base finds are instances;
what stands around an instance and how it is built are its lexical patterns.  Spark
scores the graph of patterns and instances in rounds: a pattern is as good as the share
of its instances that are known or believed to be personal, an instance as good as its
patterns together.  Candidates of patterns with enough confidence are added as spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.frames import fresh, membership, over_batches
from tracelode.session import materialize

KINDS = ("email", "ip", "card", "phone")
LEARNED = "identifier"
ROUNDS = 3
CONFIDENCE = 0.8  # of a pattern that is used
SUPPORT = 3  # distinct instances that a pattern needs
FEWEST = 6  # letters and digits of a candidate whose build is told by kind and length; at least DIGITS of them digits
DIGITS = 4
LONGEST = 40  # letters and digits of an identifier in groups (34 in an IBAN)

EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats and the look behind keep long digit runs linear; the matches are the same.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]+")
PART = re.compile(r"[A-Za-z0-9_/+.-]")
LABEL = re.compile(r"([^\W\d_]{2,20})[\"']?\s{0,2}([=:#])?\s{0,2}[\"'(\[]?$")
SEPARATOR = re.compile(r"[=:#]")
BEFORE = re.compile(r"[^\W\d_]{2}[\"']?\s{0,2}$")
LABELLED = re.compile(r"""\s{0,2}(?:(?P<mark>["'])(?P<quoted>[^"'\n]{1,100})(?P=mark)|["'(\[]?(?P<value>[^\s"'<>(){}\[\],;]+))""")
# Groups with digits, or of capitals, with one space or hyphen between them; the first may stand in brackets.
GROUP = r"(?:[A-Z]{0,4}[0-9]{1,8}[A-Z]{0,4}|[A-Z]{2,4})(?![^\W_])"
GROUPS = re.compile(rf"(?<![^\W_])(?:\([0-9]{{1,5}}\)[ -]?{GROUP}|{GROUP}[ -]{GROUP})(?:[ -]{GROUP})*+")
# Fixed words that name an identifier when they stand before it with a separator: seed patterns.
LABELS = frozenset("password passwd pwd secret token key apikey ssn passport iban account".split())
# Access keys with this opening have one public format: seed instances.
ACCESS_KEY = re.compile(r"AKIA[0-9A-Z]{16}")

ROW_SCHEMA = "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, found array<struct<start:long,end:long,value:string,known:boolean,patterns:array<string>>>"


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base formats, in order; leftmost, not overlapping within a kind."""
    spans = []
    if "@" in text:
        last = 0
        for m in EMAIL_TAIL.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                spans.append((start, 0, m.end()))
                last = m.end()
    if DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans)


def shape(value: str) -> str:
    """How an identifier is built: its opening capitals, the kind of the rest, its length."""
    head = re.match(r"[A-Z]{2,5}(?=[A-Z0-9]*\d)", value)
    opening = head[0][:4] if head else ""
    rest = value[len(opening) :]
    if rest.isdigit():
        kind = "d"
    elif re.fullmatch(r"[0-9a-f]+", rest):
        kind = "h"
    elif rest.isalnum():
        kind = "a"
    else:
        kind = "m"
    return f"{opening}{kind}{len(value)}"


def layout(value: str) -> str:
    """A value with its digits, capitals and small letters made equal."""
    return re.sub(r"[^\W\d_]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", value)).replace("A", "\0")).replace("\0", "A")


def patterns(text: str, start: int, value: str, built: str | None = None) -> list[str]:
    """Lexical patterns of an instance: its build, if that says anything, and what stands before it."""
    built = shape(value) if built is None else built
    found = [f"built {built}"] if built else []
    if m := LABEL.search(text[max(0, start - 28) : start]):
        word = m[1].lower()
        if m[2]:
            found.append(f"label {word}{m[2]}")
        elif built:
            found.append(f"after {word} {built}")
    return found


def _strong(value: str) -> bool:
    return sum(c.isalnum() for c in value) >= FEWEST and sum(c.isdigit() for c in value) >= DIGITS


def _wide(text: str) -> list[tuple[int, int, str]]:
    """(start, end, build) of what stands in groups and of what follows labels; the latter's build is empty without digits."""
    found = []
    for m in GROUPS.finditer(text):
        if DIGIT.search(m[0]) and sum(c.isalnum() for c in m[0]) <= LONGEST:
            found.append((*m.span(), f"groups {layout(m[0])}"))
    groups = {s: e for s, e, _ in found}
    for sep in SEPARATOR.finditer(text):
        at = sep.start()
        if not BEFORE.search(text[max(0, at - 5) : at]) or not (m := LABELLED.match(text, at + 1)):
            continue
        start, end = m.span("quoted") if m["quoted"] else m.span("value")
        if not m["quoted"]:
            while end > start and not text[end - 1].isalnum() and text[end - 1] in ".:!?#*=-/":
                end -= 1
        if max(groups.get(start, 0), groups.get(start - 1, 0)) < end and any(c.isalnum() for c in text[start:end]):
            value = text[start:end]
            found.append((start, end, (shape(value) if _strong(value) else layout(value)) if DIGIT.search(value) else ""))
    return sorted(found)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str, bool, list[str]]]:
    """Identifier-like strings outside the base spans, and the base finds as known instances."""
    found = [(s, e, text[s:e], True, patterns(text, s, text[s:e])) for s, _, e in spans]
    taken = sorted((s, e) for s, _, e in spans)
    wide = []
    last = at = 0
    reach = -1  # the furthest end of the base spans that start before
    for start, end, built in _wide(text):
        while at < len(taken) and taken[at][0] <= start:
            reach = max(reach, taken[at][1])
            at += 1
        if end > reach:
            wide.append((start, end, built))
    pieces = set()
    at = near = cover = 0
    for m in DIGIT.finditer(text):
        if m.start() < last:
            continue
        start, end = m.start(), m.end()
        while start > last and PART.match(text[start - 1]):
            start -= 1
        while end < len(text) and PART.match(text[end]):
            end += 1
        last = end
        while start < end and not text[start].isalnum():
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at < len(taken) and taken[at][0] < end:
            continue
        while near < len(wide) and wide[near][0] <= start:
            cover = max(cover, wide[near][1])
            near += 1
        value = text[start:end]
        strong = _strong(value)
        if not strong and end <= cover:
            continue  # a part of what is a candidate as a whole
        pieces.add((start, end))
        found.append((start, end, value, bool(ACCESS_KEY.fullmatch(value)), patterns(text, start, value, None if strong else layout(value))))
    for start, end, built in wide:
        value = text[start:end]
        if (start, end) not in pieces and (told := patterns(text, start, value, built)):
            found.append((start, end, value, bool(ACCESS_KEY.fullmatch(value)), told))
    return found


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, LEARNED)[k]}:{s}:{e}" for s, k, e in spans)


def instances(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, digest and spans, and its instances; texts are read once."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text or ""
                spans = base_spans(text)
                base = _join(spans)
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                found = [dict(zip(("start", "end", "value", "known", "patterns"), c, strict=True)) for c in candidates(text, spans)]
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), base, found))
            names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found")
            yield {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"]} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return over_batches(named, run, ROW_SCHEMA)


def confident(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence) of patterns that are used, from edges (pattern, value, known).

    An instance that is known keeps score 1; any other starts at 0 and takes 1 - product(1 - confidence) of its patterns.
    A pattern's confidence is the smoothed mean score of its distinct instances; seed labels start and stay trusted."""
    edges = materialize(edges.groupBy("pattern", "value").agg(F.max("known").alias("known")))
    seeds = F.col("pattern").isin([f"label {word}{mark}" for word in sorted(LABELS) for mark in "=:#"])
    scored = edges.withColumn("score", F.col("known").cast("double"))
    for k in range(rounds):
        graded = scored.groupBy("pattern").agg(F.sum("score").alias("good"), F.count("*").alias("support"))
        trust = F.when(seeds, F.lit(1.0)).when(F.col("support") >= SUPPORT, F.col("good") / (F.col("support") + 0.5)).otherwise(0.0)
        graded = materialize(graded.select("pattern", trust.alias("confidence"), "support"))
        if k + 1 < rounds:
            used = F.when(F.col("confidence") >= CONFIDENCE, F.col("confidence")).otherwise(0.0)
            doubt = edges.join(graded, "pattern").groupBy("value").agg(F.exp(F.sum(F.log(1 - used + 1e-9))).alias("doubt"))
            scored = edges.join(doubt, "value").withColumn("score", F.when(F.col("known"), 1.0).otherwise(1 - F.col("doubt"))).select("pattern", "value", "known", "score")
    return graded.filter(F.col("confidence") >= CONFIDENCE)


def learned_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, extra): spans that confident patterns add; documents without any are left out."""
    found = rows.select("doc_id", "text_hash", F.explode("found").alias("f")).select("doc_id", "text_hash", "f.*")
    one = found.withColumn("pattern", F.explode("patterns"))
    # A value may be personal itself; the graph knows it by a digest.
    good = confident(one.select("pattern", F.sha2("value", 256).alias("value"), "known"))
    seed = F.col("known") & F.col("value").rlike(f"^{ACCESS_KEY.pattern}$")
    trusted = one.filter(~F.col("known")).join(good.select("pattern"), "pattern", "left_semi").unionByName(one.filter(seed))
    added = trusted.select("doc_id", "text_hash", "start", "end").distinct()
    return added.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("extra"))


def find_private(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all spans, ``kind:start:end``).

    A null or empty text has no spans; repeated rows and null doc_ids are searched each; other columns are ignored; an
    empty table gives no rows."""
    rows = materialize(instances(docs.select("doc_id", "text")))
    extra = learned_spans(rows).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "extra")

    def joined(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            spans = []
            for base, more in zip(batch["base"], batch["extra"], strict=True):
                if not more:
                    spans.append(base)
                    continue
                held = [(int(s), (*KINDS, LEARNED).index(k), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                spans.append(_join(sorted(held + [(m["start"], 4, m["end"]) for m in more])))
            yield {name: batch[name] for name in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")} | {"spans": spans}

    both = rows.drop("found").join(extra, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("h")), "left").drop("d", "h", "text_hash")
    return over_batches(both, joined, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, all columns kept; ``n_chars``, if there is one, follows.

    A null or empty text stays as it is; repeated rows and null doc_ids are redacted each; very long texts are searched whole;
    columns of any name are kept; an empty table stays empty."""
    rows = materialize(instances(docs.select("doc_id", "text")).select("doc_id", "text_hash", "found"))
    doc, text_hash, own_hash, spans = (fresh(docs, name) for name in ("span_doc", "span_hash", "own_hash", "learned"))
    extra = materialize(learned_spans(rows)).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), F.col("extra").alias(spans))
    held = membership(extra, text_hash)
    named = docs.withColumn(own_hash, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own_hash) == F.col(text_hash))
    kept = [F.col(f"`{name}`") for name in docs.columns]
    marked = named.filter(held(own_hash)).join(extra, same, "left").select(*kept, spans)
    plain = named.filter(~held(own_hash)).select(*kept, F.lit(None).cast(extra.schema[spans].dataType).alias(spans))
    names = docs.columns
    at, last = names.index("text"), len(names)
    counted = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [redacted(text, more) for text, more in zip(old, batch.column(last).to_pylist(), strict=True)]
            out = batch.select(range(last)).set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if counted is not None:
                sizes = [n if b == a else len(b) for a, b, n in zip(old, new, batch.column(counted).to_pylist(), strict=True)]
                out = out.set_column(counted, batch.schema.field(counted), pa.array(sizes, batch.schema.field(counted).type))
            yield out

    return plain.unionByName(marked).mapInArrow(run, docs.schema)


def redacted(text: str | None, extra) -> str | None:
    if text is None:
        return None
    spans = base_spans(text) + [(m["start"], 4, m["end"]) for m in extra or []]
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"<{(*KINDS, LEARNED)[kind]}>"]
        at = end
    return "".join(out) + text[at:]
