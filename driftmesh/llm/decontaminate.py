"""Benchmark decontamination by template canonicalisation.

Words become canonical tokens: lower case without edge punctuation; numbers,
units after numbers, and names (capitalised words, also at the start of a
sentence, where a name can't be told from another word) become typed
placeholders whose value is kept as a slot. Windows of ``width`` tokens (the
whole item, if it is shorter) are hash-joined with the benchmark's, in two forms:

* template windows, of which at least half the tokens are literal. Matches are
  lined up by item and by offset between the two texts; within such a line-up
  each value of the item must stand for one value of the document (slot
  consistency), so that a re-parameterised copy counts and a chance meeting of
  placeholders doesn't;
* literal windows of the lower-case words themselves, every one, whatever their
  case, numbers and names; they are matched as they stand.

An item of fewer than ``width`` tokens is one window; its template form is used
if it has ``least`` tokens, its literal form always. A document leaks an item if,
in consistent line-ups, windows of either form cover ``share`` of the item's
windows of that form, or if ``run`` words of it stand in the document one after
another as they are.

The benchmark's windows are held in memory on the executors while their size in
bytes, which is found first, is at most ``most_bytes``; then each text is judged
where it is and nothing is shuffled. Beyond it the windows of both sides are
hash-joined by shuffle to find candidate pairs, which the same judgement decides.

Verdicts belong to texts: rows of one text, of one id or of none are judged each
by themselves and alike. Null and empty texts leak nothing; an item of a null id
or without words is no item, and repeated items count once. An item that stands
in a text several times counts once. Empty tables give empty tables or no leaks.
Columns of any name pass through the stage. A text of n words takes time in
proportion to n, and to its matches.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, Codes, durable, fresh, load

NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
#: Units, which become placeholders after a number.
UNITS = frozenset("kg g mg lb lbs oz ton tons tonne tonnes km m cm mm mile miles ft feet inch inches yard yards l ml litre litres liter liters gallon gallons h hr hrs hour hours min mins minute minutes s sec secs second seconds day days week weeks month months year years dollar dollars euro euros cent cents pound pounds percent degree degrees kmh mph".split())
EDGES = ".,;:!?\"'()[]{}%$&*#|<>«»„“”‘’…-–—"
CAP, NUM, UNIT, BLANK = 1, 2, 4, 8
NUM_HASH, UNIT_HASH, NAME_HASH = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
ROLL = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37, 0x9FB21C651E98DF25, 0xAAAAAAAAAAAAAAAB, 0xC4CEB9FE1A85EC53, 0xFF51AFD7ED558CCD, 0x2545F4914F6CDD1D], dtype=np.uint64)
#: Forms of windows; their seeds keep equal sums apart.
TEMPLATE, LITERAL = 0, 1
SEEDS = (0x51ED270B9F8F4A11, 0xA3C59AC2F1B7E86D)


def code(word: str) -> int:
    """The word's hash, with its flags in the low four bits."""
    core = word.strip(EDGES)
    if not core:
        return BLANK
    flags, low = 0, core.lower()
    if NUMBER.fullmatch(core) or (core[0].isdigit() and NUMBER.match(core)):
        flags = NUM
    elif low in UNITS:
        flags = UNIT
    if core[0].isupper() and not core[1:2].isupper():
        flags |= CAP
    return (xxhash.xxh64_intdigest(low) & ~15) | flags


class Tokens:
    """A text's words without blanks, their literal and template hashes, and which are slots."""

    def __init__(self, text: str | None, codes: Codes):
        words = (text or "").split()
        packed = np.fromiter(map(codes.__getitem__, words), dtype=np.uint64, count=len(words))
        flags = (packed & np.uint64(15)).astype(np.uint8)
        if (flags & BLANK).any():
            keep = flags & BLANK == 0
            packed, flags = packed[keep], flags[keep]
            words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
        self.words, self.literal = words, packed & ~np.uint64(15)
        number = flags & NUM > 0
        unit = flags & UNIT > 0
        unit[1:] &= number[:-1]
        unit[:1] = False
        name = (flags & CAP > 0) & ~unit & ~number
        self.template = self.literal.copy()
        self.template[number], self.template[unit], self.template[name] = NUM_HASH, UNIT_HASH, NAME_HASH
        self.slots = number | unit | name

    def __len__(self) -> int:
        return len(self.words)

    def windows(self, width: int, form: int) -> tuple[np.ndarray, np.ndarray]:
        """Each window's hash, and whether it is used."""
        n = len(self) - width + 1
        if n <= 0 or not width:
            return np.empty(0, np.uint64), np.empty(0, bool)
        hashes, out = self.literal if form else self.template, np.full(n, SEEDS[form] * width & (1 << 64) - 1, np.uint64)
        for j in range(width):
            out += hashes[j : j + n] * ROLL[j]
        out ^= out >> np.uint64(31)
        out *= ROLL[15]
        out ^= out >> np.uint64(29)
        if form or not self.slots.any():
            return out, np.ones(n, bool)
        held = np.concatenate([[0], np.cumsum(self.slots)])
        return out, 2 * (held[width:] - held[:-width]) <= width

    def value(self, i: int) -> str:
        return self.words[i].strip(EDGES).lower()


def forms(n: int, width: int, least: int) -> list[int]:
    """Forms of windows that an item of n tokens has."""
    return [TEMPLATE, LITERAL] if min(n, width) >= least else [LITERAL]


def coverage(doc: Tokens, item: Tokens, hits: dict[tuple[int, int], list[int]], width: int, run: int) -> float:
    """The largest share of the item's windows of a form that consistent line-ups cover; 1 for a run of literal words. hits: places in the item by (form, shift)."""
    own = min(width, len(item))
    best, covered = 0.0, defaultdict(set)
    for (form, shift), places in hits.items():
        if form == TEMPLATE:
            values: dict[str, str] = {}
            held = {i for at in places for i in range(at, at + own) if item.slots[i]}
            if any(values.setdefault(item.value(i), doc.value(i + shift)) != doc.value(i + shift) for i in sorted(held)):
                continue
        else:
            row = sorted(set(places))
            starts = [p for k, p in enumerate(row) if not k or row[k - 1] != p - 1]
            ends = [p for k, p in enumerate(row) if k + 1 == len(row) or row[k + 1] != p + 1]
            if max(e - s + own for s, e in zip(starts, ends, strict=True)) >= run:
                best = 1.0
        covered[form].update(places)
    for form, places in covered.items():
        best = max(best, len(places) / int(item.windows(own, form)[1].sum()))
    return best


class Index:
    """The benchmark's windows sorted by hash, and its items; ``parts`` of a few numbers a window."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray, places: np.ndarray, kinds: np.ndarray, texts: list[tuple[int, str]], how: tuple):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.items, self.places, self.kinds = hashes[order], items[order], places[order], kinds[order]
        self.texts, self.how = texts, how
        self.open()

    def open(self) -> None:
        codes = Codes(code)
        self.tokens = {key: Tokens(text, codes) for key, text in self.texts}
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        self.widths = sorted({(int(k) >> 1, int(k) & 1) for k in np.unique(self.kinds)})

    def __getstate__(self):
        return self.hashes, self.items, self.places, self.kinds, self.texts, self.how

    def __setstate__(self, state):
        self.hashes, self.items, self.places, self.kinds, self.texts, self.how = state
        self.open()

    def leaks(self, text: str | None, codes: Codes) -> list[tuple[int, float]]:
        """(item, coverage) of the items that the text leaks, by item."""
        width, _, share, run = self.how
        doc = Tokens(text, codes)
        hits: dict[int, dict] = {}
        for own, form in self.widths:
            got, good = doc.windows(own, form)
            if not len(got):
                continue
            near = np.flatnonzero(self.seen[(got >> np.uint64(42)).astype(np.int64)] & good)
            lo, hi = np.searchsorted(self.hashes, got[near], "left"), np.searchsorted(self.hashes, got[near], "right")
            for i, a, b in zip(near.tolist(), lo.tolist(), hi.tolist(), strict=True):
                for r in range(a, b):
                    if self.kinds[r] == own * 2 + form:
                        at = int(self.places[r])
                        hits.setdefault(int(self.items[r]), {}).setdefault((form, i - at), []).append(at)
        out = ((item, coverage(doc, self.tokens[item], own, width, run)) for item, own in sorted(hits.items()))
        return [(item, x) for item, x in out if x >= share]


def pair_hits(doc: Tokens, item: Tokens, width: int, least: int) -> dict[tuple[int, int], list[int]]:
    """The places in the item of windows that both hold, by (form, shift)."""
    hits: dict[tuple[int, int], list[int]] = {}
    own = min(width, len(item))
    for form in forms(len(item), width, least):
        known = defaultdict(list)
        for at, (h, good) in enumerate(zip(*(x.tolist() for x in item.windows(own, form)), strict=True)):
            if good:
                known[h].append(at)
        got, good = doc.windows(own, form)
        for i in np.flatnonzero(np.isin(got, np.array(list(known), np.uint64)) & good).tolist():
            for at in known[int(got[i])]:
                hits.setdefault((form, i - at), []).append(at)
    return hits


def item_windows(items: DataFrame, width: int, least: int) -> DataFrame:
    """(hash, kind, item_id, at) of each window used; kind is width x 2 + form."""

    def run(batches):
        codes = Codes(code)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Tokens(text, codes)
                for form in forms(len(own), width, least) if len(own) else ():
                    size = min(width, len(own))
                    got, good = own.windows(size, form)
                    at = np.flatnonzero(good)
                    yield pa.RecordBatch.from_arrays([pa.array(got[at].view(np.int64)), pa.array(np.full(len(at), 2 * size + form, np.int32)), pa.array(np.full(len(at), key, np.int64)), pa.array(at.astype(np.int32))], names=["hash", "kind", "item_id", "at"])

    return items.mapInArrow(run, "hash long, kind int, item_id long, at int")


def benchmark_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, text), each pair once; texts of one id are one item each, joined to it."""
    named = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    return named.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text"))


def index_of(items: DataFrame, width: int, least: int, share: float, run: int, most_bytes: int) -> Index | None:
    """The index, or None if it would take more than most_bytes: 24 for each window, two windows for each word at most, and the texts."""
    # a word has a byte and a space at least, so this is never less than the index
    size = items.agg(F.sum(F.octet_length("text") * 25 + 64)).head()[0] or 0
    if size > most_bytes:
        return None
    rows = item_windows(items, width, least).toArrow()
    columns = [rows.column(c).to_numpy() for c in ("hash", "item_id", "at", "kind")]
    texts = sorted((r.item_id, r.text) for r in items.toLocalIterator())
    return Index(columns[0].view(np.uint64), *columns[1:], texts, (width, least, share, run))


def joined(docs: DataFrame, items: DataFrame, width: int, least: int, share: float, run: int, text_col: str) -> DataFrame:
    """(text_key, item_id, coverage) of each leak, by shuffle: windows of both sides are hash-joined, and the pairs that share one are judged."""
    texts = docs.where(F.col(text_col) != "").select(F.md5(text_col).alias("text_key"), F.col(text_col).alias("text"))
    windows = durable(item_windows(items, width, least))
    kinds = sorted(r.kind for r in windows.select("kind").distinct().toLocalIterator())

    def places(batches):
        codes = Codes(code)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc = Tokens(text, codes)
                for kind in kinds:
                    got, good = doc.windows(kind >> 1, kind & 1)
                    own = np.unique(got[good]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), kind, np.int32)), pa.array([key] * len(own), pa.string())], names=["hash", "kind", "text_key"])

    held = texts.mapInArrow(places, "hash long, kind int, text_key string")
    pairs = held.join(windows.select("hash", "kind", "item_id").distinct(), ["hash", "kind"]).select("text_key", "item_id").distinct()
    once = texts.dropDuplicates(["text_key"])
    met = durable(pairs).join(once, "text_key").join(items.withColumnRenamed("text", "item_text"), "item_id").select("text_key", "item_id", "text", "item_text")

    def judged(batches):
        codes = Codes(code)
        for batch in batches:
            out = []
            for key, number, text, item_text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc, item = Tokens(text, codes), Tokens(item_text, codes)
                x = coverage(doc, item, pair_hits(doc, item, width, least), width, run)
                if x >= share:
                    out.append((key, number, x))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64()))], names=["text_key", "item_id", "coverage"])

    return met.mapInArrow(judged, "text_key string, item_id long, coverage double")


def flag(docs: DataFrame, benchmark: DataFrame, width: int = 8, least: int = 4, share: float = 0.5, run: int = 30, most_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row: id, leaked, n_items, items (sorted ids), coverage (of the best covered item, 0 if none leaks)."""
    items = durable(benchmark_items(benchmark, item_col, item_text_col))
    index = index_of(items, width, least, share, run, most_bytes)
    if index is None:
        found = joined(docs, items, width, least, share, run, text_col)
        by_text = found.groupBy("text_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"))
        keyed = docs.select(F.col(id_col), F.md5(text_col).alias("key_")).join(by_text, F.col("key_") == F.col("text_key"), "left")
        own = F.coalesce("items", F.array().cast("array<long>"))
        return keyed.select(id_col, F.col("text_key").isNotNull().alias("leaked"), F.size(own).cast("long").alias("n_items"), own.alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run_(batches):
        codes = Codes(code)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                out = [shared.value.leaks(text, codes) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([bool(x) for x in out]), pa.array([len(x) for x in out], pa.int64()), pa.array([[i for i, _ in x] for x in out], pa.list_(pa.int64())), pa.array([max((c for _, c in x), default=0.0) for x in out], pa.float64())],
                    names=[id_col, "leaked", "n_items", "items", "coverage"],
                )

    return docs.select(id_col, text_col).mapInArrow(run_, f"`{id_col}` long, leaked boolean, n_items long, items array<long>, coverage double")


def query(spark, sf_dir: str) -> DataFrame:
    return flag(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 8, least: int = 4, share: float = 0.5, run: int = 30, most_bytes: int = 256 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that leak no item, with all their columns."""
    items = durable(benchmark_items(benchmark, item_col, item_text_col))
    index = index_of(items, width, least, share, run, most_bytes)
    if index is None:
        key = fresh("text_key_", docs)
        bad = joined(docs, items, width, least, share, run, text_col).select(F.col("text_key").alias(key)).distinct()
        keyed = docs.withColumn(key + "_", F.md5(text_col))
        return keyed.join(bad, F.col(key + "_") == F.col(key), "left_anti").drop(key + "_")
    shared = docs.sparkSession.sparkContext.broadcast(index)
    place = docs.columns.index(text_col)

    def run_(batches):
        codes = Codes(code)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                keep = [not shared.value.leaks(text, codes) for text in part.column(place).to_pylist()]
                yield part if all(keep) else part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run_, docs.schema)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item, with all their columns; rows are judged by their text."""
    return clean(docs, load(spark, sf_dir, "benchmark"))
