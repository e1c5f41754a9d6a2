"""Benchmark decontamination: a broadcast hash set of test n-grams against every training window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialize, need
from .wordscan import pieces, text_bytes, windows, words
from .workers import held as held_for

#: Lower-cases A-Z; 0 for bytes that part words (ASCII other than digits and letters).
TABLE = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 0 for c in range(256)], np.uint8)
#: Benchmark text that one broadcast set may hold; the set takes some five times as much. A larger benchmark is
#: taken in slices of this size, one scan of the documents each, so no set grows with the benchmark.
SET_BYTES = 16 << 20
SPAN = "array<struct<w0:int,w1:int,c0:int,c1:int>>"
FOUND = {"words": "long", "spans": SPAN, "items": "array<long>"}


class GramSet:
    """Windows of the benchmark by word count: sorted hashes, a bit table before them, and the exact words.

    All words lie in one byte buffer; a window is its hash, its first word and its item.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], n: int):
        self.ids = [i for i, _ in items]
        column = pa.array([t for _, t in items], pa.string())
        raw, starts, ends, hashes, rows = [], [], [], [], []
        base = 0
        for at, count in pieces(column):
            data, offsets = text_bytes(column, at, count)
            start, end, h, row = words(data, offsets, TABLE)
            raw.append(TABLE[data].tobytes()), starts.append(start + base), ends.append(end + base), hashes.append(h), rows.append(row + at)
            base += len(data)
        self.raw = b"".join(raw)
        self.start, self.end, h, row = (np.concatenate(x) for x in (starts, ends, hashes, rows))
        lengths = np.bincount(row, minlength=len(items))
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.bits: dict[int, tuple[int, np.ndarray]] = {}
        for size in sorted({min(int(x), n) for x in np.unique(lengths) if x}):
            first, grams = windows(h, row, size)
            own = np.minimum(lengths[row[first]], n) == size
            first, grams = first[own], grams[own]
            order = np.lexsort((row[first], grams))
            first, grams = first[order], grams[order]
            fresh = np.ones(len(first), bool)  # a window that an item repeats counts once
            for i in np.flatnonzero((grams[1:] == grams[:-1]) & (row[first[1:]] == row[first[:-1]])).tolist():
                fresh[i + 1] = self.words(int(first[i]), size) != self.words(int(first[i + 1]), size)
            first, grams = first[fresh], grams[fresh]
            self.grams[size] = grams, first, row[first]
            width = max(16, min(24, int(len(grams) * 16).bit_length()))
            table = np.zeros(1 << width, bool)
            table[(grams >> np.uint64(64 - width)).astype(np.int64)] = True
            self.bits[size] = width, table

    def words(self, first: int, size: int) -> bytes:
        return b" ".join([self.raw[i:j] for i, j in zip(self.start[first : first + size].tolist(), self.end[first : first + size].tolist())])

    def hits(self, data: np.ndarray, found: tuple[np.ndarray, ...]) -> Iterator[tuple[int, int, set]]:
        """(first word, word count, items) of every window that is one of the set's, verified word by word."""
        start, end, h, row = found
        for size, (ordered, at_word, item) in self.grams.items():
            first, hashes = windows(h, row, size)
            width, table = self.bits[size]
            maybe = np.flatnonzero(table[(hashes >> np.uint64(64 - width)).astype(np.int64)])
            low, high = np.searchsorted(ordered, hashes[maybe]), np.searchsorted(ordered, hashes[maybe], side="right")
            for i, a, b in zip(first[maybe].tolist(), low.tolist(), high.tolist()):
                if a == b:
                    continue
                said = b" ".join([TABLE[data[x:y]].tobytes() for x, y in zip(start[i : i + size].tolist(), end[i : i + size].tolist())])
                items = {self.ids[item[k]] for k in range(a, b) if self.words(int(at_word[k]), size) == said}
                if items:
                    yield i, size, items


def _scan(columns: list[str], found_names: list[str], grams, earlier: bool, shed: bool = False):
    """shed: leave the text out of what is returned."""
    text = columns.index("text")
    returned = [c for c in columns if not (shed and c == "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_for("decontamination")
        known: GramSet = grams.value
        for batch in batches:
            for at, n in pieces(batch.column(text)):
                data, offsets = text_bytes(batch.column(text), at, n)
                found = start, end, _, row = words(data, offsets, TABLE)
                first_word = np.searchsorted(row, np.arange(n + 1))
                hit = np.zeros(len(start) + 1, np.int64)
                items: dict[int, set] = {}
                for i, size, of in known.hits(data, found):
                    hit[i] += 1
                    hit[i + size] -= 1
                    items.setdefault(int(row[i]), set()).update(of)
                old = batch.slice(at, n)
                prior = {"s": old.column(len(columns) + 1).to_pylist(), "i": old.column(len(columns) + 2).to_pylist()} if earlier else None
                if prior:
                    for k, (spans, of) in enumerate(zip(prior["s"], prior["i"])):
                        for s in spans:
                            hit[first_word[k] + s["w0"]] += 1
                            hit[first_word[k] + s["w1"]] -= 1
                        if of or spans:
                            items.setdefault(k, set()).update(of)
                covered = np.cumsum(hit[:-1]) > 0
                out_spans, out_items = [[]] * n, [[]] * n
                for k in items:
                    a, b = int(first_word[k]), int(first_word[k + 1])
                    on = np.concatenate(([0], covered[a:b].astype(np.int8), [0]))
                    edge = np.flatnonzero(np.diff(on))
                    chars = np.cumsum((data[offsets[k] : offsets[k + 1]] & 0xC0) != 0x80)
                    point = lambda byte: int(chars[byte - 1]) if byte else 0
                    out_spans[k] = [{"w0": int(s), "w1": int(e), "c0": point(int(start[a + s] - offsets[k])), "c1": point(int(end[a + e - 1] - offsets[k]))} for s, e in zip(edge[::2], edge[1::2])]
                    out_items[k] = sorted(x for x in items[k] if x is not None)
                made = [pa.array(np.diff(first_word), pa.int64()), pa.array(out_spans, pa.list_(pa.struct([(f, pa.int32()) for f in ("w0", "w1", "c0", "c1")]))), pa.array(out_items, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([old.column(i) for i, c in enumerate(columns) if c in returned] + made, [*returned, *found_names])

    return run


def find_overlaps(docs: DataFrame, benchmark: DataFrame, n: int = 10, set_bytes: int = SET_BYTES, keep_text: bool = True, prefix: str = "bench_") -> DataFrame:
    """All columns of ``docs`` (one of them ``text``), and ``bench_words`` (words of the text), ``bench_spans``
    (merged covered spans: words w0 to w1, code points c0 to c1) and ``bench_items`` (items found).

    An item of 1 to n-1 words is one window; an item without words, or a null one, has none. A null or
    empty text has no words. A null item_id still covers words but is not listed. Repeated rows are kept.
    Columns of ``docs`` that have the names of the results are replaced; ``prefix`` gives other names.
    ``keep_text=False`` leaves ``text`` out of the result.
    """
    names = [prefix + k for k in FOUND]
    docs = docs.drop(*names)
    bench = need(benchmark, "item_id", "text")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    slices = max(1, -(-int(size) // set_bytes))
    columns = docs.columns
    more = [T.StructField(k, T._parse_datatype_string(v)) for k, v in zip(names, FOUND.values())]
    out = docs
    for k in range(slices):
        part = bench if slices == 1 else bench.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(slices)) == k)
        grams = docs.sparkSession.sparkContext.broadcast(GramSet([(r[0], r[1]) for r in part.toLocalIterator()], n))
        if k:
            out = materialize(out, "overlaps")
        shed = not keep_text and k == slices - 1
        fields = [f for f in docs.schema.fields if not (shed and f.name == "text")]
        out = out.mapInArrow(_scan(columns, names, grams, k > 0, shed), T.StructType([*fields, *more]))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, action: str = "spans") -> DataFrame:
    """``docs`` without benchmark passages: ``spans`` cuts the covered spans, ``documents`` drops the documents.

    All columns of ``docs`` are returned, whatever their names.
    """
    prefix = "bench_"
    while {prefix + k for k in FOUND} & {c.lower() for c in docs.columns}:
        prefix += "_"
    found, spans = find_overlaps(docs, benchmark, n, prefix=prefix), prefix + "spans"
    if action == "documents":
        return found.where(F.size(spans) == 0).select(*docs.columns)
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["c1"]))
    ends = F.concat(F.transform(spans, lambda s: s["c0"]), F.array(F.length("text")))
    kept = F.array_join(F.zip_with(starts, ends, lambda s, e: F.substring(F.col("text"), s + 1, e - s)), " ")
    return found.withColumn("text", F.when(F.size(spans) > 0, kept).otherwise(F.col("text"))).select(*docs.columns)


def overlap_report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row per document: words, words hit, items found, a digest of their ids, and the verdict."""
    found = find_overlaps(need(docs, "doc_id", "text"), benchmark, n, keep_text=False)
    n_hit = F.aggregate("bench_spans", F.lit(0).cast("long"), lambda total, s: total + s["w1"] - s["w0"])
    ids = F.array_join(F.array_sort(F.transform("bench_items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", F.col("bench_words").alias("n_words"), n_hit.alias("n_hit"), F.size("bench_items").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (F.size("bench_spans") > 0).alias("contaminated"))
