"""Removal of passages that an earlier document has, by compaction of a De Bruijn graph of words.

Every run of k words is an edge (from its first to its last k - 1 words). An edge that several documents
have is named by its source coordinates: the smallest doc_id, and the position there. Two edges that
follow each other in a document and whose names follow each other in the source lie on one nonbranching
path; such paths are compacted to spans (document, start, length, source document, source start). The
words at the source coordinates then verify each span.

Edges travel as packed arrays: a task combines the edges of some million words before it ships them,
keeps only those of an edge's smallest document there (the others already have a source), and deals them
to ranges of the hash space, FAN at a time: where the input needs more ranges, each is dealt on in a further
step, so a packed row stays large however many ranges there are. An edge that very many documents share
costs one entry per such chunk.

An edge goes by two hashes of its words, 128 bits in all, so edges of different words don't meet in practice.
The second one also cuts the edges into SLICES, which are matched one after the other: each reads the texts
again, and its shuffle files are gone before the next one starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize, need
from .wordscan import mix, pieces, text_bytes, windows, words
from .workers import held as held_for

#: Maps bytes to word bytes; 0 for white space (U+0000 takes the place that the space leaves).
TABLE = np.array([0 if c == 32 or 9 <= c <= 13 else 32 if c == 0 else c for c in range(256)], np.uint8)
CHUNK_WORDS = 1_000_000
#: Edges that one bucket holds, about; the number of buckets follows the input. Bits of the hash that one step deals by.
BUCKET_EDGES, FAN_BITS = 1_000_000, 10
#: Parts of the edges that are matched in turn, a power of two; bytes of text for which a slice has one task, about.
SLICES, TASK_BYTES = 4, 16 << 20
#: Tells the second hash of a run from the first.
_SECOND = np.uint64(0xA24BAED4963EE407)
_EDGES = "bucket long, chunk long, resolved boolean, hashes binary, checks binary, docs binary, counts binary, chunks binary, pos binary, src_docs binary, src_pos binary"
_HITS = "chunk long, docs binary, pos binary, src_docs binary, src_pos binary"
_SPANS = "doc_id long, start int, n int, src_doc long, src_start int"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 8]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in _EDGES.split(", ")])


def _together(edge: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal edges together, earlier rows first, and where each edge begins in it."""
    order = np.argsort(edge, kind="stable")
    new, other = edge[order][1:] != edge[order][:-1], check[order][1:] != check[order][:-1]
    if (other & ~new).any():
        order = np.lexsort((check, edge))
        new, other = edge[order][1:] != edge[order][:-1], check[order][1:] != check[order][:-1]
    return order, np.concatenate((np.ones(min(1, len(edge)), bool), new | other))


def _dealt(bits: int, edge: np.ndarray, check: np.ndarray, doc: np.ndarray, chunk: np.ndarray, pos: np.ndarray) -> list[tuple]:
    """Packed rows of the ranges of the first ``bits`` of the hash that have edges; documents come in runs."""
    bucket = (edge >> np.uint64(64 - bits)).astype(np.int64)
    by = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
    cuts = np.concatenate((np.flatnonzero(np.diff(bucket[by], prepend=-1)), [len(by)]))
    narrow = np.uint16 if int(pos.max()) < 1 << 16 else np.uint32
    out = []
    for a, b in zip(cuts, cuts[1:]):
        e = by[a:b]
        runs = np.flatnonzero(np.concatenate(([True], (doc[e][1:] != doc[e][:-1]) | (chunk[e][1:] != chunk[e][:-1]))))
        counts = np.diff(np.append(runs, len(e))).astype(np.uint32)
        own = chunk[e][runs]
        one = bool((own == own[0]).all())  # a chunk that all have is said once
        out.append((int(bucket[e[0]]), int(own[0]), False, edge[e].tobytes(), check[e].tobytes(), doc[e][runs].tobytes(), counts.tobytes(), None if one else own.tobytes(), pos[e].astype(narrow).tobytes(), None, None))
    return out


def _unpacked(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """(edge, its second hash, document, chunk, position) of packed rows."""
    edge, check, doc, chunk, pos = [], [], [], [], []
    for r in rows:
        h, counts = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], np.uint32)
        edge.append(h)
        check.append(np.frombuffer(r["checks"], np.uint64))
        doc.append(np.repeat(np.frombuffer(r["docs"], np.int64), counts))
        chunk.append(np.full(len(h), r["chunk"], np.int64) if r["chunks"] is None else np.repeat(np.frombuffer(r["chunks"], np.int64), counts))
        pos.append(np.frombuffer(r["pos"], np.uint16 if len(r["pos"]) == 2 * len(h) else np.uint32).astype(np.uint32))
    return tuple(np.concatenate(x) for x in (edge, check, doc, chunk, pos))


def _edges(k: int, bits: int, part: int, hash_bits: int):
    least = np.uint64(64 - hash_bits)

    def pack(held: list[tuple[int, np.ndarray]], chunk: int) -> pa.RecordBatch | None:
        held.sort(key=lambda x: x[0])
        ids = np.array([i for i, _ in held], np.int64)
        sizes = np.array([len(h) for _, h in held], np.int64)
        row = np.repeat(np.arange(len(held)), sizes)
        begin = np.cumsum(sizes) - sizes
        spoken = np.concatenate([h for _, h in held])
        first, edge = windows(spoken, row, k)
        check = windows(mix(spoken ^ _SECOND), row, k)[1]
        own = np.flatnonzero(check & np.uint64(SLICES - 1) == np.uint64(part))
        if not len(own):
            return None
        first, edge, check = first[own], edge[own] >> least << least, check[own]
        doc, pos = row[first], (first - begin[row[first]]).astype(np.uint32)
        order, fresh = _together(edge, check)
        source = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        known = ids[doc[order]] > ids[doc[source]]
        out = []
        if known.any():
            own, src = order[known], source[known]
            out.append((int(edge[0] >> np.uint64(64 - bits)), chunk, True, None, None, ids[doc[own]].tobytes(), None, None, pos[own].tobytes(), ids[doc[src]].tobytes(), pos[src].tobytes()))
        ship = np.sort(order[~known])
        return _batch(out + _dealt(bits, edge[ship], check[ship], ids[doc[ship]], np.full(len(ship), chunk, np.int64), pos[ship]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held_for("repeats")
        chunk, held, total = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for at, n in pieces(batch.column(1)):
                data, offsets = text_bytes(batch.column(1), at, n)
                _, _, h, row = words(data, offsets, TABLE)
                cut = np.searchsorted(row, np.arange(n + 1))
                for i, doc_id in enumerate(batch.column(0).slice(at, n).to_pylist()):
                    if doc_id is not None and cut[i + 1] - cut[i] >= k:
                        held.append((doc_id, h[cut[i] : cut[i + 1]]))
                        total += len(held[-1][1])
                if total >= CHUNK_WORDS:
                    packed = pack(held, chunk)
                    if packed is not None:
                        yield packed
                    chunk, held, total = chunk + 1, [], 0
        packed = pack(held, chunk) if held else None
        if packed is not None:
            yield packed

    return run


def _deal_on(bits: int):
    """Rows of ranges that came together here, dealt to the narrower ranges of ``bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["resolved"]:
                    yield _batch([tuple(r.values())])
                    continue
                held.append(r)
                total += len(r["hashes"]) // 8
                if total >= 2 * CHUNK_WORDS:
                    yield _batch(_dealt(bits, *_unpacked(held)))
                    held, total = [], 0
        if held:
            yield _batch(_dealt(bits, *_unpacked(held)))

    return run


def _hit_table(chunks, docs, pos, src_docs, src_pos) -> pa.Table:
    return pa.Table.from_arrays([pa.array(chunks, pa.int64())] + [pa.array(x, pa.binary()) for x in (docs, pos, src_docs, src_pos)], ["chunk", "docs", "pos", "src_docs", "src_pos"])


def _match_bucket(table: pa.Table) -> pa.Table:
    """The edges of a bucket that a smaller document has, with their source coordinates, packed by chunk."""
    out, packed = [[] for _ in range(5)], []
    for r in table.to_pylist():
        if not r["resolved"]:
            packed.append(r)
            continue
        for col, f in zip(out, ("chunk", "docs", "pos", "src_docs", "src_pos")):
            col.append(r[f])
    if packed:
        h, check, doc, c, p = _unpacked(packed)
        packed.clear()
        order, fresh = _together(h, check)
        same = ~fresh[1:]
        shared = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        if len(shared):
            shared = shared[np.lexsort((p[shared], doc[shared], check[shared], h[shared]))]
            fresh = np.concatenate(([True], (h[shared][1:] != h[shared][:-1]) | (check[shared][1:] != check[shared][:-1])))
            source = shared[np.maximum.accumulate(np.where(fresh, np.arange(len(shared)), 0))]
            hit = doc[shared] > doc[source]
            own, src = shared[hit], source[hit]
            by = np.argsort(c[own], kind="stable")
            own, src = own[by], src[by]
            cuts = np.flatnonzero(np.concatenate(([True], c[own][1:] != c[own][:-1]))).tolist() + [len(own)] if len(own) else [0]
            for a, b in zip(cuts, cuts[1:]):
                o, s = own[a:b], src[a:b]
                for col, v in zip(out, (int(c[o[0]]), doc[o].tobytes(), p[o].tobytes(), doc[s].tobytes(), p[s].tobytes())):
                    col.append(v)
    return _hit_table(*out)


def _compact(table: pa.Table) -> pa.Table:
    """Nonbranching paths of a chunk's hits: own and source positions advance together."""
    read = lambda f, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(f).to_pylist()]).astype(np.int64)
    doc, pos, src, at = read("docs", np.int64), read("pos", np.uint32), read("src_docs", np.int64), read("src_pos", np.uint32)
    order = np.lexsort((pos, doc))
    doc, pos, src, at = doc[order], pos[order], src[order], at[order]
    goes_on = (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1) & (src[1:] == src[:-1]) & (at[1:] == at[:-1] + 1)
    first = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    n = np.diff(np.append(first, len(doc)))
    return pa.Table.from_arrays([pa.array(doc[first]), pa.array(pos[first].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(src[first]), pa.array(at[first].astype(np.int32))], ["doc_id", "start", "n", "src_doc", "src_start"])


def repeated_paths(docs: DataFrame, k: int = 13, hash_bits: int = 64) -> DataFrame:
    """``(doc_id, text)`` -> compacted paths ``(doc_id, start, n, src_doc, src_start)``; n edges, word positions from 0.

    ``hash_bits`` of the first hash are used; with fewer, edges of different words share it and the second tells them apart.
    """
    d = need(docs, "doc_id", "text")
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(6, (int(size) // 6 // SLICES // BUCKET_EDGES).bit_length())
    tasks = min(max(1, int(size) // TASK_BYTES), 1 << bits)
    hits = []
    for part in range(SLICES):
        edges = d.mapInArrow(_edges(k, min(bits, FAN_BITS), part, hash_bits), _EDGES)
        for deeper in range(2 * FAN_BITS, bits + FAN_BITS, FAN_BITS):
            edges = edges.repartition("bucket").mapInArrow(_deal_on(min(bits, deeper)), _EDGES)
        found = edges.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_match_bucket, _HITS)
        hits.append(materialize(found, "hits", drop_shuffles=True))
    paths = reduce(DataFrame.union, hits).groupBy("chunk").applyInArrow(_compact, _SPANS)
    paths = materialize(paths, "paths", drop_shuffles=True)
    for done in hits:
        discard(done)
    return paths


class Words:
    """The words of a text, joined by one space, and where each begins."""

    def __init__(self, text: str | None):
        self.tokens = (text or "").encode("utf-8", "surrogatepass").split()
        self.joined = b" ".join(self.tokens)
        self.starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in self.tokens], dtype=np.int64)))

    def digest(self, start: int, n: int) -> bytes:
        return hashlib.blake2b(self.joined[self.starts[start] : self.starts[start + n] - 1], digest_size=16).digest()


def _source_digests(k: int):
    """The digests of all spans that are asked of a text, worked out where the text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, spans = Words(batch.column(0)[i].as_py()), batch.column(2)[i].as_py()
                spans = [s for s in spans if s["src_start"] + s["n"] + k - 1 <= len(own.tokens)]
                for at in range(0, len(spans), 65536):
                    part = spans[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(1)[i].as_py()] * len(part), pa.int64()), pa.array([s["src_start"] for s in part], pa.int32()), pa.array([s["n"] for s in part], pa.int32()),
                                                      pa.array([own.digest(s["src_start"], s["n"] + k - 1) for s in part], pa.binary())], ["src_doc", "src_start", "n", "digest"])

    return run


def _remove(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(at, 512)
                total, gone, kept = [], [], []
                for text, paths in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    own = Words(text)
                    n = len(own.tokens)
                    drop = np.zeros(n, bool)
                    for p in paths or ():
                        if p["start"] + p["n"] + k - 1 <= n and own.digest(p["start"], p["n"] + k - 1) == p["digest"]:
                            drop[p["start"] : p["start"] + p["n"] + k - 1] = True
                    total.append(n), gone.append(int(drop.sum()))
                    kept.append((b" ".join([t for t, d in zip(own.tokens, drop.tolist()) if not d]) if gone[-1] else own.joined).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, k: int = 13, hash_bits: int = 64) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, n_words, n_removed, kept)``, one row per input row.

    A word goes if it lies in a run of k words that also starts in a document with a smaller doc_id;
    runs are judged on the input. ``kept`` joins the other words by one space. Null and empty texts have no
    words; a row with a null doc_id neither loses words nor is a source. Rows that repeat a doc_id are not
    sources for each other; where their texts differ, each keeps to the paths that its own words verify.
    ``hash_bits``: see :func:`repeated_paths`.
    """
    d = need(docs, "doc_id", "text")
    paths = repeated_paths(d, k, hash_bits)
    asked = paths.select("src_doc", "src_start", "n").distinct().groupBy("src_doc").agg(F.collect_list(F.struct("src_start", "n")).alias("spans"))
    sources = d.join(asked, d["doc_id"] == asked["src_doc"]).select("text", "src_doc", "spans")
    digests = sources.mapInArrow(_source_digests(k), "src_doc long, src_start int, n int, digest binary")
    digests = materialize(digests.distinct(), "sources", drop_shuffles=True)
    verified = paths.join(digests, ["src_doc", "src_start", "n"]).groupBy("doc_id").agg(F.collect_set(F.struct("start", "n", "digest")).alias("paths"))
    out = d.join(verified, "doc_id", "left").select("doc_id", "text", "paths")
    return out.mapInArrow(_remove(k), "doc_id long, n_words long, n_removed long, kept string")
