"""SimHash near-duplicate classes by anchor-point covering.

A 64-bit fingerprint is cut into blocks. With allowances ``t1..tm`` whose sum is
``threshold - (m - 1)``, two fingerprints at most ``threshold`` bits apart differ by at most ``ti``
bits in some block ``i`` (pigeonhole). Each block has a covering code as its anchors: a Hamming
[15,11] code (covering radius R = 1) on its first 15 bits, exact on the others; a block with
allowance 0 uses all words (R = 0). A fingerprint is *home* at its nearest anchor (distance <= R) and
*visits* every anchor within R + t; so each linked pair meets at the home of either one. Per anchor,
homes are compared with visitors over all 64 bits, so no link is lost and none is invented.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, materialize, need
from .wordscan import mix
from .workers import held as held_for

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: (word, first bit, width, allowance) of each block for 4 bits of one word: 1 + 1 + 0 = 4 - (3 - 1).
BLOCKS = ((0, 0, 23, 1), (0, 23, 24, 1), (0, 47, 17, 0))
#: Rows of one anchor that one comparison takes at most (on average, by hash) before the anchor is split.
PIECE = 8192
#: Least parity bits of a shingle set; documents and tokens that the order of shingles from rare to common is taken from.
BITS, ORDER_DOCS, ORDER_TOKENS = 1024, 10_000, 1 << 16
#: Nodes that a task remembers to have said.
NODES_SAID = 500_000
#: Rounds in which each token's nodes are compared with one of them, before all that is still apart is.
ROUNDS = 1


def simhash(text: str | None, shingle_words: int = 4, width: int = 1) -> np.ndarray:
    """``width`` 64-bit words of SimHash over whole-text word shingles; zero without words.

    One word counts repeated shingles as often as they occur; several count each once, as Jaccard does.

    The first word has the shingles' XXH64; further ones have scrambled forms of it.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(width, np.uint64)
    joined, k = b" ".join(words), min(shingle_words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
    ends = ends[k - 1 :]
    digest = xxhash.xxh64_intdigest
    every = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    return _majority(np.unique(every) if width > 1 else every, width)


def _majority(every: np.ndarray, width: int = 1) -> np.ndarray:
    """The bits that over half of the hashes have; zero without any."""
    counts, n = np.zeros(64 * width, np.int64), len(every)
    for at in range(0, n, 16384):
        h = every[at : at + 16384]
        wide = np.stack([h] + [mix(h + np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for w in range(1, width)], 1)
        counts += np.unpackbits(wide.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, shingle_words: int = 4, width: int = 1) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, fp)``: the bits of one word as a signed long, of several as their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_for("simhash")
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(at, 512)
                fp = [simhash(t, shingle_words, width) for t in part.column(1).to_pylist()]
                held = pa.array([int(f.view(np.int64)[0]) for f in fp], pa.int64()) if width == 1 else pa.array([f.tobytes() for f in fp], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), held], ["doc_id", "fp"])

    return need(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, fp {'long' if width == 1 else 'binary'}")


def _flips(width: int, budget: int) -> list[tuple[int, int]]:
    """(mask, bits) of up to ``budget`` (at most 2) flips among ``width`` bits."""
    out = [(0, 0)]
    if budget >= 1:
        out += [(1 << i, 1) for i in range(width)]
    if budget >= 2:
        out += [(1 << i | 1 << j, 2) for i in range(width) for j in range(i)]
    return out


def _visits(width: int, allowance: int) -> list[np.ndarray]:
    """For each Hamming syndrome, the masks that lead from a block to every anchor within R + allowance."""
    out = []
    for syndrome in range(16):
        near = [(0, 0)] if syndrome == 0 else [(1 << (syndrome - 1), 1)]
        if syndrome:
            near += [(1 << (i - 1) | 1 << ((i ^ syndrome) - 1), 2) for i in range(1, 16) if (i ^ syndrome) > i]
        masks = [m | (r << 15) for m, d in near for r, e in _flips(width - 15, 1 + allowance - d) if d + e <= 1 + allowance]
        out.append(np.array(sorted(set(masks)), np.uint64))
    return out


VISITOR, HOME, BOTH = 0, 1, 2


def anchor_rows(fp: np.ndarray, blocks=BLOCKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of fp, anchor key, role) for the homes and visits of all fingerprints, given as rows of 64-bit words.

    Where a block's only anchor is its own word, the fingerprint is home and visitor there in one row.
    """
    rows, keys, roles = [], [], []
    index = np.arange(len(fp))
    for b, (word_at, shift, width, allowance) in enumerate(blocks):
        word = (fp[:, word_at] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        tag = np.uint64(b << 48)
        if allowance == 0:
            rows.append(index), keys.append(word | tag), roles.append(np.full(len(fp), BOTH, np.int8))
            continue
        syndrome = np.zeros(len(fp), np.int64)
        for i in range(1, 16):
            syndrome ^= np.where((word >> np.uint64(i - 1)) & np.uint64(1), i, 0)
        for s, masks in enumerate(_visits(width, allowance)):
            of = index[syndrome == s]
            nearest = np.uint64(0 if s == 0 else 1 << (s - 1))
            rows.append(of), keys.append((word[of] ^ nearest) | tag), roles.append(np.full(len(of), HOME, np.int8))
            rows.append(np.repeat(of, len(masks)))
            keys.append((word[of][:, None] ^ masks[None, :]).ravel() | tag)
            roles.append(np.full(len(of) * len(masks), VISITOR, np.int8))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(roles)


def _matrix(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _replicate(blocks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                row, key, role = anchor_rows(_matrix(part.column(1)), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], ["key", "role", "rep", "fp"])

    return run


def spanning_forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning forest of the links ``(a, b)`` of lengths ``d``."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n, kept = len(a), []
    for e in np.argsort(d, kind="stable").tolist():
        x, y = find(int(at[e])), find(int(at[n + e]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(e)
    return a[kept], b[kept], d[kept]


def _compare(threshold: int):
    def links(group: np.ndarray, home: np.ndarray, rep: np.ndarray, fp: np.ndarray):
        """Rows are sorted by group, homes first; each home meets the later rows of its group."""
        found, held, k = [], 0, 1
        idx = np.flatnonzero(home)
        last = len(group)
        while len(idx):
            idx = idx[idx + k < last]
            idx = idx[group[idx + k] == group[idx]]
            d = np.zeros(len(idx), np.int16)
            for w in range(fp.shape[1]):
                d += np.bitwise_count(fp[idx, w] ^ fp[idx + k, w])
            near = (d <= threshold) & (d > 0)
            if near.any():
                hit = idx[near]
                found.append((rep[hit], rep[hit + k], d[near]))
                held += len(hit)
                if held > 300_000:
                    found = [spanning_forest(*(np.concatenate(x) for x in zip(*found)))]
                    held = len(found[0][0])
            k += 1
        return spanning_forest(*(np.concatenate(x) for x in zip(*found))) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None

        def out(cols):
            group = np.cumsum(np.concatenate(([False], np.any(cols[0][1:] != cols[0][:-1], axis=1))))
            pair = links(group, cols[1], cols[2], cols[3])
            if pair is not None:
                a, b, d = pair
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(d.astype(np.int32))], ["a", "b", "d"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j, home, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            cols = [np.stack((key, i.astype(np.int64), j.astype(np.int64)), 1), home.astype(bool), rep, _matrix(batch.column(5))]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols)]
            change = np.flatnonzero(np.any(cols[0][1:] != cols[0][:-1], axis=1))
            cut = change[-1] + 1 if len(change) else 0
            kept = [x[cut:] for x in cols]
            if cut:
                yield from out([x[:cut] for x in cols])
        if kept is not None and len(kept[1]):
            yield from out(kept)

    return run


def fingerprint_links(nodes: DataFrame, n_nodes: int, threshold: int = 4, blocks=BLOCKS) -> DataFrame:
    """``(rep, fp)``, one row per distinct fingerprint -> links ``(a, b, d)`` that span its components.

    Anchors are counted (in hashed buckets, combined before the shuffle); one with more than PIECE
    rows is split into pieces of homes x pieces of visitors, each its own group, so that no task
    holds an unbounded anchor. Each group returns at most a minimum spanning forest of its links.
    Complete for ``threshold`` up to the sum of the blocks' allowances plus their number less 1.
    """
    fp_type = nodes.schema["fp"].dataType.simpleString()
    rows = nodes.select("rep", "fp").mapInArrow(_replicate(blocks), f"key long, role byte, rep long, fp {fp_type}")
    buckets = 1 << max(10, int(n_nodes * 36 // 64).bit_length())
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets))
    hot = (rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECE)
           .select("bucket", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")))
    own = F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int")
    every, none = F.sequence(F.lit(0), F.col("pieces") - 1), F.array().cast("array<struct<i:int,j:int,home:boolean>>")
    place = lambda i, j, home: F.struct(i.alias("i"), j.alias("j"), F.lit(home).alias("home"))
    homes = F.when(F.col("role") != VISITOR, F.transform(every, lambda j: place(own, j, True))).otherwise(none)
    visits = F.when(F.col("role") != HOME, F.transform(every, lambda i: place(i, own, False))).otherwise(none)
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), (F.col("role") != VISITOR).alias("home")))
    dealt = (rows.withColumn("bucket", bucket).join(hot, "bucket", "left")
             .withColumn("at", F.explode(F.when(F.col("pieces").isNull(), alone).otherwise(F.concat(homes, visits))))
             .select("key", "at.i", "at.j", "at.home", "rep", "fp"))
    grouped = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("home"))
    return grouped.mapInArrow(_compare(threshold), "a long, b long, d int")


def simhash_components(docs: DataFrame, shingle_words: int = 4, threshold: int = 4) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, fingerprint, component_id)``, one row per input row.

    Exact copies share a fingerprint and become one node named by its smallest doc_id. Null and empty
    texts have fingerprint zero and are linked like any other; rows with a null doc_id keep a null-safe
    class of the other rows with their fingerprint. Repeated rows are returned as often as given.
    """
    prints = materialize(fingerprints(docs, shingle_words), "prints")
    nodes = materialize(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    if threshold > 4:
        raise ValueError("BLOCKS cover thresholds up to 4 bits")
    links = fingerprint_links(nodes, nodes.count(), threshold).select("a", "b")
    roots = connected_components(links)
    named = nodes.join(roots, nodes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp", "left").select("doc_id", digits.alias("fingerprint"), "component_id")


def _shingles(text: str | None, shingle_words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, k = b" ".join(words), min(shingle_words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), ends[k - 1 :].tolist())), np.uint64, len(starts)))


def _node(shingles: np.ndarray) -> int:
    """Names a shingle set: texts of equal sets are one node. Never negative, so differences fit a long."""
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) >> 1


def _shingle_rows(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [_shingles(t, shingle_words) for t in batch.column(0).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["token"])

    return run


def _shingle_sets(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [_shingles(t, shingle_words) for t in batch.column(1).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    return run


def common_shingles(docs: DataFrame, n_docs: int, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, count) of shingles that are common in about ORDER_DOCS documents, sorted by token.

    It only orders shingles from rare to common; every order finds the same pairs, this one fewest candidates.
    """
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_docs // ORDER_DOCS))) == 0).select("text")
    rows = some.mapInArrow(_shingle_rows(shingle_words), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = rows.where("n > 2").orderBy(F.desc("n"), "token").limit(ORDER_TOKENS).toPandas().sort_values("token")
    return top["token"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def _parity(x: np.ndarray) -> bytes:
    """Parity bits of a shingle set, two for each shingle at least: a power of two, so that wide ones fold to narrow ones."""
    width = max(BITS, 1 << (2 * len(x) - 1).bit_length() if len(x) else 0)
    return np.packbits(np.bincount((x & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def _mark(parity: bytes) -> bytes:
    """A parity folded to half its least width."""
    return np.bitwise_xor.reduce(np.frombuffer(parity, np.uint64).reshape(-1, BITS // 128), 0).tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """Bits in which two parities differ, the wider one folded to the width of the other."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    n = min(len(x), len(y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, n), 0) ^ np.bitwise_xor.reduce(y.reshape(-1, n), 0)).sum())


def _prefixes(shingle_words: int, similarity: float, common):
    """Per text: its node, set size, prefix from rare to common (the first ``rare`` of it not in ``common``), parity bits, and SimHash fingerprint of the set.

    Of the texts of one node that a task meets, the first has the last four, the others have none (a task that
    meets very many nodes forgets and says them again).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_for("near duplicates")
        token, count = common.value
        said: set[int] = set()
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(at, 256)
                node, size, rare, prefix, bits, mark, fp = [], [], [], [], [], [], []
                for text in part.column(1).to_pylist():
                    x = _shingles(text, shingle_words)
                    n, often = len(x), np.zeros(len(x), np.int64)
                    if n and len(token):
                        near = np.minimum(np.searchsorted(token, x.view(np.int64)), len(token) - 1)
                        often = np.where(token[near] == x.view(np.int64), count[near], 0)
                    node.append(_node(x)), size.append(n)
                    if node[-1] in said:
                        rare.append(0), prefix.append(None), bits.append(None), mark.append(None), fp.append(None)
                        continue
                    said = said if len(said) < NODES_SAID else set()
                    said.add(node[-1])
                    first = np.argsort(often, kind="stable")[: n - math.ceil(similarity * n - 1e-9) + 1]
                    prefix.append(x[first].view(np.int64)), rare.append(int((often[first] == 0).sum()))
                    bits.append(_parity(x)), mark.append(_mark(bits[-1])), fp.append(int(_majority(x).view(np.int64)[0]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(rare, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(mark, pa.binary()), pa.array(fp, pa.int64())], [f.split()[0] for f in _PRINT.split(", ")])

    return run


def _shared(x, y, similarity: float):
    """How many shingles sets of these sizes must share."""
    return np.ceil((x + y) * (similarity / (1 + similarity)) - 1e-9)


def _meet(similarity: float):
    """Pairs within a token's group that can still reach the similarity and are in different components.

    Rows are sorted by group and size; each row meets the later rows of its group that aren't too large for it.
    """

    def links(group, size, at, own, cross, node, root, mark):
        idx, k, last = np.arange(len(group)), 1, len(group)
        found, held = [], 0
        while len(idx):
            idx = idx[idx + k < last]
            to = idx + k
            idx = idx[(group[to] == group[idx]) & (size[to] * similarity <= size[idx] + 1e-9)]
            to = idx + k
            most = np.minimum(size[idx] - at[idx], size[to] - at[to])  # if this is the first token that they share
            need = _shared(size[idx], size[to], similarity)
            hit = np.flatnonzero((root[idx] != root[to]) & (~cross[idx] | (own[idx] != own[to])) & (most >= need))
            differ = np.bitwise_count(mark[idx[hit]] ^ mark[to[hit]]).sum(1, dtype=np.int64)
            hit = hit[differ <= (size[idx] + size[to] - 2 * need)[hit]]
            if len(hit):
                found.append((node[idx[hit]], node[to[hit]]))
                held += len(hit)
                if held > 300_000:
                    yield [np.concatenate(x) for x in zip(*found)]
                    found, held = [], 0
            k += 1
        if found:
            yield [np.concatenate(x) for x in zip(*found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None

        def out(cols):
            group = np.cumsum(np.concatenate(([False], np.any(cols[0][1:] != cols[0][:-1], axis=1))))
            for a, b in links(group, *cols[1:4], cols[0][:, 1] != cols[0][:, 2], *cols[4:]):
                pair = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(8)]
            cols = [np.stack(c[:3], 1), *c[3:], _matrix(batch.column(8))]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols)]
            change = np.flatnonzero(np.any(cols[0][1:] != cols[0][:-1], axis=1))
            cut = change[-1] + 1 if len(change) else 0
            kept = [x[cut:] for x in cols]
            if cut:
                yield from out([x[:cut] for x in cols])
        if kept is not None:
            yield from out(kept)

    return run


def _by_bits(similarity: float):
    """Keeps pairs whose parity bits allow the similarity: sets differ in as many shingles as their bits at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, n = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            differ = np.array([_differ(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            keep = pa.array((differ <= m + n - 2 * _shared(m, n, similarity)) & (np.minimum(m, n) + 1e-9 >= similarity * np.maximum(m, n)))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    return run


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both) if len(x) or len(y) else 1.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _without(pairs: DataFrame, compared: list[DataFrame]) -> DataFrame:
    return pairs.join(_all(compared), ["a", "b"], "left_anti") if compared else pairs


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float, shingle_words: int) -> tuple[DataFrame, DataFrame]:
    """(pairs that were compared, those of them whose exact shingle sets have the similarity).

    What other tables are joined with is written narrow before, so Spark sees its size and ships it or shuffles both sides.
    """
    side = lambda end, n, bits: nodes.select(F.col("node").alias(end), F.col("size").alias(n), F.col("bits").alias(bits))
    pairs = materialize(pairs, "pairs")
    likely = side("a", "m", "x").join(pairs, "a").join(side("b", "n", "y"), "b").select("a", "b", "m", "n", "x", "y").mapInArrow(_by_bits(similarity), "a long, b long")
    likely = materialize(likely, "likely")
    discard(pairs)
    ends = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = materialize(nodes.select("node", "doc_id").join(ends, "node", "left_semi").select("doc_id").distinct(), "ends")
    sets = docs.join(ends, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_shingle_sets(shingle_words), "node long, shingles binary")
    sets = materialize(sets.dropDuplicates(["node"]), "shingles")
    discard(ends)
    both = likely.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    sure = both.select("a", "b", "x", "y").mapInArrow(_jaccard, "a long, b long, similarity double").where(F.col("similarity") >= similarity)
    sure = materialize(sure.select("a", "b"), "sure")
    discard(sets)
    return likely, sure


_PRINT = "doc_id long, copy long, node long, size int, rare int, prefix array<long>, bits binary, mark binary, fp long"


def _central(k: int) -> Column:
    """Least for a node in the middle of its like: it has few rarer shingles of its own. ``k`` tells rounds apart."""
    return F.floor(F.col("at") / (1 + 2 * k)).cast("long") * F.lit(1 << 40) + F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 40))


def shared_tokens(firsts: DataFrame) -> DataFrame:
    """``(node, size, rare, prefix)`` -> ``(token, node, size, at, n, lead)`` of the tokens that several nodes have.

    A node may have several rows, which are the same. ``n``: rows of the token, ``lead``: a central one of its nodes. Tokens of the common list (of bounded size) are counted
    and joined back by broadcast, so no group of theirs is gathered; the rest are counted where one shuffle puts them.
    """
    rows = firsts.select("node", "size", "rare", F.posexplode("prefix").alias("at", "token"))
    often = rows.where("at >= rare")
    counted = often.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", _central(0)).alias("lead"), F.min("node").alias("low"), F.max("node").alias("high"))
    counted = counted.where("low <> high").select("token", "n", "lead")
    own = Window.partitionBy("token")
    rare = rows.where("at < rare").select("token", "node", "size", "at").withColumn("n", F.count(F.lit(1)).over(own)).withColumn("lead", F.min_by("node", _central(0)).over(own))
    rare = rare.withColumn("low", F.min("node").over(own)).withColumn("high", F.max("node").over(own)).where("low <> high").drop("low", "high")
    return rare.unionByName(often.select("token", "node", "size", "at").join(F.broadcast(counted), "token"))


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """``(node, fp)`` -> pairs ``(a, b)``, a > b, that join all nodes whose fingerprints are linked: equal ones through their least node, others by :func:`fingerprint_links`."""
    reps = materialize(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "fingerprints")
    equal = nodes.join(reps, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    return equal.union(fingerprint_links(reps, reps.count()).select("a", "b"))


def similar_classes(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, copy, node`` of each row, ``node, root`` of each node with links), over all pairs at ``similarity``.

    ``docs`` are ``(doc_id, text, copy)``; copy is a digest of the text, which tells rows of one doc_id apart.

    Nodes whose SimHash fingerprints are linked by anchors (:func:`fingerprint_pairs`) are compared first. What these
    verified links leave apart follows, as a fingerprint's distance only estimates a similarity: two sets of that similarity share one of their rarest shingles, of which each needs only a prefix. In each of
    ROUNDS rounds a token's nodes are compared with one of them, which joins most of what belongs together in
    pairs that grow with the nodes; then all pairs that components of these verified links leave apart. Sizes,
    positions and parity bits rule out only what cannot reach the similarity, and exact sets decide on the rest,
    so no pair at the similarity stays unlinked, and none below it is linked.
    """
    spark, n_docs = docs.sparkSession, docs.count()
    common = spark.sparkContext.broadcast(common_shingles(docs, n_docs, shingle_words))
    prints = materialize(docs.mapInArrow(_prefixes(shingle_words, similarity, common), _PRINT), "prints")
    firsts = prints.where("prefix IS NOT NULL")
    nodes = materialize(firsts.select("node", "doc_id", "size", "bits", "mark", "fp").dropDuplicates(["node"]), "nodes")
    rows = materialize(shared_tokens(firsts), "tokens")
    pairs = rows.where("node <> lead").select("node", "lead")
    new, verified = _verified(fingerprint_pairs(nodes.select("node", "fp")), docs, nodes, similarity, shingle_words)
    compared, sure, apart = [new], [verified], rows
    for k in range(ROUNDS):
        ends = pairs.select(F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b")).distinct()
        new, verified = _verified(_without(ends, compared), docs, nodes, similarity, shingle_words)
        compared.append(new), sure.append(verified)
        roots = materialize(connected_components(_all(sure)), "roots")
        rooted = apart.select("token", "node", "size", "at", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        turn = _central(k + 1)
        leads = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by("node", turn).alias("lead"), F.min_by("root", turn).alias("lead_root"))
        before = apart
        apart = materialize(rooted.join(leads.where("low <> high").select("token", "lead", "lead_root"), "token"), "apart")
        for done in (before, roots):
            discard(done)
        pairs = apart.where("root <> lead_root")
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    dealt = (apart.join(nodes.select("node", "mark"), "node")
             .withColumn("own", F.pmod(F.xxhash64("node"), pieces).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
             .select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "size", "at", "own", "node", "root", "mark"))
    grouped = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "size")
    rest = grouped.mapInArrow(_meet(similarity), "a long, b long").distinct()
    new, verified = _verified(_without(rest, compared), docs, nodes, similarity, shingle_words)
    links = materialize(_all([*sure, verified]), "all-links")
    for done in (nodes, apart, *compared, new, *sure, verified):
        discard(done)
    return prints.select("doc_id", "copy", "node"), connected_components(links)


def _rooted(docs: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """``(doc_id, copy, root)`` of each row with a doc_id."""
    d = need(docs, "doc_id", "text").where("doc_id IS NOT NULL").withColumn("copy", F.xxhash64("text"))
    prints, roots = similar_classes(d, similarity, shingle_words)
    return prints.join(roots, "node", "left").select("doc_id", "copy", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, component_id)``: documents linked by Jaccard similarity of their shingles.

    Every pair at the similarity is a link (see :func:`similar_classes`). Null and empty texts are copies of each
    other. Rows of a null doc_id form no class and are not returned.
    """
    rooted = _rooted(docs, similarity, shingle_words)
    return rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def keep_first(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5) -> DataFrame:
    """All columns of ``docs``, of each class of near duplicates only the document with the smallest doc_id.

    Rows that repeat both doc_id and text count as one document, rows of one doc_id with different texts as
    several; rows with a null doc_id stay.
    """
    rooted = _rooted(docs, similarity, shingle_words)
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "copy")).alias("first"))
    # a text is of one class, so those to go are met by their own keys, not by their class's, which may hold a third of all
    gone = rooted.select("doc_id", "copy").join(first.select("first.doc_id", "first.copy"), ["doc_id", "copy"], "left_anti")
    gone = materialize(gone.select(F.col("doc_id").alias("gone_id"), F.col("copy").alias("gone_copy")).distinct(), "gone")
    again = materialize(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("gone_id")), "again")
    kept = docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_copy"]), "left_anti")
    if again.isEmpty():
        return kept
    once = kept.join(again, kept["doc_id"] == again["gone_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, kept["doc_id"] == again["gone_id"], "left_anti").unionByName(once)
