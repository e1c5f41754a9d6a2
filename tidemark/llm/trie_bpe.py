"""Byte-level BPE by a prefix-sharing trie traversal.

The encoding of a prefix is fixed by its last token: the encoding of ``word[:i]`` is that of
``word[:i - len(t)]`` followed by ``t``, where ``t`` is the one token that ends there and that the
merge rules would keep beside the last token before it. So the state of a trie node is just its last
token. Distinct pre-tokens are visited in byte order, which is the depth-first order of their trie: a
stack of last tokens is cut back to the prefix that the next word shares and grown by its new bytes,
so a prefix that many words share is worked out once.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .storage import need
from .workers import held as held_for

#: Distinct pre-tokens in the newer half of what a Python worker remembers. A full half becomes the older
#: one, from which words still in use move up again, and the one before it goes.
REMEMBERED = 160_000
#: Pairs of neighbouring tokens that a Python worker remembers; it starts afresh beyond that.
PAIRS = 400_000
#: Longer pre-tokens are encoded but not remembered.
LONG = 256
#: Pre-tokenisation of byte-level BPE with its published pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TrieBpe:
    """Encoder and decoder for one byte-level vocabulary with ranked merges."""

    def __init__(self, spec: dict):
        import regex

        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        raw = lambda piece: bytes(letters[c] for c in piece)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.bytes_of[i] = raw(t)
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.rank: dict[int, int] = {}
        self.left, self.right, self.made_at = array("i", [-1]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        for r, pair in enumerate(model["merges"]):
            left, right = pair if not isinstance(pair, str) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank.setdefault(a << 24 | b, r)
            if self.made_at[c] < 0:
                self.left[c], self.right[c], self.made_at[c] = a, b, r
        self.fits: dict[int, bool] = {}
        whole: dict[int, bool] = {}
        self.usable = {self.bytes_of[i]: i for i in vocab.values() if self.reachable(i, whole)}
        ending: dict[bytes, set[int]] = {}
        for t in self.usable:
            if len(t) > 2:
                ending.setdefault(t[-3:], set()).add(len(t))
        #: Lengths of the tokens that end with three bytes, long ones first; those of two bytes and one are always tried.
        self.ending = {e: (*sorted(n, reverse=True), 2, 1) for e, n in ending.items()}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None

    def kept_apart(self, a: int, b: int, limit: int = 1 << 40) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` in rank order ends in exactly these two tokens.

        Undo the latest merge on either side of the border, step by step: at each earlier moment the two
        pieces that faced each other must not have had a merge that ranks before those already undone.
        ``limit``: only merges ranked before it count.
        """
        left, right, ok = a, b, True
        while True:
            r = self.rank.get(left << 24 | right)
            if r is not None and r < limit:
                ok = False
                break
            ra, rb = self.made_at[left], self.made_at[right]
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # of equal ranks the left one merges first
                limit, left = ra, self.right[left]
            else:
                limit, right = rb + 1, self.left[right]
        return ok

    def reachable(self, token: int, known: dict[int, bool]) -> bool:
        """Whether the merges turn the token's own bytes into it."""
        ok = known.get(token)
        if ok is None:
            a, b = self.left[token], self.right[token]
            ok = known[token] = a < 0 or self.reachable(a, known) and self.reachable(b, known) and self.kept_apart(a, b, self.made_at[token])
        return ok

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Token ids of distinct words, given in byte order."""
        last: list[int] = [-1]
        path = b""
        get, ending, fits, known = self.usable.get, self.ending.get, self.fits, self.fits.get
        for word in words:
            if len(fits) > PAIRS:
                fits.clear()
            shared = len(os.path.commonprefix((path, word)))
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for n in ending(word[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                    start = end - n
                    if start < 0 or (token := get(word[start:end])) is None:
                        continue
                    if start:
                        key = last[start] << 24 | token
                        ok = known(key)
                        if ok is None:
                            ok = fits[key] = self.kept_apart(last[start], token)
                        if not ok:
                            continue
                    last.append(token)
                    break
                else:
                    raise ValueError(f"no token ends at byte {end} of {word[:80]!r}")
            path, ids, at = word, [], len(word)
            while at:
                ids.append(last[at])
                at -= len(self.bytes_of[last[at]])
            yield word, ids[::-1]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut, new = [], set()
        words = self.words
        for text in texts:
            parts = self.split(text or "") if self.split else [text or ""]
            tokens = self.find(parts[0]) if len(parts) == 1 else [t for k, p in enumerate(parts) for t in ([(p,)] if k % 2 else self.find(p))]
            cut.append(tokens)
            new.update(tokens)
        if len(words) + len(new) > REMEMBERED:
            self.older, self.words = words, {}
            words = self.words
        used, new, older = new, [], self.older
        for w in used:
            if w not in words:
                if w in older:
                    words[w] = older[w]
                else:
                    new.append(w)
        specials = [w for w in new if isinstance(w, tuple)]
        raw = {w.encode("utf-8", "surrogatepass"): w for w in new if not isinstance(w, tuple)}
        for word, ids in self.encode_words(sorted(raw)):
            words[raw[word]] = struct.pack(f"<{len(ids)}I", *ids)
        for w in specials:
            words[w] = struct.pack("<I", self.special[w[0]])
        out = [b"".join([words[w] for w in tokens]) for tokens in cut]
        for w in new:
            if len(w) > LONG:
                del words[w]
        return out

    def decode(self, ids: bytes) -> str:
        """Text of little-endian ids; bytes that are not UTF-8 become U+FFFD."""
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _tokenizer(held) -> TrieBpe:
    mine, key = held_for("bpe"), held.value[0]
    if key not in mine:
        mine.clear()
        mine[key] = TrieBpe(json.loads(held.value[1]))
    return mine[key]


def _ship(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        raw = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(raw).hexdigest(), raw))


def _through(docs: DataFrame, tokenizer_path: str, schema: str, make) -> DataFrame:
    """``make(tokenizer, slice of a batch)`` gives the columns of ``schema`` for each slice of ``docs``.

    The vocabulary (of fixed size) is read on the driver and broadcast. No shuffle.
    """
    held, names = _ship(docs.sparkSession, tokenizer_path), [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(held)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 256):
                yield pa.RecordBatch.from_arrays(make(bpe, batch.slice(at, 256)), names)

    return docs.mapInArrow(run, schema)


def _encoded(bpe: TrieBpe, part: pa.RecordBatch) -> list[pa.Array]:
    ids = bpe.encode_batch(part.column(1).to_pylist())
    return [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]


def _decoded(bpe: TrieBpe, columns: list[pa.Array]) -> list[pa.Array]:
    return [*columns, pa.array([bpe.decode(x or b"") for x in columns[2].to_pylist()], pa.string())]


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, n_tokens, ids binary)``: little-endian unsigned 32-bit ids.

    Whole texts, special tokens of the vocabulary recognised in the text, none added. Null and empty
    texts have no ids. Each batch's distinct words go through the trie where the batch is.
    """
    return _through(need(docs, "doc_id", "text"), tokenizer_path, "doc_id long, n_tokens long, ids binary", _encoded)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` and ``text``, the decoded ids with special tokens written out; null ids have an empty text."""
    return _through(need(encoded, "doc_id", "n_tokens", "ids"), tokenizer_path, "doc_id long, n_tokens long, ids binary, text string", lambda bpe, part: _decoded(bpe, part.columns))


def encode_and_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, n_tokens, ids, text)``, text decoded from the ids: both in one pass of one worker a task."""
    return _through(need(docs, "doc_id", "text"), tokenizer_path, "doc_id long, n_tokens long, ids binary, text string", lambda bpe, part: _decoded(bpe, _encoded(bpe, part)))
