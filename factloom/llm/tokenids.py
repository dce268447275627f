"""Token-id files in patched frame-of-reference blocks.

Every text is encoded whole with a tokenizer of the ``tokenizers`` library (special strings inside a
text are ordinary text), an end id is appended, and the ids of all documents follow each other in
ascending order of their ids (nulls first). A range exchange puts the documents in order; each task
cuts its stretch into segments of about ``SEGMENT_IDS`` ids, so a task holds one segment at a time.

Segment layout (little-endian):

    magic "PFR1", ids u64, documents u32, blocks u32
    documents: id i64[], null u8[], ids of each u64[]
    blocks:    minimum u32[], width u8[], exceptions u16[], start of each block's bytes u64[]
    bytes of each block: its ids less the minimum, packed at the width (low bits first),
                         then the exceptions' places u16[] and their bits above the width u32[]

A block has ``BLOCK`` ids (the last one of a segment fewer). Its width holds the ``PERCENTILE``-th
percentile of its values; larger values keep their low bits in place and the rest in the exceptions.
Any block can be read alone through its start.

Segments are rows of a Parquet table (part, segment, ids before it in the part, ids, payload), so Spark's commit protocol makes
retried tasks harmless and any store that Spark can write will do. The first id's number of each part
is in the table ``<path>-parts``, from one count for each part.

Encoding cuts a batch of texts into the words between single spaces and line ends, which the
tokenizer's pattern never joins, and encodes each different word of the batch once; words of up to
``LONG`` bytes stay in a memo in each worker, which knows them by 128 bits of hash and is bounded by
bytes (:class:`_Memo`). A word of Latin letters with ASCII punctuation after it is two of the pieces into
which the tokenizer's pattern cuts texts, so letters and punctuation not met before go to its model as they
are, and letters met with other punctuation are known. Other words not met before go through the tokenizer,
many in one text; texts with white space of other kinds are encoded as a whole.

Defined cases: null texts count as empty and have the end id only; repeated ids keep one entry each,
in the order in which Spark reads them; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

BLOCK, PERCENTILE, SEGMENT_IDS = 256, 90, 1 << 19
MAGIC = b"PFR1"
#: Bytes of a worker's memo before it is trimmed, and of the longest word that is kept.
MEMO_BYTES, LONG = 128 << 20, 64
NEW, APART = -1, -2
#: New words that go through the tokenizer in one text.
JOINED = 1000
#: Texts encoded at a time.
TEXTS_BYTES = 4 << 20

_OTHER = re.compile(r"[^\S \n]|[\x00-\x09\x0b-\x1f\x7f-\xa0]")
_RUN = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: A word of letters, ASCII punctuation after them: the pattern cuts it between the two and nowhere else. The letters are those that all editions of Unicode since 5.0 call so.
_WORD = r"\A(?P<letters>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<after>[!-/:-@\[-`{-~]*)\z"
#: Texts that are empty, begin or end with white space, or have more than one space or line end in a row.
_UNEVEN = r"\A\z|\A[ \n]|[ \n]\z|[ \n][ \n]"


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


#: The letter of each byte, line ends kept.
_LETTERS = np.array([0x0A if b == 0x0A else c for b, c in sorted(_byte_letters().items())], dtype="<u4")


# ---- blocks -----------------------------------------------------------------------------------


def _width(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def _squeezed(values: np.ndarray, w: int) -> np.ndarray:
    """The low ``w`` bits of each value (rows of BLOCK), one after the other: eight of them are w bytes."""
    if w > 16:
        bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :w]
        return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")
    v = (values & ((1 << w) - 1)).astype(np.uint64).reshape(-1, 8)
    four = lambda k: v[:, k] | v[:, k + 1] << np.uint64(w) | v[:, k + 2] << np.uint64(2 * w) | v[:, k + 3] << np.uint64(3 * w)
    low, high = four(0), four(4)
    out = np.empty((len(v), 2), dtype="<u8")
    out[:, 0] = low | (high << np.uint64(4 * w) if w < 16 else 0)
    out[:, 1] = high >> np.uint64(64 - 4 * w) if w else 0
    return out.view(np.uint8)[:, :w]


def _spread(raw: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """The values of whole blocks of width ``w`` that begin at the bytes ``at`` of ``raw``, which ends with 8 spare bytes."""
    bit = np.arange(BLOCK) * w
    return (_at(raw, "<u8", at[:, None] + (bit >> 3)) >> (bit & 7).astype(np.uint64) & np.uint64((1 << w) - 1)).astype(np.int64)


def _at(raw: np.ndarray, kind: str, at: np.ndarray) -> np.ndarray:
    """The numbers of ``kind`` that begin at the bytes ``at`` of ``raw``, which ends with 8 spare bytes."""
    return np.ndarray((len(raw) - 7,), dtype=kind, buffer=raw, strides=(1,))[at]


def pack(ids: np.ndarray, documents: list[tuple[int | None, int]]) -> bytes:
    """One segment. ``documents``: id and number of ids of each, in order."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, dtype=np.int64)
    padded[:n] = ids
    if n:
        padded[n:] = ids[-1]
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, dtype=np.int64)
    over = grid - low[:, None]
    width = _width(np.percentile(over, PERCENTILE, axis=1, method="higher")) if blocks else np.zeros(0, dtype=np.int64)
    high = over >> width[:, None]
    sizes = np.full(blocks, BLOCK)
    if blocks:
        sizes[-1] = n - (blocks - 1) * BLOCK
        high[-1, sizes[-1] :] = 0
    exceptions = (high > 0).sum(axis=1)
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        lines = _squeezed(over[rows], w).tobytes()
        each = BLOCK * w // 8
        for k, r in enumerate(rows.tolist()):
            packed[r] = lines[k * each : k * each + -(-int(sizes[r]) * w // 8)]
    rows, at = np.nonzero(high)
    places, above, last = at.astype("<u2").tobytes(), high[rows, at].astype("<u4").tobytes(), np.cumsum(exceptions).tolist()
    for r in np.flatnonzero(exceptions).tolist():
        a, b = last[r - 1] if r else 0, last[r]
        packed[r] += places[2 * a : 2 * b] + above[4 * a : 4 * b]
    starts = np.cumsum([0, *map(len, packed)])[:-1]
    head = MAGIC + np.array([n], "<u8").tobytes() + np.array([len(documents), blocks], "<u4").tobytes()
    docs = np.array([d or 0 for d, _ in documents], "<i8").tobytes() + np.array([d is None for d, _ in documents], "u1").tobytes() + np.array([c for _, c in documents], "<u8").tobytes()
    index = low.astype("<u4").tobytes() + width.astype("u1").tobytes() + exceptions.astype("<u2").tobytes() + starts.astype("<u8").tobytes()
    return head + docs + index + b"".join(packed)


class Segment:
    """A packed segment: its documents, and its ids by block or all together."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        self._at, self._raw = 4, payload
        (self.n_ids,) = self._take("<u8", 1)
        n_docs, self.n_blocks = self._take("<u4", 2).tolist()
        ids, null = self._take("<i8", n_docs), self._take("u1", n_docs)
        self.documents = [None if x else int(d) for d, x in zip(ids, null, strict=True)]
        self.counts = self._take("<u8", n_docs).astype(np.int64)
        self._low, self._width, self._exceptions, self._starts = (self._take(t, self.n_blocks) for t in ("<u4", "u1", "<u2", "<u8"))

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._raw, dtype=kind, count=n, offset=self._at)
        self._at += out.nbytes
        return out

    def size(self, block: int) -> int:
        return min(BLOCK, int(self.n_ids) - block * BLOCK)

    def block(self, k: int) -> np.ndarray:
        """The ids of block ``k`` alone."""
        n, w, x = self.size(k), int(self._width[k]), int(self._exceptions[k])
        at = self._at + int(self._starts[k])
        long = -(-n * w // 8)
        values = np.zeros(n, dtype=np.int64)
        if w:
            bits = np.unpackbits(np.frombuffer(self._raw, np.uint8, long, at), count=n * w, bitorder="little").reshape(n, w)
            values = bits.astype(np.int64) @ (1 << np.arange(w, dtype=np.int64))
        if x:
            places = np.frombuffer(self._raw, "<u2", x, at + long)
            values[places] |= np.frombuffer(self._raw, "<u4", x, at + long + 2 * x).astype(np.int64) << w
        return values + int(self._low[k])

    def ids(self) -> np.ndarray:
        """All ids; whole blocks of one width are unpacked together, and the exceptions of all whole blocks."""
        if not self.n_blocks:
            return np.zeros(0, np.int64)
        out = np.zeros((self.n_blocks, BLOCK), dtype=np.int64)
        raw = np.frombuffer(self._raw + bytes(8), np.uint8)
        whole, at = self.n_blocks - 1, self._at + self._starts.astype(np.int64)
        for w in np.unique(self._width[:whole]).tolist():
            rows = np.flatnonzero(self._width[:whole] == w)
            if w:
                out[rows] = _spread(raw, at[rows], w)
        x, w = self._exceptions[:whole].astype(np.int64), self._width[:whole].astype(np.int64)
        row, high = np.repeat(np.arange(whole), x), at[:whole] + BLOCK * w // 8
        k = np.arange(len(row)) - np.repeat(np.cumsum(x) - x, x)
        out[row, _at(raw, "<u2", high[row] + 2 * k)] |= _at(raw, "<u4", (high + 2 * x)[row] + 4 * k).astype(np.int64) << w[row]
        out[:whole] += self._low[:whole].astype(np.int64)[:, None]
        return np.concatenate([out[:whole].ravel(), self.block(whole)])


# ---- encoding ---------------------------------------------------------------------------------


#: Multipliers of the two hashes by which a word is known, and what tells words after a space from others.
_BASES, _AFTER_SPACE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _hashes(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 64 bits of each word, from sums over all bytes of all words."""
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    begin, end = ends[:-1] - ends[0], ends[1:] - ends[0]
    out = []
    for base in _BASES:
        power, back = np.full((2, len(raw) + 1), base, dtype=np.uint64)
        back[:] = pow(base, -1, 1 << 64)
        power[0] = back[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(back, out=back)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(raw * power[:-1], out=sums[1:])
        value = (sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64)
        value *= np.uint64(base)
        out.append(value ^ (value >> np.uint64(29)))
    return out[0], out[1]


def _joins(words: pa.LargeStringArray, between: str) -> list[str]:
    """The words, ``JOINED`` of them in one text."""
    lists = pa.ListArray.from_arrays(pa.array([*range(0, len(words), JOINED), len(words)], pa.int32()), words.cast(pa.string()))
    return pc.binary_join(lists, between).to_pylist()


class _Memo:
    """Ids of words, known by two hashes; all in flat arrays.

    It lasts as long as the worker. When its size reaches ``MEMO_BYTES``, only the words that two batches or
    more have met are kept (none if those are over half of it).
    """

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are what runs side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        letters = _byte_letters()
        space = chr(letters[0x20])
        self.newline = vocabulary.get(chr(letters[0x0A]), NEW)
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith(space)]] = True
        # The shortcuts of the encoder hold for byte-level BPE with the usual pattern; anything else is encoded whole.
        spec = json.loads(tokenizer)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None
        self.split = usual and model.get("type") == "BPE" and not model.get("dropout") and all(t["special"] for t in spec.get("added_tokens") or []) and self.newline != NEW
        self._clear()

    def _clear(self) -> None:
        self.keys, self.checks = np.zeros((2, 0), dtype=np.uint64)  # sorted by key
        self.entry = np.zeros(0, dtype=np.int32)
        self.met = np.zeros(0, dtype=np.uint8)  # batches that met the word, 2 for more
        self.pool, self.starts = array("I"), array("i", [0])
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @property
    def bytes(self) -> int:
        return 21 * len(self.keys) + 4 * len(self.starts) + 4 * len(self.pool)

    def add_all(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Entries of ``counts`` ids each; the number of the first."""
        first, end = len(self.starts) - 1, len(self.pool)
        self.pool.frombytes(ids.astype("<u4").tobytes())
        self.starts.frombytes((end + np.cumsum(counts)).astype("<i4").tobytes())
        return first

    def ids_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries, one after the other, and how many of each."""
        starts, pool = np.frombuffer(self.starts, dtype=np.int32), np.frombuffer(self.pool, dtype="<u4") if self.pool else np.zeros(0, "<u4")
        begin = starts[entries].astype(np.int64)
        counts = starts[entries + 1] - begin
        return pool[np.arange(counts.sum()) + np.repeat(begin - (np.cumsum(counts) - counts), counts)], counts

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The entry of each word, NEW for words that are not known."""
        order = np.argsort(keys)  # in order the search walks through the memo once
        at = np.minimum(np.searchsorted(self.keys, keys[order]), max(0, len(self.keys) - 1))
        out = np.full(len(keys), NEW, dtype=np.int64)
        if len(self.keys):
            same = (self.keys[at] == keys[order]) & (self.checks[at] == checks[order])
            out[order[same]] = self.entry[at[same]]
            self.met[at[same]] = 2
        return out

    def keep(self, keys: np.ndarray, checks: np.ndarray, entries: np.ndarray) -> None:
        """Know new words from the next :meth:`settle` on."""
        self.fresh.append((keys, checks, entries))

    def settle(self) -> None:
        """Put the new words among the others, all at once."""
        if not self.fresh:
            return
        keys, checks, entries = (np.concatenate(x) for x in zip(*self.fresh, strict=True))
        self.fresh = []
        order = np.argsort(keys)
        order = order[np.r_[True, np.diff(keys[order]) != 0][: len(order)]]  # punctuation may be met alone and after letters
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.checks = np.insert(self.keys, at, keys[order]), np.insert(self.checks, at, checks[order])
        self.entry, self.met = np.insert(self.entry, at, entries[order].astype(np.int32)), np.insert(self.met, at, 1)

    def trim(self) -> None:
        if self.bytes <= MEMO_BYTES:
            return
        often = self.met > 1
        keys, checks = self.keys[often], self.checks[often]
        ids, counts = self.ids_of(self.entry[often])
        self._clear()
        first = self.add_all(ids, counts)
        self.keep(keys, checks, first + np.arange(len(keys)))
        self.settle()
        if self.bytes > MEMO_BYTES // 2:
            self._clear()


#: The memo of each tokenizer in this worker.
_MEMOS: dict[str, _Memo] = {}


class Encoder:
    """Ids of texts as little-endian u32 bytes."""

    def __init__(self, tokenizer: str, name: str) -> None:
        if name not in _MEMOS:
            _MEMOS[name] = _Memo(tokenizer)
        self.memo = _MEMOS[name]

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.memo.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: pa.LargeStringArray, after_space: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without white space, all together, and how many of each; ``JOINED`` words are one text.

        After a space each word's first id, and no other, begins with the space; line ends are ids of their own.
        """
        between = " " if after_space else "\n"
        texts = [between + t for t in _joins(words, between)]
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(x, dtype="<u4") for x in self._plain(texts))])
        begins = np.flatnonzero(self.memo.spaced[ids] if after_space else ids == self.memo.newline)
        if len(begins) != len(words):
            raise ValueError("words and ids do not match")
        counts = np.diff(np.r_[begins, len(ids)])
        return (ids, counts) if after_space else (np.delete(ids, begins), counts - 1)

    def _pieces(self, pieces: pa.LargeStringArray, after_space: bool) -> np.ndarray:
        """The entry of each of the pattern's pieces (all different), which the model encodes as they are if they are new."""
        keys, checks = (h ^ _AFTER_SPACE if after_space else h for h in _hashes(pieces))
        out = self.memo.find(keys, checks)
        new = np.flatnonzero(out == NEW)
        if not len(new):
            return out
        part = pieces.take(pa.array(new))
        space = " " if after_space else ""
        text = space + f"\n{space}".join(_joins(part, f"\n{space}"))
        letters = _LETTERS[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes().decode("utf-32-le").split("\n")
        encode, ids, counts = self.memo.tokenizer.model.tokenize, array("I"), array("q")
        for lo in range(0, len(letters), JOINED):
            tokens = [encode(piece) for piece in letters[lo : lo + JOINED]]
            ids.extend([t.id for piece in tokens for t in piece])
            counts.extend(map(len, tokens))
        out[new] = self.memo.add_all(np.array(ids), np.array(counts)) + np.arange(len(new))
        short = new[np.asarray(pc.binary_length(part)) <= LONG]
        self.memo.keep(keys[short], checks[short], out[short])
        return out

    def _lettered(self, letters: pa.LargeStringArray, after: pa.LargeStringArray, after_space: bool) -> np.ndarray:
        """The entry of each word, given as its letters and the punctuation after them."""
        letters, after = letters.dictionary_encode(), after.dictionary_encode()
        out = self._pieces(letters.dictionary, after_space)[np.asarray(letters.indices)]
        tailed = np.flatnonzero(np.asarray(pc.binary_length(after.dictionary))[np.asarray(after.indices)])
        if len(tailed):
            tails = np.zeros(len(after.dictionary), dtype=np.int64)
            some = np.flatnonzero(np.asarray(pc.binary_length(after.dictionary)))
            tails[some] = self._pieces(after.dictionary.take(pa.array(some)), after_space=False)
            both = np.stack([out[tailed], tails[np.asarray(after.indices)[tailed]]], axis=1)
            ids, counts = self.memo.ids_of(both.ravel())
            out[tailed] = self.memo.add_all(ids, counts.reshape(-1, 2).sum(axis=1)) + np.arange(len(tailed))
        return out

    def _entries(self, words: pa.LargeStringArray, hashes: tuple[np.ndarray, np.ndarray], after_space: bool) -> np.ndarray:
        """The entry of each word (all different), APART for one that is not to be encoded apart."""
        keys, checks = (h ^ _AFTER_SPACE if after_space else h for h in hashes)
        out = self.memo.find(keys, checks)
        new = np.flatnonzero(out == NEW)
        met = words.take(pa.array(new))
        cut = pc.extract_regex(met, _WORD)
        plain = np.asarray(cut.is_valid())
        if plain.any():
            letters, after = cut.drop_null().flatten()
            which = new[plain]
            out[which] = self._lettered(letters, after, after_space)
            tailed = which[np.asarray(pc.and_(pc.greater(pc.binary_length(after), 0), pc.less_equal(pc.binary_length(words.take(pa.array(which))), LONG)))]
            self.memo.keep(keys[tailed], checks[tailed], out[tailed])  # the others are known by their letters
            new, met = new[~plain], met.filter(pa.array(~plain))
        single = np.zeros(len(new), dtype=bool)
        if not after_space:  # runs with white space inside
            single = np.asarray(pc.or_(pc.match_substring(met, " "), pc.match_substring(met, "\n")))
        apart = np.zeros(len(new), dtype=bool)
        if any(_OTHER.search(t) for t in _joins(met, " ")):
            apart[:] = [bool(_OTHER.search(w)) for w in met.to_pylist()]
            out[new[apart]] = APART
            single &= ~apart
        many = np.flatnonzero(~(single | apart))
        if len(many):
            part = met.take(pa.array(many))
            first = self.memo.add_all(*self._joined(part, after_space))
            out[new[many]] = first + np.arange(len(many))
            short = np.asarray(pc.binary_length(part)) <= LONG
            which = new[many[short]]
            self.memo.keep(keys[which], checks[which], out[which])
        for k, ids in zip(np.flatnonzero(single), self._plain(met.take(pa.array(np.flatnonzero(single))).to_pylist()), strict=True):
            out[new[k]] = self.memo.add_all(np.array(ids, dtype="<u4"), np.array([len(ids)]))
        return out

    def __call__(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.memo.split:
            return [np.array(x, "<u4").tobytes() for x in self._plain(texts.to_pylist())]
        self.memo.trim()
        # Texts of words with single spaces and line ends between them are cut by Arrow, others into runs.
        odd = pc.match_substring_regex(texts, _UNEVEN)
        even, rest = np.flatnonzero(~np.asarray(odd)), np.flatnonzero(odd)
        cut = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n "), " ")
        runs = [_RUN.findall(t) for t in texts.filter(odd).to_pylist()]
        counts = np.r_[np.diff(np.asarray(cut.offsets)), [len(r) for r in runs]].astype(np.int64)
        words = pa.concat_arrays([cut.flatten(), pa.array([w for r in runs for w in r], pa.large_string())]).dictionary_encode()
        code, known = np.asarray(words.indices), words.dictionary
        ends = np.cumsum(counts)
        line_end = code == (known.index("\n").as_py() if len(known) else -2)
        bare = np.r_[True, line_end[:-1]] | line_end if len(code) else line_end
        bare[(ends - counts)[counts > 0]] = True
        bare[int(counts[: len(even)].sum()) :] = True
        # Each different word once, after a space and at the beginning of a line.
        at = np.zeros((2, len(known)), dtype=np.int64)
        hashes = _hashes(known) if len(known) else (at[0], at[0])
        for after_space in (False, True):
            here = np.zeros(len(known), dtype=bool)
            here[code[bare != after_space]] = True
            which = np.flatnonzero(here)
            if len(which):
                at[int(after_space), which] = self._entries(known.take(pa.array(which)), (hashes[0][which], hashes[1][which]), after_space)
        self.memo.settle()
        entry = at.astype(np.int32).ravel()[code + np.where(bare, 0, len(known)).astype(np.int32)]
        apart = np.unique(np.searchsorted(ends, np.flatnonzero(entry == APART), side="right"))
        entry[entry == APART] = 0
        starts, pool = np.frombuffer(self.memo.starts, dtype=np.int32), np.frombuffer(self.memo.pool, dtype="<u4") if self.memo.pool else np.zeros(0, "<u4")
        begin = starts[entry]
        n = starts[entry + 1] - begin if len(entry) else entry
        total = np.cumsum(n, dtype=np.int64)
        # Steps of one inside a word, and from the end of one word's ids to the beginning of the next one's.
        step = np.ones(int(total[-1]) if len(total) else 0, dtype=np.int32)
        some = np.flatnonzero(n)
        if len(some):
            step[0] = begin[some[0]]
            step[(total - n)[some[1:]]] = begin[some[1:]] - (begin + n)[some[:-1]] + 1
        ids = pool[np.cumsum(step, dtype=np.int32)]
        last = np.r_[0, total][ends]
        order = np.r_[even, rest]
        out: list[bytes] = [b""] * len(texts)
        for k, a, b in zip(order.tolist(), np.r_[0, last[:-1]].tolist(), last.tolist(), strict=True):
            out[k] = ids[a:b].tobytes()
        whole = [int(order[k]) for k in apart]
        for k, x in zip(whole, self._plain(texts.take(pa.array(whole, pa.int64())).to_pylist()), strict=True):
            out[k] = np.array(x, "<u4").tobytes()
        return out


def _writer(tokenizer: object, name: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer.value, name)
        part, segment = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = before = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            row = {"part": part, "segment": segment, "before": before, "ids": len(ids), "payload": pack(ids, [(d, len(x) // 4) for d, x in held])}
            return pa.RecordBatch.from_pylist([row], _SEGMENTS)

        for batch in batches:
            texts, ids = batch.column("text").fill_null(""), batch.column("doc_id").to_pylist()
            ends = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TEXTS_BYTES, side="right")))
                for d, x in zip(ids[lo:hi], encoder(texts.slice(lo, hi - lo)), strict=True):
                    held.append((d, x + end))
                    size += len(x) // 4 + 1
                    if size >= SEGMENT_IDS:
                        yield flush()
                        held, size, before, segment = [], 0, before + size, segment + 1
                lo = hi
        if held:
            yield flush()

    return write


_SEGMENTS = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("ids", pa.int64()), ("payload", pa.binary())])


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the segments of ``docs`` to the Parquet table ``path`` and the parts' first numbers to ``<path>-parts``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Rows that share an id are split by where they are read, so the bounds are found without reading a text.
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    made = dealt.mapInArrow(_writer(tokenizer, tokenizer_path, end_id), "part int, segment int, before long, ids long, payload binary")
    made.write.parquet(path)
    first, parts = 0, []
    for r in spark.read.parquet(path).groupBy("part").agg(F.sum("ids").alias("n")).orderBy("part").collect():
        parts.append((r["part"], first))
        first += r["n"]
    spark.createDataFrame(parts, "part int, first long").coalesce(1).write.parquet(f"{path}-parts")


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for payload, start in zip(frame["payload"], frame["start"], strict=True):
            segment = Segment(payload)
            raw, ends = segment.ids().astype("<u4").tobytes(), np.cumsum(segment.counts)
            begins = ends - segment.counts
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)]
            yield pd.DataFrame({"doc_id": pd.array(segment.documents, dtype="Int64"), "start": begins + int(start), "n_tokens": segment.counts, "ids_crc32": np.array(crc, dtype=np.int64)})


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    bounded_batches(spark)
    parts = F.broadcast(spark.read.parquet(f"{path}-parts"))  # a row for each task that wrote
    placed = spark.read.parquet(path).join(parts, "part").select("payload", (F.col("first") + F.col("before")).alias("start"))
    return placed.mapInPandas(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    from .common import shared_folder

    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
