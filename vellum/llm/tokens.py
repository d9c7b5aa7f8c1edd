"""Whole-batch tokenisation with a memo of space-delimited chunks.

Both vocabularies tokenise a text piecewise at a single space between two characters that are no white space: the
byte-level one starts a piece there (the space belongs to the piece), the word-level one drops the space. So a batch
is cut at such spaces, each distinct chunk is encoded once by the tokenizers library, and the ids of the texts
are gathered from the chunks' ids. A text with any other spacing, or one that spells a special token (which the library then
takes for one, and for which it cuts the text around it), is encoded whole by the same library.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vellum.llm.common import gather

#: Characters that some regular-expression engine counts as white space.
_WS = r"\x09-\x0D\x1C-\x1F \x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}"
ODD_SPACING = rf"^ |(?: [{_WS}])|(?:[{_WS}] )| $"


#: Chunks that an idle worker keeps.
IDLE = 200_000

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Bytes of text whose chunks are looked up at once.
SLICE = 12 << 20

#: Neither vocabulary's pattern joins a letter or digit with these, so a piece always starts between the two.
STOPS = ".,;:!?"


class _Keys:
    """Chunks and the rows that hold their ids; looked up as a whole column."""

    def __init__(self, encode):
        self.encode, self.names, self.rows = encode, pa.array([], pa.string()), np.empty(0, np.int64)

    def find(self, chunks: pa.Array) -> np.ndarray:
        at = pc.fill_null(pc.index_in(chunks, self.names), -1).to_numpy(zero_copy_only=False)
        return np.where(at < 0, -1, self.rows[at]) if len(self.rows) else np.full(len(chunks), -1, np.int64)

    def add(self, chunks: pa.Array, rows: np.ndarray) -> None:
        self.names, self.rows = pa.concat_arrays([self.names, chunks]), np.concatenate([self.rows, rows])

    def keep(self, new: np.ndarray) -> None:
        left = new[self.rows] >= 0
        self.names, self.rows = self.names.filter(pa.array(left)), new[self.rows[left]]


class ChunkMemo:
    """Token ids of chunks in one flat store; texts' first chunks have keys of their own (heads).

    Beyond ``most`` chunks those seen least are forgotten.
    """

    def __init__(self, encode_many, encode_heads=None, most: int = 1_000_000):
        self.most, self.tails = most, _Keys(encode_many)
        self.heads = _Keys(encode_heads) if encode_heads else None
        self._empty()

    def _empty(self) -> None:
        self.stops: dict[str, int] = {}
        self.flat, self.used, self.n = np.empty(1 << 16, np.int32), 0, 0
        self.starts, self.lengths, self.seen = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def make_room(self, more: int) -> None:
        """Called before a slice: rows that are given out stay valid within it."""
        if self.n + more > self.most:
            self.shrink(self.most // 2)

    def shrink(self, to: int) -> None:
        """Forgets all but the chunks seen most, of which about as many as asked for stay."""
        if self.n <= to:
            return
        seen = self.seen[: self.n]
        least = 1 if (seen > 1).sum() <= to else np.partition(seen, self.n - to)[self.n - to]
        rows = np.flatnonzero(seen > least)
        new = np.full(self.n, -1, np.int64)
        new[rows] = np.arange(len(rows))
        self.tails.keep(new)
        if self.heads:
            self.heads.keep(new)
        lengths = self.lengths[rows].copy()
        flat, seen = gather(self.flat, self.starts[rows], lengths), seen[rows] // 2
        self._empty()
        self._append(flat, lengths)
        self.seen[: self.n] = seen

    def _append(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(lengths) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        rows = np.arange(self.n, self.n + len(lengths))
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[rows] = lengths
        self.starts[rows] = self.used + np.cumsum(lengths) - lengths
        self.seen[rows] = 0
        self.used += len(ids)
        self.n += len(lengths)
        return rows

    def _ends(self, ends: list[str]) -> np.ndarray:
        """Rows of runs of stops; there are few distinct ones."""
        encode = (self.heads or self.tails).encode
        coded = pa.array(ends, pa.string()).dictionary_encode()
        new = [e for e in coded.dictionary.to_pylist() if e not in self.stops]
        if new:
            self.stops.update(zip(new, self._append(*encode(new)).tolist(), strict=True))
        return np.array([self.stops[e] for e in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]

    def rows(self, chunks: pa.Array, heads: bool = False) -> np.ndarray:
        """Rows of distinct chunks. A missing one that ends in stops is put together from the chunk without them and the stops."""
        keys = self.heads if heads else self.tails
        bare = pc.utf8_rtrim(chunks, STOPS)
        both = keys.find(pa.concat_arrays([chunks, bare]))  # one look-up: it hashes all keys
        found, below = both[: len(chunks)].copy(), both[len(chunks) :]
        missing = np.flatnonzero(found < 0)
        if len(missing):
            at = pa.array(missing)
            names, base, below = chunks.take(at), bare.take(at), below[missing]
            stopped = pc.and_(pc.not_equal(names, base), pc.match_substring_regex(base, r"[\pL\pN]$")).to_numpy(zero_copy_only=False)
            wanted = pc.if_else(pa.array(stopped), base, names)
            rows = np.where(stopped, below, -1)
            coded = wanted.filter(pa.array(rows < 0)).dictionary_encode()
            if len(coded.dictionary):
                fresh = self._append(*keys.encode(coded.dictionary.to_pylist()))
                keys.add(coded.dictionary, fresh)
                rows[rows < 0] = fresh[coded.indices.to_numpy()]
            found[missing] = rows
            if stopped.any():
                own, cut = names.filter(pa.array(stopped)), base.filter(pa.array(stopped))
                ends = self._ends([n[len(b) :] for n, b in zip(own.to_pylist(), cut.to_pylist(), strict=True)])
                pair = np.stack([rows[stopped], ends], axis=1).reshape(-1)
                lengths = self.lengths[pair]
                made = self._append(gather(self.flat, self.starts[pair], lengths), lengths[::2] + lengths[1::2])
                keys.add(own, made)
                found[missing[stopped]] = made
        np.add.at(self.seen, found, 1)
        return found


def odd_spacing(texts: pa.Array) -> np.ndarray:
    """Texts with any spacing but single spaces between other characters."""
    return pc.match_substring_regex(texts, ODD_SPACING).to_numpy(zero_copy_only=False)


def chunked(texts: pa.Array, memo: ChunkMemo, odd: np.ndarray, whole) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and row offsets. odd: texts that cannot be cut at spaces, which whole encodes."""
    counts = np.zeros(len(texts), np.int64)
    regular = np.flatnonzero(~odd & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
    pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(regular):
        parts = pc.split_pattern(texts if len(regular) == len(texts) else texts.take(pa.array(regular)), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.flatten()
        offsets -= offsets[0]
        if memo.heads is None:
            coded = flat.dictionary_encode()
            memo.make_room(len(coded.dictionary))
            codes = memo.rows(coded.dictionary)[coded.indices.to_numpy()]
        else:
            inner = np.ones(len(flat), bool)
            inner[offsets[:-1]] = False
            coded = flat.filter(pa.array(inner)).dictionary_encode()
            memo.make_room(len(coded.dictionary) + len(regular))
            codes = np.empty(len(flat), np.int64)
            first = flat.take(pa.array(offsets[:-1])).dictionary_encode()
            codes[offsets[:-1]] = memo.rows(first.dictionary, heads=True)[first.indices.to_numpy()]
            codes[inner] = memo.rows(coded.dictionary)[coded.indices.to_numpy()]
        lengths = memo.lengths[codes]
        counts[regular] = np.add.reduceat(lengths, offsets[:-1], dtype=np.int64)
        out = gather(memo.flat, memo.starts[codes], lengths)
        if len(regular) == len(texts):
            return out, np.concatenate([[0], np.cumsum(counts)])
        pieces.append((regular, counts[regular], out))
    rest = np.flatnonzero(odd)
    if len(rest):
        ids, lengths = whole(texts.take(pa.array(rest)).to_pylist())
        counts[rest] = lengths
        pieces.append((rest, lengths, ids))
    ends = np.cumsum(counts)
    flat_ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    for rows, lengths, ids in pieces:
        fill(flat_ids, (ends - counts)[rows], ids, lengths)
    return flat_ids, np.concatenate([[0], ends])


def fill(out: np.ndarray, starts: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> None:
    """Writes the consecutive runs of values to out at the given starts."""
    if len(values):
        base = np.cumsum(lengths) - lengths
        out[np.repeat(starts - base, lengths) + np.arange(len(values), dtype=np.int64)] = values


class _Library:
    """The tokenizers library as it is by default, but for add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # in any case, so that no normalised form is missed
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "(?i)" + "|".join(added) if added else None

    def odd(self, texts: pa.Array, spacing: str | None = None) -> np.ndarray:
        """Texts that spell an added token, or match a pattern of odd spacing."""
        out = np.zeros(len(texts), bool)
        for pattern in (self.special, spacing):
            if pattern:
                out |= pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
        return out

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, lengths = [], np.empty(len(texts), np.int64)
        for at in range(0, len(texts), 512):
            for i, e in enumerate(self.tokenizer.encode_batch_fast(texts[at : at + 512], add_special_tokens=False), at):
                ids = e.ids
                lengths[i] = len(ids)
                flat.append(np.array(ids, np.int32))
        return (np.concatenate(flat) if flat else np.empty(0, np.int32)), lengths


class ByteLevel(_Library):
    """The byte-level vocabulary: a run of chunks is encoded as one text, cut again where an id starts with a space."""

    def __init__(self, path: str):
        super().__init__(path)
        size = self.tokenizer.get_vocab_size()
        self.opens = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")  # how a leading space is written in this vocabulary
        self.memo = ChunkMemo(self.joined, self.each)

    def joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], []
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            got = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            starts = np.flatnonzero(self.opens[got])
            if len(starts) != len(part):
                got, n = self.each([" " + c for c in part])
            else:
                n = np.diff(np.append(starts, len(got)))
            ids.append(got)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("") if texts.null_count else texts
        return chunked(texts, self.memo, self.odd(texts, ODD_SPACING), self.each)


class WordLevel(_Library):
    """The word vocabulary, which drops white space: chunks are encoded as one text around a separator word."""

    MARK = "\x01"

    def __init__(self, path: str):
        super().__init__(path)
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.memo = ChunkMemo(self.joined)

    def joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], []
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            text = f" {self.MARK} ".join(part)
            got = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(got == self.mark[0]) if len(self.mark) == 1 else np.empty(0, np.int64)
            if len(cuts) != len(part) - 1 or text.count(self.MARK) != len(part) - 1:
                got, n = self.each(part)
            else:
                n = np.diff(np.concatenate([[-1], cuts, [len(got)]])) - 1
                got = np.delete(got, cuts)
            ids.append(got)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("") if texts.null_count else texts
        odd = self.odd(texts)
        # the vocabulary is in lower case, so texts that differ in A to Z alone share their chunks; special tokens are as written
        lower = pc.ascii_lower(texts)
        return chunked(pc.if_else(pa.array(odd), texts, lower) if odd.any() else lower, self.memo, odd, self.each)


_LOADED: dict[tuple[type, str], _Library] = {}


def load(kind: type, path: str):
    """One tokenizer for each worker process."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def rest(memo: ChunkMemo) -> None:
    """At the end of a task: an idle worker keeps the most frequent chunks and gives the rest of its memory back."""
    memo.shrink(IDLE)
    trim()


def release() -> None:
    """Frees what load keeps; a worker that goes on to other work need not hold it."""
    _LOADED.clear()
    trim()


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
