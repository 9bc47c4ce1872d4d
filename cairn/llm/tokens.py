"""Token ids of whole texts by the ``tokenizers`` library, with a memo in front of it.

A byte-level BPE with the usual letters / digits / punctuation / white-space split never lets a
piece reach across a single space between two visible characters, so a text's ids are the ids of
its space-separated chunks put in a row.  Natural text repeats chunks, so each worker keeps a memo
of chunks, their bytes and ids in numpy arrays, found by a 64-bit hash that is computed for all chunks
of a batch at once.  The hash only proposes: the bytes of every chunk are compared with those of the one
it was taken for, and a chunk that differs is encoded by itself.  Only unseen chunks become strings,
whose pieces go to the library's model.
Texts for which that cut could be wrong (white space beside a space), and every vocabulary whose
pipeline is not plain byte-level BPE, go to the library whole.  The memo is only a memo: it
takes no more when it is full, and ids never depend on it.

Cases: a null text is empty and has no ids; equal texts have equal ids; a long text is encoded part by part.
"""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import regex

#: White space other than the plain space; where one touches a space the chunk cut may not hold.
_ASCII_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_WIDE_SPACE = "\x85\xa0                　"
_TOUCHING = ["  ", *(" " + c for c in _ASCII_SPACE), *(c + " " for c in _ASCII_SPACE)]
#: Chunks that a worker's memo holds at most, and slots of its hash table.
_MEMO_LIMIT, _TABLE_BITS = 1_400_000, 21
#: Characters that are cut into chunks at once.
_STEP = 100_000
_PRIME = 0x9E3779B97F4A7C15 | 1
_BYTE = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "big") for i in range(256)], np.uint64)
_ENCODERS: dict[tuple, "Encoder"] = {}


def default_tokenizer_path() -> str:
    """The 50k byte-level vocabulary of the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """Byte -> the printable character that byte-level vocabularies write for it."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _grown(a: np.ndarray, size: int) -> np.ndarray:
    """a, with room for size and a quarter of a million more where it is too short."""
    return a if size <= len(a) else np.concatenate([a, np.zeros(size + (1 << 18) - len(a), a.dtype)])


class Encoder:
    """Encodes texts into flat numpy id arrays; one per worker process and vocabulary file."""

    def __init__(self, path: str, memo: int | None = None):
        self.memo = _MEMO_LIMIT if memo is None else memo
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.letters = _byte_letters()
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.specials = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        kind = str(self.lib.pre_tokenizer)
        self.plain = self.lib.normalizer is None and kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind
        self._clear()

    @classmethod
    def get(cls, path: str, memo: int | None = None) -> "Encoder":
        """The worker's encoder; memo: chunks that it remembers at most."""
        if (path, memo) not in _ENCODERS:
            _ENCODERS.clear()  # one at a time
            _ENCODERS[path, memo] = cls(path, memo)
        return _ENCODERS[path, memo]

    def _clear(self) -> None:
        self.keys = np.zeros(1 << _TABLE_BITS, np.uint64)
        self.where = np.zeros(1 << _TABLE_BITS, np.int32)
        self.n, self.used, self.written = 0, 0, 0
        self.pool, self.bytes = np.zeros(1 << 18, np.int32), np.zeros(1 << 20, np.uint8)
        # of each chunk: where its ids and bytes begin, and its size and place in one number
        self.starts, self.lens, self.texts, self.checks = (np.zeros(1 << 16, t) for t in (np.int32, np.int32, np.int32, np.int64))
        self.short: dict[str, list[int]] = {}
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _ids(self, word: str, spaced: bool) -> list[int]:
        """Ids of a chunk, given without the space before it."""
        if word.isalpha():
            if word.isascii():
                text = "\u0120" + word if spaced else word  # how byte-level vocabularies write a space
            else:
                text = "".join(map(self.letters.__getitem__, (" " + word if spaced else word).encode()))
            return [t.id for t in self.model.tokenize(text)]
        chunk = " " + word if spaced else word
        if any(s in chunk for s in self.specials):
            return self.lib.encode(chunk, add_special_tokens=False).ids
        ids: list[int] = []
        for p in self.pieces.findall(chunk):
            got = self.short.get(p)
            if got is None:
                got = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, p.encode())))]
                if len(p) <= 2 and len(self.short) < 10_000:
                    self.short[p] = got
            ids += got
        return ids

    def _hashes(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of each byte range, and its size and whether it begins a text in one number."""
        if len(self.powers) < len(raw) + 1:
            n = len(raw) + 1
            self.powers = np.cumprod(np.append(np.uint64(1), np.full(n, _PRIME, np.uint64)))
            self.inverses = np.cumprod(np.append(np.uint64(1), np.full(n, pow(_PRIME, -1, 1 << 64), np.uint64)))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * self.powers[: len(raw)], out=sums[1:])
        check = (end - begin) * 2 + first
        h = (sums[end] - sums[begin]) * self.inverses[begin]
        h += check.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return np.maximum(h, np.uint64(1)), check

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Memo places of hashes; -1 where unseen."""
        mask = np.int64((1 << _TABLE_BITS) - 1)
        slot = (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == h, self.where[slot], -1)
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            slot[open_] = now = (slot[open_] + 1) & mask
            got = self.keys[now]
            hit = got == h[open_]
            out[open_[hit]] = self.where[now[hit]]
            open_ = open_[~hit & (got != 0)]
        return np.where((out >= 0) & (self.checks[out] == check), out, -1)

    def _insert(self, h: np.ndarray, at: np.ndarray) -> None:
        mask = np.int64((1 << _TABLE_BITS) - 1)
        slot = (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.keys[slot[left]] == 0
            try_ = left[free]
            self.keys[slot[try_]] = h[try_]
            won = self.keys[slot[try_]] == h[try_]
            self.where[slot[try_[won]]] = at[try_[won]]
            left = np.concatenate([left[~free], try_[~won]])
            slot[left] = (slot[left] + 1) & mask

    def _learn(self, data: bytes, begin, end, first, k: int, used: int, written: int) -> tuple[int, int]:
        """Encodes chunks and puts them behind the memo's first k; how far ids and bytes reach then."""
        flat: list[int] = []
        sizes, parts = [], []
        for a, b, f in zip(begin.tolist(), end.tolist(), first.tolist()):
            part = data[a:b]
            ids = self._ids(part.decode("utf-8", "surrogatepass"), not f)
            flat += ids
            sizes.append(len(ids))
            parts.append(part)
        text = b" ".join(parts) + b" "  # each chunk's bytes and a space
        n = len(sizes)
        self.pool, self.bytes = _grown(self.pool, used + len(flat)), _grown(self.bytes, written + len(text))
        self.starts, self.lens, self.texts, self.checks = (_grown(x, k + n) for x in (self.starts, self.lens, self.texts, self.checks))
        self.pool[used : used + len(flat)] = flat
        self.bytes[written : written + len(text)] = np.frombuffer(text, np.uint8)
        self.lens[k : k + n] = sizes
        self.starts[k : k + n] = used + np.cumsum(np.array(sizes, np.int64)) - sizes
        width = end - begin + 1
        self.texts[k : k + n] = written + np.cumsum(width) - width
        self.checks[k : k + n] = (end - begin) * 2 + first
        return used + len(flat), written + len(text)

    def _differing(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, idx: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Places of the chunks whose bytes are not those of the memo's chunk idx."""
        odd = self.checks[idx] != check
        fits = np.flatnonzero(~odd)
        width = (end - begin + 1)[fits]
        # the chunks with a space after each, as the memo holds them
        shift = np.repeat(self.texts[idx[fits]].astype(np.int64) - (np.cumsum(width) - width), width)
        held = self.bytes[np.arange(len(shift)) + shift]
        own = np.append(raw, np.uint8(32))
        if len(fits) < len(idx):
            own = own[np.arange(len(shift)) + np.repeat(begin[fits] - (np.cumsum(width) - width), width)]
        wrong = np.flatnonzero(held != own)
        if len(wrong):
            odd[fits[np.searchsorted(np.cumsum(width), wrong, "right")]] = True
        return np.flatnonzero(odd)

    def _safe(self, t: str) -> bool:
        if t[0] == " " or t[-1] == " " or any(x in t for x in _TOUCHING):
            return False
        return t.isascii() or not any(c in t for c in _WIDE_SPACE)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat int32 ids, ids per text); a null text is empty."""
        flats, sizes, lo, chars = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), 0, 0
        for i, t in enumerate(texts):
            chars += len(t or "")
            if chars >= _STEP or i == len(texts) - 1:
                flat, sizes[lo : i + 1] = self._encode(texts[lo : i + 1])
                flats.append(flat)
                lo, chars = i + 1, 0
        return np.concatenate(flats), sizes

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        whole: dict[int, np.ndarray] = {}
        safe = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.plain and self._safe(t):
                safe.append(i)
            else:
                whole[i] = np.array(self.lib.encode(t, add_special_tokens=False).ids, np.int32)
        sizes = np.zeros(len(texts), np.int64)
        flat = np.zeros(0, np.int32)
        if safe:
            parts = [texts[i].encode("utf-8", "surrogatepass") for i in safe]
            data = b" ".join(parts)
            flat, per = self._chunks(data, np.cumsum([len(p) + 1 for p in parts]))
            sizes[safe] = per
        if not whole:
            return flat, sizes
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        out = [whole[i] if i in whole else flat[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
        return np.concatenate(out), np.array([len(p) for p in out], np.int64)

    def _chunks(self, data: bytes, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of texts joined by spaces; stops: where each next text begins.

        Some hundred thousand bytes are taken at a time, however long a text is.
        """
        raw = np.frombuffer(data, np.uint8)
        end = np.append(np.flatnonzero(raw == 32), len(raw))
        begin = np.append(0, end[:-1] + 1)
        of = np.searchsorted(stops, begin, "right")
        first = np.append(True, of[1:] != of[:-1])
        flats, lens, a = [], [], 0
        while a < len(end):
            b = max(a + 1, int(np.searchsorted(end, begin[a] + _STEP, "right")))
            lo, hi = int(begin[a]), int(end[b - 1])
            flat, n = self._part(data[lo:hi], raw[lo:hi], begin[a:b] - lo, end[a:b] - lo, first[a:b])
            flats.append(flat)
            lens.append(n)
            a = b
        return np.concatenate(flats), np.bincount(of, np.concatenate(lens), len(stops)).astype(np.int64)

    def _part(self, data: bytes, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per chunk) of chunks that follow each other."""
        h, check = self._hashes(raw, begin, end, first)
        idx = self._find(h, check).astype(np.int64)
        new = np.flatnonzero(idx < 0)
        rep, k, used, written = new, self.n, self.used, self.written
        if len(new):
            _, rep, back = np.unique(h[new], return_index=True, return_inverse=True)
            rep = new[rep]
            idx[new] = k + back
            used, written = self._learn(data, begin[rep], end[rep], first[rep], k, used, written)
        odd = self._differing(raw, begin, end, idx, check)
        if len(odd):  # taken for another chunk of the same hash
            idx[odd] = k + len(rep) + np.arange(len(odd))
            self._learn(data, begin[odd], end[odd], first[odd], k + len(rep), used, written)
        lens = self.lens[idx].astype(np.int64)
        stop = np.cumsum(lens)
        flat = self.pool[np.arange(int(stop[-1])) + np.repeat(self.starts[idx] - (stop - lens), lens)]
        if len(rep) and k + len(rep) <= self.memo:
            self._insert(h[rep], np.arange(k, k + len(rep)))
            self.n, self.used, self.written = k + len(rep), used, written
        return flat, lens


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
