"""Exact tokenizer ids for many texts, with a bounded memory of text pieces.

A piece is what lies between two single spaces, or single newlines between
letters, figures or marks. For the two public vocabularies that these operators
name, no token joins characters on both sides of such a place, so a text's ids
are the ids of its pieces in turn; texts with empty pieces or special-token
strings are encoded as a whole.

Pieces of up to SHORT bytes are found by their bytes in two 64-bit lanes, for
all pieces of a batch at once, in a hash table of arrays; longer ones in a
dictionary. Pieces are compared whole, never by a hash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from .common import quiet_threads, spread
from .repeats import mix

MARK = "\x02"  # a control character: no vocabulary joins it to what stands before or after it
SHORT = 15  # the sixteenth byte holds the piece's length and what stands before it
FIRST, SPACED, LINED = 0, 1, 2  # a piece at the start of a text, after a space, after a newline
LEAD = ("", " ", "\n")
LEADS = frozenset(" \n")
CALL = 1 << 14  # pieces that are given to the tokenizer at once
BYTE_SPACES = ("\u0120", "\u010a")  # how byte-level vocabularies write a space and a newline
_FULL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: bytes beside which a newline is a place to cut: visible ASCII, and after it also the first bytes of scripts without white space
_BEFORE = np.zeros(256, bool)
_BEFORE[0x21:0x7F] = True
_AFTER = _BEFORE.copy()
_AFTER[0xC3:0xE0] = True


class Lanes:
    """Open-addressing table from 128-bit keys to codes, for arrays of keys."""

    def __init__(self, limit: int) -> None:
        self.held = 0
        self._room(1 << max(4, int(2 * limit - 1).bit_length()))

    def _room(self, size: int) -> None:
        self.mask = np.uint64(size - 1)
        self.low, self.high, self.code = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high + np.uint64(0x9E3779B97F4A7C15))) & self.mask).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Code of each key, -1 where the table lacks it."""
        slot = self._slot(low, high)
        code = self.code[slot]
        open_ = np.flatnonzero((code >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            at = slot[open_]
            code[open_] = self.code[at]
            open_ = open_[(code[open_] >= 0) & ((self.low[at] != low[open_]) | (self.high[at] != high[open_]))]
        return code

    def add(self, low: np.ndarray, high: np.ndarray, code: np.ndarray) -> None:
        """Put distinct keys that the table lacks into it; it grows before it is two thirds full."""
        if 3 * (self.held + len(low)) > 2 * len(self.code):
            full = np.flatnonzero(self.code >= 0)
            low, high, code = (np.concatenate([x[full], y]) for x, y in ((self.low, low), (self.high, high), (self.code, code)))
            self._room(1 << int(2 * len(low)).bit_length())
            self.held = 0
        self.held += len(low)
        slot, open_ = self._slot(low, high), np.arange(len(low))
        while len(open_):
            at = slot[open_]
            free = self.code[at] < 0
            self.code[at[free]] = code[open_[free]]
            won = free & (self.code[at] == code[open_])
            self.low[at[won]], self.high[at[won]] = low[open_[won]], high[open_[won]]
            open_ = open_[~won]
            slot[open_] = (slot[open_] + 1) & int(self.mask)


class PieceEncoder:
    """encode(texts) -> (flat uint32 ids, number of ids of each text).

    At most `limit` pieces are remembered; then those that were not met again
    since the last time are forgotten.
    """

    def __init__(self, path: str, limit: int = 600_000) -> None:
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = limit
        # a vocabulary that lower-cases: ASCII letters are lowered before pieces are looked up, the rest is the library's
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        # where white space leaves no id, what stands before a piece makes no difference
        same = [np.array_equal(self._whole(f"{lead}ab."), self._whole(" ab.")) for lead in LEAD]
        self.kind = np.array([SPACED if s else k for k, s in enumerate(same)], np.uint8)
        # the mark serves where it never changes the ids of the pieces (with what stands before them) on its two sides
        self.joint, self.mark = "", np.zeros(0, np.uint32)
        for joint in (MARK, f" {MARK}"):
            mark, seen = self._whole(joint), self._whole(f" ab.{joint} cd{joint} .e{joint}\nf{joint}\n,g")
            parts = [self._whole(x) for x in (" ab.", " cd", " .e", "\nf", "\n,g")]
            if len(mark) and np.array_equal(seen, np.concatenate([y for x in parts for y in (x, mark)][:-1])):
                self.joint, self.mark = joint, mark
                break
        # in a byte-level vocabulary the ids themselves show where a piece begins: at a token that begins with white space
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t[:1] in BYTE_SPACES]] = True
        seen, parts = self._whole(" ab. cd .e\nf\n,g 's"), [self._whole(x) for x in (" ab.", " cd", " .e", "\nf", "\n,g", " 's")]
        self.shown = np.array_equal(seen, np.concatenate(parts)) and int(self.opens[seen].sum()) == len(parts)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.low, self.high = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64)
        self.again = np.zeros(1 << 14, bool)
        self.size = self.used = 0
        self.short, self.long = Lanes(limit), {}

    def _forget(self) -> None:
        """Keep the pieces that were met again since the last time, the latest half of the limit of them at most."""
        keep = np.flatnonzero(self.again[: self.size])[-(self.limit // 2) :]
        new = np.full(self.size, -1)
        new[keep] = np.arange(len(keep))
        n = self.length[keep]
        flat = self.flat[np.repeat(self.begin[keep], n) + spread(n)]
        k, self.size, self.used = len(keep), len(keep), len(flat)
        self.flat[: len(flat)], self.begin[:k], self.length[:k] = flat, np.cumsum(n) - n, n
        self.low[:k], self.high[:k] = self.low[keep], self.high[keep]
        self.again[:] = False
        self.long = {piece: int(new[code]) for piece, code in self.long.items() if new[code] >= 0}
        self.short = Lanes(self.limit)
        narrow = np.ones(k, bool)
        narrow[list(self.long.values())] = False
        codes = np.flatnonzero(narrow)
        self.short.add(self.low[codes], self.high[codes], codes.astype(np.int32))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of many pieces by one call, where ids show the ends of pieces, their own or the mark's; None if they don't."""
        ids = np.array(self.tokenizer.encode_batch_fast([("" if self.shown else self.joint).join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        if self.shown:
            begin = np.flatnonzero(self.opens[ids])
            return (ids, np.diff(np.concatenate([begin, [len(ids)]]))) if len(begin) == len(pieces) else None
        at = np.flatnonzero(ids == self.mark[0])
        if len(at) != len(pieces) - 1:
            return None
        inner = np.ones(len(ids), bool)
        inner[(at[:, None] + np.arange(len(self.mark))).ravel()] = False
        return ids[inner], np.concatenate([at, [len(ids)]]) - np.concatenate([[0], at + len(self.mark)])

    def _batch(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces. Those with white space in them, with the mark, or with nothing before them are encoded alone."""
        alone = np.fromiter((p[0] not in LEADS for p in pieces), bool, len(pieces))
        others = [p for p, a in zip(pieces, alone.tolist(), strict=True) if not a] if alone.any() else pieces
        text = "".join(others)
        if MARK in text or text.split() != [p[1:] for p in others]:
            alone = np.fromiter((p[0] not in LEADS or p.split() != [p[1:]] or MARK in p for p in pieces), bool, len(pieces))
        joined = None
        if (self.joint or self.shown) and not alone.all():
            joined = self._joined([p for p, a in zip(pieces, alone.tolist(), strict=True) if not a])
        if joined is None:
            return self._each(pieces)
        if not alone.any():
            return joined
        other = self._each([p for p, a in zip(pieces, alone.tolist(), strict=True) if a])
        n = np.zeros(len(pieces), np.int64)
        n[~alone], n[alone] = joined[1], other[1]
        begin = np.zeros(len(pieces), np.int64)
        begin[~alone] = np.cumsum(joined[1]) - joined[1]
        begin[alone] = len(joined[0]) + np.cumsum(other[1]) - other[1]
        return np.concatenate([joined[0], other[0]])[np.repeat(begin, n) + spread(n)], n

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for e in each for i in e], np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def _learn(self, pieces: list[str], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Codes of new pieces, given with what stands before them."""
        found = [self._batch(pieces[k : k + CALL]) for k in range(0, len(pieces), CALL)]
        flat, lengths = (np.concatenate(x) for x in zip(*found, strict=True))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.size + len(lengths) > len(self.begin):
            self.begin, self.length, self.low, self.high, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length, self.low, self.high, self.again))
        self.flat[self.used : self.used + len(flat)] = flat
        codes = np.arange(self.size, self.size + len(lengths))
        self.begin[codes], self.length[codes] = self.used + np.cumsum(lengths) - lengths, lengths
        self.low[codes], self.high[codes], self.again[codes] = low, high, False
        self.used, self.size = self.used + len(flat), self.size + len(lengths)
        return codes

    def _short_codes(self, text: bytes, buf: np.ndarray, start: np.ndarray, size: np.ndarray, kind: np.ndarray) -> np.ndarray:
        lanes = np.ndarray((len(buf) - 7,), "<u8", text, 0, (1,))
        low = lanes[start] & _FULL[np.minimum(size, 8)]
        tag = (size * 4 + kind).astype(np.uint64) << np.uint64(56)
        high = (lanes[start + 8] & _FULL[np.maximum(size - 8, 0)]) | tag
        codes = self.short.find(low, high)
        known = codes >= 0
        self.again[codes[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            new = new[np.lexsort((high[new], low[new]))]
            fresh = np.ones(len(new), bool)
            fresh[1:] = (low[new[1:]] != low[new[:-1]]) | (high[new[1:]] != high[new[:-1]])
            one = new[fresh]
            pieces = [LEAD[k] + text[a : a + n].decode() for a, n, k in zip(start[one].tolist(), size[one].tolist(), kind[one].tolist(), strict=True)]
            learnt = self._learn(pieces, low[one], high[one])
            self.short.add(low[one], high[one], learnt.astype(np.int32))
            codes[new] = learnt[np.cumsum(fresh) - 1]
        return codes

    def _long_codes(self, text: bytes, start: np.ndarray, size: np.ndarray, kind: np.ndarray) -> np.ndarray:
        pieces = [LEAD[k] + text[a : a + n].decode() for a, n, k in zip(start.tolist(), size.tolist(), kind.tolist(), strict=True)]
        new = list(dict.fromkeys(p for p in pieces if p not in self.long))
        known = np.fromiter((self.long.get(p, -1) for p in pieces), np.int64, len(pieces))
        self.again[known[known >= 0]] = True
        if new:
            none = np.zeros(len(new), np.uint64)
            self.long.update(zip(new, self._learn(new, none, none).tolist(), strict=True))
        return np.fromiter(map(self.long.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, batch: Sequence[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        if self.size > self.limit:
            self._forget()
        texts = [t.encode() if isinstance(t, str) else t or b"" for t in batch]
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        original = b" ".join(texts) + b" "
        text = (original.translate(_LOWER) if self.lower else original) + bytes(16)
        buf = np.frombuffer(text, np.uint8)
        body = buf[: len(original)]
        lines = np.flatnonzero(body == 10)
        lines = lines[(lines > 0) & (lines < len(body) - 1)]
        lines = lines[_BEFORE[body[lines - 1]] & _AFTER[body[lines + 1]]]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        cut = body == 32
        cut[lines] = True
        stop = np.flatnonzero(cut)
        start = np.concatenate([[0], stop[:-1] + 1])
        size = stop - start
        kind = np.where(buf[start - 1] == 10, LINED, SPACED)
        head = np.concatenate([[0], np.searchsorted(stop, ends[:-1]) + 1])  # each text's first piece
        kind[head] = FIRST
        kind = self.kind[kind]
        odd = np.logical_or.reduceat(size == 0, head) & (np.diff(np.concatenate([[-1], ends])) > 1)
        if any(s in original for s in self.special):
            odd |= np.fromiter((any(s in t for s in self.special) for t in texts), bool, len(texts))
        per = np.diff(np.concatenate([head, [len(stop)]]))
        plain = (size > 0) & ~np.repeat(odd, per)
        codes = np.full(len(stop), -1, np.int64)
        for wide in (False, True):
            at = np.flatnonzero(plain & ((size > SHORT) == wide))
            if len(at):
                codes[at] = self._long_codes(text, start[at], size[at], kind[at]) if wide else self._short_codes(text, buf, start[at], size[at], kind[at])
        n = np.where(codes >= 0, self.length[codes], 0)
        lengths = np.add.reduceat(n, head)
        ids = self.flat[np.repeat(self.begin[codes], n) + spread(n)]
        if odd.any():
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for k in np.flatnonzero(odd):
                parts[k] = self._whole(texts[k].decode())
                lengths[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, lengths


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to each text's ids."""
    return (ids, lengths) if end_id is None else (np.insert(ids, np.cumsum(lengths), np.uint32(end_id)), lengths + 1)


_KEPT: dict[str, PieceEncoder] = {}


def encoder(path: str) -> Callable[[Sequence[str | bytes | None]], tuple[np.ndarray, np.ndarray]]:
    """One encoder for each vocabulary and Python worker."""
    if path not in _KEPT:
        _KEPT[path] = PieceEncoder(path)
    return _KEPT[path].encode


def vocabulary(name: str) -> str:
    """Path of one of the public vocabularies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
