"""Token ids of whole texts through a memo of their pieces.

A text is cut where the tokenizer always starts a new token, each distinct piece is encoded once
by the tokenizers library and remembered by the Python worker, and a text's ids are gathered by
index. Ids are those of encoding the whole text: a cut lies before a single space or line feed
that stands between characters which are no white space, where neither the normalisation nor the
pre-tokenisation of the supported kinds of tokenizer reaches across.
"""

from __future__ import annotations

import os

import numpy as np

from vellum.llm.text import piece_names

#: Pieces that a worker remembers at most; further ones are encoded again when they return.
MEMO_PIECES = 500_000
_SLOTS, _SHIFT = 1 << 20, np.uint64(44)


def _bytes(*found: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(found)] = True
    return table


_BLANK = _bytes(9, 10, 11, 12, 13, 28, 29, 30, 31, 32)
_WIDE = _bytes(0xE1, 0xE2, 0xE3)
_MARK = _bytes(0xC2, 0xCC, 0xCD, *range(0xD0, 0x100), 0xE1, 0xE2, 0xE3)
_LETTER = _bytes(*range(65, 91), *range(97, 123))
_POINT = _bytes(*b".,;:!?|#%&*$()")
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per tokenizer file and worker, kept over tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # an open hash table from a piece's 64-bit name to its number, which a second name proves;
        # number 0 is no piece
        self.table = np.zeros(_SLOTS, np.int32)
        self.names, self.proofs = np.zeros((2, MEMO_PIECES + 1), np.uint64)
        self.ids, self.at, self.have = np.empty(1 << 20, np.int32), np.zeros(MEMO_PIECES + 2, np.int64), 1
        # one that drops white space and letter case encodes a word the same with or without them
        same = {tuple(self.tokenizer.encode(x, add_special_tokens=False).ids) for x in (" Aa", "\naa", "AA", "aa")}
        self.drops_space = len(same) == 1
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [s for s in special if s]

    def _cuts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The byte positions at which pieces start: every text that isn't empty, safe spaces, and
        punctuation right after a letter."""
        n = len(raw)
        cut = np.zeros(n, bool)
        if n > 3:
            byte, one, two, three = raw[3:-1], raw[2:-2], raw[1:-3], raw[:-4]
            # bytes that may end or begin a wider white space, or a mark that joins its neighbour
            joins = (one >= 0x80) & ((two == 0xC2) | _WIDE[three])
            lone = ((byte == 32) | (byte == 10)) & ~_BLANK[raw[4:]] & ~_BLANK[one] & ~_MARK[raw[4:]] & ~joins
            cut[3:-1] = lone
            cut[at[1:-1][at[1:-1] > 0] - 1] = False  # what follows belongs to another text
            letter = _LETTER[one] | ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))
            cut[3:-1] |= letter & _POINT[byte] & ~_MARK[raw[4:]]
        cut[at[:-1][at[1:] > at[:-1]]] = True
        return np.flatnonzero(cut)

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every text in order, and where each text's ids start (one more than texts)."""
        if self.special and any(s in (whole := raw.tobytes()) for s in self.special):
            return self._plain(whole, at)
        if self.drops_space:  # this kind lowers letters too, so that fewer pieces differ
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        cuts = self._cuts(raw, at)
        start, end = cuts, np.append(cuts[1:], len(raw))
        if self.drops_space and len(cuts):
            start = cuts + ((raw[cuts] == 32) | (raw[cuts] == 10))
        name, proof = piece_names(raw, start, end)
        code = self._find(name, proof)
        missing = np.flatnonzero(code < 0)
        extra_ids, extra_at = np.empty(0, np.int32), np.zeros(1, np.int64)
        if len(missing):
            _, first, which = np.unique(name[missing], return_index=True, return_inverse=True)
            new = missing[first]
            texts = [raw[x:y].tobytes().decode() for x, y in zip(start[new].tolist(), end[new].tolist())]
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            extra_at = np.concatenate([[0], np.cumsum([len(x) for x in encoded], dtype=np.int64)])
            extra_ids = np.fromiter((i for x in encoded for i in x), np.int32, int(extra_at[-1]))
            code[missing] = -1 - which
        known = code >= 0
        slot, fresh = np.where(known, code, 0), np.where(known, 0, -1 - code)
        begin = np.where(known, self.at[slot], extra_at[fresh])
        size = np.where(known, self.at[slot + 1], extra_at[np.where(known, 0, -code)]) - begin
        total = np.concatenate([[0], np.cumsum(size)])
        # remembered ids come first and new ones behind them in one array to gather from
        used = int(self.at[self.have])
        source = np.concatenate([self.ids[:used], extra_ids])
        out = source[np.arange(total[-1]) + np.repeat(np.where(known, begin, begin + used) - total[:-1], size)]
        if len(missing):
            self._remember(name[new], proof[new], extra_ids, extra_at)
        return out, total[np.searchsorted(cuts, at, "left")]

    def _find(self, name: np.ndarray, proof: np.ndarray) -> np.ndarray:
        """The number of each remembered piece, -1 for others."""
        code = np.full(len(name), -1, np.int64)
        slot, open_ = (name >> _SHIFT).astype(np.int64), np.arange(len(name))
        while len(open_):
            held = self.table[slot]
            hit = self.names[held] == name[open_]
            found = open_[hit]
            code[found] = held[hit]
            go = ~hit & (held > 0)
            open_, slot = open_[go], (slot[go] + 1) & (_SLOTS - 1)
        code[code >= 0] = np.where(self.proofs[code[code >= 0]] == proof[code >= 0], code[code >= 0], -1)
        return code

    def _remember(self, name: np.ndarray, proof: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        have, take = self.have, min(len(name), MEMO_PIECES - self.have)
        if take <= 0:
            return
        used, more = int(self.at[have]), int(at[take])
        while used + more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[used : used + more] = ids[:more]
        self.at[have + 1 : have + take + 1] = used + at[1 : take + 1]
        self.names[have : have + take], self.proofs[have : have + take] = name[:take], proof[:take]
        slot, number = (name[:take] >> _SHIFT).astype(np.int64), np.arange(have, have + take)
        while len(number):
            _, first = np.unique(slot, return_index=True)
            first = first[self.table[slot[first]] == 0]
            self.table[slot[first]] = number[first]
            rest = np.ones(len(number), bool)
            rest[first] = False
            slot, number = (slot[rest] + 1) & (_SLOTS - 1), number[rest]
        self.have = have + take

    def _plain(self, whole: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For text that holds the string of a special token: the library's own way."""
        ids = [self.tokenizer.encode(whole[a:b].decode(), add_special_tokens=False).ids for a, b in zip(at[:-1], at[1:])]
        return np.array([i for x in ids for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
