"""Token ids of whole texts by a public tokenizer file, with word results kept between texts."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

#: Distinct words whose ids one Python worker keeps (some 60 bytes each); at the limit it starts anew.
KEPT_WORDS = 2_000_000
CLOSING = ".,"
#: Words whose ids must come out as the whole tokenizer's, or no word goes to its model directly.
PROBES = ("a", "Word", "naïve", "Straße", "ÉTÉ", "слово", "言葉", "tokenization", "Übergrößen")
#: Words up to so many 8-byte lanes are looked up in arrays; longer ones are encoded where they stand.
LANES = 4
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable Latin-1 stands for itself, the rest counts on from 256."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Words:
    """A hash table in arrays: words of up to ``8 * LANES`` bytes to their ids.

    A word is its bytes in ``LANES`` unsigned integers and its length, so equal keys are
    equal words.
    """

    def __init__(self) -> None:
        self.n, self.filled = 0, 0
        self.keys = np.zeros((1 << 12, LANES), np.uint64)
        self.size = np.zeros(1 << 12, np.uint8)
        self.first, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.pool = np.zeros(1 << 14, np.uint32)
        self.slots = np.full(1 << 13, -1, np.int32)

    def spot(self, keys: np.ndarray) -> np.ndarray:
        h = (keys * MIX).sum(axis=1, dtype=np.uint64)
        return (((h ^ h >> np.uint64(29)) * MIX[1]) >> np.uint64(32)).astype(np.int64) & self.slots.size - 1

    def find(self, keys: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each word, or -1."""
        found, open_, at = np.full(len(keys), -1), np.arange(len(keys)), self.spot(keys)
        while open_.size:
            entry = self.slots[at]
            there = entry >= 0
            open_, at, entry = open_[there], at[there], entry[there]
            same = (self.keys[entry] == keys[open_]).all(axis=1) & (self.size[entry] == size[open_])
            found[open_[same]] = entry[same]
            open_, at = open_[~same], at[~same] + 1 & self.slots.size - 1
        return found

    def store(self, ids: np.ndarray) -> int:
        """Puts ``ids`` into the pool and tells where."""
        at = self.filled
        self.filled += ids.size
        if self.filled > self.pool.size:
            self.pool = np.concatenate([self.pool, np.zeros(max(self.filled, self.pool.size), np.uint32)])
        self.pool[at : self.filled] = ids
        return at

    def add(self, keys: np.ndarray, size: np.ndarray, ids: list[np.ndarray]) -> None:
        """Words that aren't in the table, none twice."""
        n = self.n + len(ids)
        while n > len(self.keys):
            for name in ("keys", "size", "first", "count"):
                held = getattr(self, name)
                setattr(self, name, np.concatenate([held, np.zeros_like(held)]))
        new = np.arange(self.n, n)
        self.keys[new], self.size[new] = keys, size
        self.count[new] = [x.size for x in ids]
        start = self.store(np.concatenate([*ids, np.zeros(0, np.uint32)]))
        self.first[new] = start + np.cumsum(self.count[new]) - self.count[new]
        self.n = n
        if 2 * n > self.slots.size:
            self.slots = np.full(1 << (4 * n).bit_length(), -1, np.int32)
            new = np.arange(n)
        open_, at = new, self.spot(self.keys[new])
        while open_.size:  # the last to claim a free slot has it, the others go on
            free = self.slots[at] < 0
            self.slots[at[free]] = open_[free]
            left = self.slots[at] != open_
            open_, at = open_[left], at[left] + 1 & self.slots.size - 1


class Encoder:
    """Encodes texts as the tokenizer file does, word by word.

    Both files used here cut a text before a single space or line end that stands
    between other characters, and nothing crosses such a cut. So the ids of a text
    are those of its pieces in order: `` word`` after a space, ``\\nword`` after a
    line end. Letters with a closing mark cut once more, before the mark. A new piece
    of letters only goes to the tokenizer's model at once, past its cutting rules;
    ``PROBES`` show that these agree. Texts with other white space at the cuts, or
    with a special token's string, go to the tokenizer whole.
    """

    def __init__(self, path: str, kept_words: int = KEPT_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept_words, self.words = kept_words, Words()
        self.marks = {m: self.whole(m).tolist() for m in CLOSING}
        self.line_end = self.whole("\n").tolist()
        self.folds = self.whole("A").tolist() == self.whole("a").tolist()
        self.letters = byte_letters()
        self.space = next((s for s in ("Ġ", "") if all(self.direct(s, w) == self.whole(f" {w}").tolist() for w in PROBES)), None)
        self.start = next((s for s in ("", "Ġ") if all(self.line_end + self.direct(s, w) == self.whole(f"\n{w}").tolist() for w in PROBES)), None)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def direct(self, before: str, word: str) -> list[int]:
        """The model's ids of one cut piece: a word of letters only, after ``before``."""
        if self.folds:
            word = word.lower()
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return [t.id for t in self.model.tokenize(before + word)]

    def is_plain(self, word: str) -> bool:
        """Letters only, also when folded and composed as the tokenizer does."""
        return word.isalpha() and (word.isascii() or unicodedata.is_normalized("NFC", word) and word.lower().isalpha() and "Σ" not in word)

    def piece(self, piece: str) -> np.ndarray:
        """The ids of a piece that begins with its space, its line end, or a text's first character."""
        word, mark = (piece[:-1], self.marks[piece[-1]]) if piece[-1:] in self.marks else (piece, [])
        if word[:1] == " " and self.space is not None and self.is_plain(word[1:]):
            return np.array(self.direct(self.space, word[1:]) + mark, np.uint32)
        if word[:1] == "\n" and self.start is not None and self.is_plain(word[1:]):
            return np.array(self.line_end + self.direct(self.start, word[1:]) + mark, np.uint32)
        return self.whole(piece)

    def entries(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The table's entries for the pieces ``raw[begin : begin + size]``; ``raw`` ends with ``8 * LANES`` more bytes."""
        view = np.ndarray((raw.size - 7,), "<u8", raw, strides=(1,))
        keys = np.stack([view[begin + 8 * k] & self.masks[np.clip(size - 8 * k, 0, 8)] for k in range(LANES)], axis=1)
        found = self.words.find(keys, size)
        missing = np.flatnonzero(found < 0)
        if missing.size:
            if self.words.n + missing.size > self.kept_words:
                self.words, missing, found = Words(), np.arange(begin.size), np.full(begin.size, -1)
            order = missing[np.lexsort((size[missing], *keys[missing].T))]
            differs = (keys[order[1:]] != keys[order[:-1]]).any(axis=1) | (size[order[1:]] != size[order[:-1]])
            new = order[np.concatenate([[True], differs])]
            held = memoryview(raw)
            self.words.add(keys[new], size[new], [self.piece(str(held[b : b + n], "utf-8")) for b, n in zip(begin[new].tolist(), size[new].tolist(), strict=True)])
            found[missing] = self.words.find(keys[missing], size[missing])
        return found

    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (strings, none null), each with the end id, as unsigned 32-bit integers; and where each text ends."""
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        edges = offsets - offsets[0]
        raw = np.concatenate([data, np.zeros(8 * LANES, np.uint8)])
        cuts = (data == 32) | (data == 10)
        starts = np.zeros(data.size + 1, bool)
        starts[:-1] = cuts
        starts[edges[:-1]] = True  # an empty text at the end begins behind the data
        begin = np.flatnonzero(starts[:-1])
        size = np.diff(np.append(begin, data.size))
        of = np.searchsorted(edges, begin, "right") - 1
        odd = np.zeros(len(texts), bool)
        odd[of[cuts[begin] & (size == 1)]] = True
        filled = edges[:-1] < edges[1:]
        odd[filled] |= cuts[edges[:-1][filled]]
        text = data.tobytes()
        for mark in self.special:
            at = text.find(mark)
            while at >= 0:
                odd[np.searchsorted(edges, at, "right") - 1] = True
                at = text.find(mark, at + 1)
        inside = ~odd[of]
        short = inside & (size <= 8 * LANES)
        entry = self.entries(raw, begin[short], size[short])
        first, count = np.zeros(begin.size, np.int64), np.zeros(begin.size, np.int64)
        first[short], count[short] = self.words.first[entry], self.words.count[entry]
        mark = self.words.filled
        for k in np.flatnonzero(inside & ~short).tolist():
            ids = self.piece(text[begin[k] : begin[k] + size[k]].decode())
            first[k], count[k] = self.words.store(ids), ids.size
        for k in np.flatnonzero(odd).tolist():
            at = np.searchsorted(begin, edges[k])
            ids = self.whole(text[edges[k] : edges[k + 1]].decode())
            first[at], count[at] = self.words.store(ids), ids.size
        closing = self.words.store(np.array([end_id], np.uint32))
        last = np.searchsorted(begin, edges[1:])  # each text's end id follows its pieces
        first, count = np.insert(first, last, closing), np.insert(count, last, 1)
        ends = np.cumsum(count)
        ids = self.words.pool[np.repeat(first - ends + count, count) + np.arange(count.sum())]
        self.words.filled = mark  # what this batch alone needed goes
        return ids, ends[last + np.arange(len(texts))]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
