"""Tokenizing whole columns with a public tokenizer, one distinct word at a time."""

from __future__ import annotations

import json
import os

import numpy as np

from factloom.llm import textbuf as tb

#: Distinct words whose ids a worker keeps; beyond it the store starts anew, which only costs time.
WORDS = 2_000_000
#: 1: ASCII letters and digits, 2: punctuation that no contraction or special token uses, 3: all else.
_KIND = np.full(256, 3, np.uint8)
_KIND[tb.SPACE] = 0
_KIND[tb.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))] = 1
_KIND[[ord(c) for c in '!"#$%&()*+,-./:;=?@[]^_`{}~']] = 2


def pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that the word-level tokenizer treats independently of their surroundings.

    Texts are cut at ASCII white space, and where a letter (ASCII or Latin-1) or digit meets plain
    punctuation: the tokenizer's own splitter always cuts there.
    """
    kind = _KIND[data]
    lead = _latin(data)
    kind[lead] = kind[lead + 1] = 1
    n = len(kind)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # 0 beside 3 changes the same bits as 1 beside 2, and is a cut as well
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.equal(kind[1:] ^ kind[:-1], 3, out=cut[1:n])
    cut[1:n] |= (kind[1:] == 0) | (kind[:-1] == 0)
    cut[bounds] = True
    word = kind > 0
    return np.flatnonzero(word & cut[:-1]), np.flatnonzero(word & cut[1:]) + 1


class Merges:
    """Byte-pair merging of many words in lockstep: each round merges the lowest-ranked pair of every word."""

    SLOTS = 18

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.size = len(vocab)
        shown = _byte_characters()
        self.inner = np.array([vocab[c] for c in shown], np.int64)
        self.last = np.array([vocab[c + suffix] for c in shown], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.rank = np.full(1 << self.SLOTS, len(pairs), np.int64)
        self.key = np.full(1 << self.SLOTS, -1, np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.key[slot] >= 0:
                slot = (slot + 1) & ((1 << self.SLOTS) - 1)
            self.key[slot], self.rank[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``none`` for pairs that don't merge; a negative side is no pair."""
        keys = (left * self.size + right).reshape(-1)
        keys[(right < 0).reshape(-1)] = -2
        slot = self._slot(keys)
        found = self.key[slot]
        out = np.where(found == keys, self.rank[slot], self.none)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.SLOTS) - 1)
            found = self.key[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out.reshape(left.shape)

    def encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words (byte spans, one pre-token each) end to end, and the count of each."""
        counts = np.zeros(len(sizes), np.int64)
        order = np.argsort(sizes, kind="stable")
        done: list[tuple[np.ndarray, np.ndarray]] = []
        start = 0
        while start < len(order):
            # words of like length share a table
            width = int(sizes[order[start]])
            end = int(np.searchsorted(sizes[order], width + max(1, width // 8), side="left"))
            some = order[start : max(end, start + 1)][: max(1, (1 << 19) // width)]
            start += len(some)
            table = self._table(data, starts[some], sizes[some])
            counts[some] = (table >= 0).sum(axis=1)
            done.append((some, table))
        at = np.concatenate(([0], np.cumsum(counts)))
        ids = np.empty(at[-1], np.uint32)
        for some, table in done:
            held = table >= 0
            place = at[some][:, None] + np.cumsum(held, axis=1) - 1
            ids[place[held]] = table[held]
        return ids, counts

    def _table(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        width = int(sizes.max())
        at = starts[:, None] + np.arange(width)
        inside = np.arange(width) < sizes[:, None]
        raw = data[np.minimum(at, len(data) - 1)]
        table = np.where(inside, self.inner[raw], -1)
        rows = np.arange(len(sizes))
        table[rows, sizes - 1] = self.last[raw[rows, sizes - 1]]
        if width == 1:
            return table
        live = rows
        now = table
        rank = self.ranks(now[:, :-1], now[:, 1:])
        columns = np.arange(width - 1)
        while True:
            best = rank.argmin(axis=1)
            low = rank[np.arange(len(live)), best]
            on = low < self.none
            if not on.all():
                table[live[~on]] = now[~on]
                live, now, rank, best, low = live[on], now[on], rank[on], best[on], low[on]
            if not len(live):
                return table
            # the pair becomes one symbol and all behind it move up by one
            behind = columns > best[:, None]
            now[:, :-1] = np.where(columns >= best[:, None] + 1, now[:, 1:], now[:, :-1])
            now[:, -1] = -1
            line = np.arange(len(live))
            now[line, best] = self.merged[low]
            rank[:, :-1] = np.where(behind[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = self.none
            for side in (best - 1, best):
                ok = (side >= 0) & (side < width - 1)
                rank[line[ok], side[ok]] = self.ranks(now[line[ok], side[ok]], now[line[ok], side[ok] + 1])


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in prints else chr(256 + extra))
        extra += b not in prints
    return out


def _latin(data: np.ndarray) -> np.ndarray:
    """Positions of the lead bytes of Latin-1 letters."""
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    return lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of letter bytes (ASCII, Latin-1) and of plain punctuation."""
    kind = _KIND[data]
    letter = (kind == 1) & ~((data >= 0x30) & (data <= 0x39))
    lead = _latin(data)
    letter[lead] = letter[lead + 1] = True
    return letter, kind == 2


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower-cases ASCII and Latin-1 letters."""
    out = tb.LOWER[data]
    lead = _latin(data)
    low = out[lead + 1]
    out[lead + 1] = np.where((low >= 0x80) & (low <= 0x9E), low + 0x20, low)
    return out


class WordTokens:
    """Ids of whole texts; a distinct word is encoded once and looked up by its 64-bit hash after that."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(path) if self._plain(path) else None
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def _plain(path: str) -> bool:
        """Whether words can be merged here: lower-cased byte-level pairs with a mark at each word's end."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        return steps == ["NFC", "Replace", "Lowercase"] and bool(spec["model"].get("end_of_word_suffix")) and not spec["model"].get("dropout")

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Add words.  Words of ASCII and Latin-1 letters, or of plain punctuation, are single pre-tokens and
        merged in lockstep; all others go through the tokenizer."""
        sizes = ends - starts
        plain = np.zeros(len(keys), bool)
        if self.merges is not None:
            letter, sign = _letters(data)
            for mask in (letter, sign):
                total = np.concatenate(([0], np.cumsum(mask)))
                plain |= total[ends] - total[starts] == sizes
            plain &= sizes <= 64
        counts = np.zeros(len(keys), np.int64)
        ids = np.zeros(0, np.uint32)
        if plain.any():
            ids, counts[plain] = self.merges.encode(_lower(data), starts[plain], sizes[plain])
        lists = [self._ids(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(starts[~plain].tolist(), ends[~plain].tolist())]
        counts[~plain] = [len(x) for x in lists]
        at = np.empty(len(keys), np.int64)
        at[plain] = len(self.ids) + np.cumsum(counts[plain]) - counts[plain]
        at[~plain] = len(self.ids) + len(ids) + np.cumsum(counts[~plain]) - counts[~plain]
        self.ids = np.concatenate([self.ids, ids, *lists]).astype(np.uint32)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.size, where, counts)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and the row bounds among them."""
        starts, ends = pieces(data, bounds)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        keys, first, back = np.unique(tb.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > WORDS:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        if new.any():
            self._learn(keys[new], data, starts[first[new]], ends[first[new]])
            at = np.searchsorted(self.keys, keys)
        sizes = self.size[at][back]
        total = np.concatenate(([0], np.cumsum(sizes)))
        source = np.repeat(self.at[at][back] - total[:-1], sizes) + np.arange(total[-1])
        return self.ids[source], total[tb.rows_of(starts, bounds)]


_LOADED: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's tokenizer for a vocabulary file; it outlives tasks where Spark reuses workers."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]
