"""Byte-level BPE on ragged numpy arrays.

Texts are cut into pre-tokens by classes of bytes, without a Python object for any of them.
A pre-token's ids depend on nothing else, so that each distinct one is merged once for a
worker's batches and then found in a hash table of numpy arrays.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import regex

from loam.llm.arrays import hashes, held_between_tasks, mix

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int32).max
#: Pre-tokens beyond this many bytes merge one by one, on lists of places by rank: a round over all of their symbols for each rank would take quadratic time.
LONG = 256
#: Bytes of text that are worked on at once; one text is never cut.
AT_ONCE = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Merges:
    """A vocabulary as numpy tables: ids of bytes, and ranks of the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        bits = int(3 * len(pairs) + 64).bit_length()
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        live, slot = np.arange(len(keys)), self._slots(keys)
        while len(live):
            free = np.flatnonzero(self.keys[slot] < 0)
            taken, at = np.unique(slot[free], return_index=True)
            who = free[at]
            self.keys[taken], self.values[taken] = keys[live[who]], values[live[who]]
            on = np.ones(len(live), bool)
            on[who] = False
            live, slot = live[on], (slot[on] + 1) & (len(self.keys) - 1)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # Ranks whose merge may make a pair of a lower rank, with which it then wouldn't go on with the other places of its own.
        merged = np.array([len(self.bytes_of.get(i, b"")) > 1 for i in range(max(ranks.values(), default=0) + 1)])
        left, right, rank = keys >> 32, keys & (2**32 - 1), values
        self.doubtful = np.zeros(len(merged), bool)
        self.doubtful[left[merged[left] & (left >= rank)]] = True
        self.doubtful[right[merged[right] & (right >= rank)]] = True

    @property
    def pairs(self) -> dict[int, int]:
        """The rank of each pair, known by left << 32 | right."""
        there = self.keys >= 0
        return dict(zip(self.keys[there].tolist(), self.values[there].tolist()))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it doesn't merge."""
        key = np.asarray(left, np.int64) << 32 | right
        slot = self._slots(key)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], NONE)
        live = np.flatnonzero((there != key) & (there >= 0))
        slot = slot[live]
        while len(live):
            slot = (slot + 1) & (len(self.keys) - 1)
            there = self.keys[slot]
            same = there == key[live]
            out[live[same]] = self.values[slot[same]]
            on = ~same & (there >= 0)
            live, slot = live[on], slot[on]
        return out

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def symbols(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (their bytes in a row) in a row, and where each word's begin (one more at the end).

        In each round every unfinished word merges its lowest-ranked pair wherever it stands, from
        the left, up to a place where that makes a pair of a lower rank.
        """
        begins = np.cumsum(sizes) - sizes
        long = np.flatnonzero(sizes > LONG)
        found = [(np.array([i]), self.by_ranks(data[begins[i] : begins[i] + sizes[i]])) for i in long]
        lengths = sizes.copy()
        lengths[long] = [len(ids) for _, ids in found]
        which = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        symbol = self.of_byte[data[np.repeat(sizes <= LONG, sizes)] if len(long) else data]
        size = sizes[which]
        start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(which), dtype=np.int32), size)
        rank = np.full(len(symbol), NONE, np.int32)
        if len(symbol) > 1:
            rank[:-1] = self.rank(symbol[:-1], symbol[1:])
            rank[start[1:] - 1] = NONE
        while len(which):
            low = np.minimum.reduceat(rank, start)
            live = low < NONE
            if not live.all():
                keep = live[owner]
                found.append((which[~live], symbol[~keep]))
                lengths[which[~live]] = size[~live]
                which, size, low = which[live], size[live], low[live]
                symbol, rank = symbol[keep], rank[keep]
                start = np.cumsum(size) - size
                owner = np.repeat(np.arange(len(which), dtype=np.int32), size)
                if not len(which):
                    break
            at = np.flatnonzero(rank == low[owner])
            at = at[apart(at[1:] == at[:-1] + 1)]
            word = owner[at]
            doubt = np.flatnonzero(self.doubtful[low[word]])
            if len(doubt):
                i, w = at[doubt], word[doubt]
                before = np.where(np.isin(i - 2, i), low[w], symbol[i - 1])
                behind = symbol[np.minimum(i + 2, len(symbol) - 1)]
                lower = (i > start[w]) & (self.rank(before, low[w]) < low[w]) | (i + 2 < (start + size)[w]) & (self.rank(low[w], behind) < low[w])
                if lower.any():
                    sums = np.cumsum(lower) - lower
                    begin = np.maximum.accumulate(np.where(np.append(True, w[1:] != w[:-1]), np.arange(len(w)), 0))
                    take = np.ones(len(at), bool)
                    take[doubt] = sums == sums[begin]
                    at, word = at[take], word[take]
            symbol[at] = low[word]
            last = at + 2 == (start + size)[word]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, rank, owner = symbol[keep], rank[keep], owner[keep]
            size = size - np.bincount(word, minlength=len(size))
            start = np.cumsum(size) - size
            at = at - np.arange(len(at))
            right = at[~last]
            rank[at[last]] = NONE
            rank[right] = self.rank(symbol[right], symbol[right + 1])
            left = at[at > start[word]] - 1
            rank[left] = self.rank(symbol[left], symbol[left + 1])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        out = np.empty(int(lengths.sum()), np.int32)
        for words_at, ids in found:
            n = lengths[words_at]
            out[np.arange(len(ids)) + np.repeat(starts[words_at] - (np.cumsum(n) - n), n)] = ids
        return out, np.append(starts, len(out))

    def by_ranks(self, word: np.ndarray) -> np.ndarray:
        """The same merges for one long word: the places of each rank are kept in lists, so that a round costs as much as it merges."""
        symbol = np.append(self.of_byte[word], -1)
        n = len(word)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.rank(symbol[at], symbol[after[at]])
            at, rank = at[rank < NONE], rank[rank < NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            for a, b in _cuts(rank):
                r = int(rank[a])
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(at[a:b])

        add(np.arange(n - 1))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[symbol[at] >= 0]
            at = at[self.rank(symbol[at], symbol[after[at]]) == r]
            if not len(at):
                continue
            whole = at
            at = at[apart(at[1:] == after[at[:-1]])]
            rest = at[:0]
            if self.doubtful[r]:
                left, right = before[at], after[after[at]]
                far = np.where(np.append(False, left[1:] == after[at[:-1]]), r, symbol[left])
                all_r = np.full(len(at), r)
                lower = (left >= 0) & (self.rank(far, all_r) < r) | (right < n) & (self.rank(all_r, symbol[right]) < r)
                if lower.any():
                    at = at[: int(lower.argmax()) + 1]
                    rest = whole[whole > after[at[-1]]]
            gone = after[at]
            symbol[at], symbol[gone] = r, -1
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            changed = np.unique(np.concatenate([at, left[left >= 0], rest]))
            add(changed[after[changed] < n])
        return symbol[:n][symbol[:n] >= 0]


def _cuts(values: np.ndarray):
    """(start, end) of the runs of equal values."""
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)) if len(values) else np.empty(0, np.int64)
    return zip(np.append(0, ends[:-1]).tolist() if len(ends) else [], ends.tolist())


def apart(overlaps: np.ndarray) -> np.ndarray:
    """Which of a row of places to take so that none overlaps the one before it, from the left. overlaps: whether each but the first touches the one before."""
    n = len(overlaps) + 1
    begins = np.append(True, ~overlaps)
    first = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    return (np.arange(n) - first) % 2 == 0


# --- pre-tokens ---

_SPACE, _LETTER, _DIGIT, _OTHER, _WHITE, _HARD, _NEXT = range(7)
_CLASS = np.full(256, _HARD, np.uint8)
_CLASS[:128] = [_SPACE if b == 32 else _WHITE if 9 <= b <= 13 else _HARD if 28 <= b <= 31 else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _OTHER for b in range(128)]
_CLASS[0x80:0xC0], _CLASS[0xC3:0xCA] = _NEXT, _LETTER  # U+00C0 to U+027F: letters but for two
_FIND = regex.compile(PATTERN).findall


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of all texts begin.

    Runs of letters, digits and others, with a space before them, and white space are found by
    the classes of bytes. What holds other characters is left to the pattern, between the
    nearest lone spaces on both sides, across which no pre-token goes.
    """
    size = len(data)
    if not size:
        return np.empty(0, np.int64)
    kind = _CLASS[data]
    first = np.zeros(size + 1, bool)
    first[offsets] = True
    after = np.flatnonzero(kind == _NEXT)
    if len(after):
        lead = data[after - 1]
        kind[after] = np.where((lead >= 0xC3) & (lead <= 0xC9), _LETTER, _HARD)
        sign = after[(lead == 0xC3) & ((data[after] == 0x97) | (data[after] == 0xB7))]
        kind[sign], kind[sign - 1] = _OTHER, _OTHER
    white = (kind == _SPACE) | (kind == _WHITE)
    run = np.where(white, _SPACE, kind)
    flag = first[:size].copy()
    flag[1:] |= run[1:] != run[:-1]
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:size])
    flag[last] = True
    flag[last + 1] = data[last] != 32
    quote = np.flatnonzero(data == 39)
    if len(quote):
        ahead = np.concatenate([data, np.zeros(2, np.uint8)])
        before = kind[quote - 1]
        quote = quote[first[quote] | (before == _LETTER) | (before == _DIGIT) | (before == _WHITE)]
        one, two = ahead[quote + 1], ahead[quote + 2]
        inside = ~first[quote + 1]
        short = inside & np.isin(one, list(b"stmd"))
        long = inside & ~first[np.minimum(quote + 2, size)] & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        for found, n in ((quote[short], 2), (quote[long], 3)):
            flag[found + 1] = False
            end = found + n
            flag[end[end < size]] = True
    hard = np.flatnonzero(kind == _HARD)
    if len(hard):
        plain = (kind >= _LETTER) & (kind <= _OTHER)
        cut = np.flatnonzero((data[1:-1] == 32) & plain[:-2] & plain[2:] & ~first[1 : size - 1] & ~first[2:size]) + 1
        bounds = np.union1d(cut, offsets)
        at = np.unique(np.searchsorted(bounds, hard, "right") - 1)
        for a, b in zip(bounds[at].tolist(), bounds[at + 1].tolist()):
            words = _FIND(data[a:b].tobytes().decode("utf-8", "surrogatepass"))
            flag[a:b] = False
            flag[a + np.cumsum([0, *(len(w.encode("utf-8", "surrogatepass")) for w in words[:-1])])] = True
    return np.flatnonzero(flag)


_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


class Pieces:
    """The ids of texts, by way of their distinct pre-tokens.

    merge takes words that are no tokens themselves (their bytes in a row, and sizes) and
    returns their ids in a row and where each word's begin. A pre-token of up to 16 bytes is
    known by its bytes, a longer one by two 64-bit hashes. What is known is dropped when it
    is more than `most` pre-tokens, so that a worker's memory stays bounded; this changes the
    speed alone.
    """

    def __init__(self, ranks: dict[bytes, int], merge, most: int = 250_000):
        self.ranks, self.merge, self.most = ranks, merge, most
        self.tokens = (np.frombuffer(b"".join(ranks), np.uint8), np.array([len(t) for t in ranks], np.int64), np.array(list(ranks.values()), np.int32))
        self._clear()

    def _clear(self) -> None:
        data, size, ids = self.tokens
        bits = int(2 * (self.most + len(size))).bit_length()
        self.shift = np.uint64(64 - bits)
        self.word, self.more, self.length, self.at = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.flat, self.used = np.empty(1 << 18, np.int32), 0
        self.start, self.size, self.n = np.empty(1 << 17, np.int64), np.empty(1 << 17, np.int64), 0
        self._insert(*self._keys(data, np.cumsum(size) - size, size), self._store(ids, np.ones(len(ids), np.int64)))

    def _keys(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray(len(data) + 9, "<u8", padded, 0, (1,))
        word = eight[start] & _LOW[np.minimum(size, 8)]
        more = np.zeros(len(start), np.uint64)
        long = np.flatnonzero(size > 8)
        more[long] = eight[start[long] + 8] & _LOW[np.minimum(size[long] - 8, 8)]
        long = long[size[long] > 16]
        if len(long):
            n = size[long]
            values = data[np.repeat(start[long] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            word[long], more[long] = hashes(values, n), hashes(values ^ np.uint8(0x5A), n)
        return word, more, size.astype(np.int32)

    def _slots(self, word: np.ndarray, more: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (mix(word ^ more * np.uint64(0x9E3779B97F4A7C15) ^ size.astype(np.uint64) << np.uint64(59)) >> self.shift).astype(np.int64)

    def _find(self, word: np.ndarray, more: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The place of each pre-token, -1 where it isn't known."""
        out = np.full(len(word), -1, np.int64)
        live, slot = np.arange(len(word)), self._slots(word, more, size)
        while len(live):
            there = self.length[slot]
            same = (there == size[live]) & (self.word[slot] == word[live]) & (self.more[slot] == more[live])
            out[live[same]] = self.at[slot[same]]
            on = ~same & (there > 0)
            live, slot = live[on], (slot[on] + 1) & (len(self.at) - 1)
        return out

    def _insert(self, word: np.ndarray, more: np.ndarray, size: np.ndarray, places: np.ndarray) -> None:
        live, slot = np.arange(len(word)), self._slots(word, more, size)
        while len(live):
            free = np.flatnonzero(self.length[slot] == 0)
            taken, at = np.unique(slot[free], return_index=True)
            who = live[free[at]]
            self.word[taken], self.more[taken], self.length[taken], self.at[taken] = word[who], more[who], size[who], places[who]
            on = np.ones(len(live), bool)
            on[free[at]] = False
            live, slot = live[on], (slot[on] + 1) & (len(self.at) - 1)

    def _store(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(size) > len(self.size):
            self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        at = np.arange(self.n, self.n + len(size))
        self.start[at], self.size[at] = np.cumsum(size) - size + self.used, size
        self.used, self.n = self.used + len(flat), self.n + len(size)
        return at

    def _places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of all pre-tokens of the texts in a row, and where each text's begin (one more at the end)."""
        start = pre_tokens(data, offsets)
        size = np.diff(np.append(start, len(data)))
        word, more, length = self._keys(data, start, size)
        places = self._find(word, more, length)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            order = missing[np.lexsort((length[missing], more[missing], word[missing]))]
            new = np.append(True, (word[order[1:]] != word[order[:-1]]) | (more[order[1:]] != more[order[:-1]]) | (length[order[1:]] != length[order[:-1]]))
            head = order[new]
            if self.n + len(head) > self.most + len(self.tokens[1]):
                self._clear()
                return self._places(data, offsets) if len(head) <= self.most else self._more_than_fit(data, offsets)
            n = size[head]
            ids, starts = self.merge(data[np.repeat(start[head] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n)
            at = self._store(ids, np.diff(starts))
            self._insert(word[head], more[head], length[head], at)
            places[order] = at[np.cumsum(new) - 1]
        return places, np.searchsorted(start, offsets)

    def _more_than_fit(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """With a table as large as this run needs."""
        most, self.most = self.most, len(data)
        self._clear()
        try:
            return self._places(data, offsets)
        finally:
            self.most = most  # the next run that adds anything clears it

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many ids each text has."""
        places, bounds = self._places(data, offsets)
        return np.diff(np.append(0, np.cumsum(self.size[places]))[bounds])

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row and how many each has."""
        places, bounds = self._places(data, offsets)
        size = self.size[places]
        return gather(self.flat, self.start[places], size), np.diff(np.append(0, np.cumsum(size))[bounds])


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of the pool that begin at start, one after another."""
    ends = np.cumsum(size)
    return pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)]


_held: dict = {}
held_between_tasks("bpe", _held.clear)


def held_pieces(path: str) -> Pieces:
    """One Pieces of a vocabulary file for all tasks of a worker process, with rank-synchronous merging."""
    if path not in _held:
        merges = Merges(load_ranks(path))
        _held[path] = Pieces(merges.ranks, merges.symbols)
    return _held[path]
