"""Elias-Fano sequences and a two-level n-gram trie over them, for use inside tasks."""

from __future__ import annotations

import numpy as np

U = np.uint64


def encode(values: np.ndarray, bits: int) -> bytes:
    """A sorted sequence of ``bits``-bit numbers in about 2 + log2(2^bits / n) bits each.

    The low bits are stored side by side, the high bits in unary: value i sets
    bit high(i) + i.
    """
    n = len(values)
    low_bits = max(0, bits - max(n, 1).bit_length())
    head = np.array([n, low_bits], "<i8").tobytes()
    if not n:
        return head
    values = values.astype(U)
    marks = np.zeros(int(values[-1] >> U(low_bits)) + n, np.uint8)
    marks[(values >> U(low_bits)).astype(np.int64) + np.arange(n)] = 1
    words = np.zeros(n * low_bits // 64 + 2, U)
    if low_bits:
        low = values & U((1 << low_bits) - 1)
        at = np.arange(n) * low_bits
        word, shift = at >> 6, (at & 63).astype(U)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(low << shift, first)
        over = shift + U(low_bits) > U(64)
        words[word[over] + 1] |= low[over] >> (U(64) - shift[over])
    return head + words.tobytes() + np.packbits(marks, bitorder="little").tobytes()


class Sequence:
    """Random access and successor search on an encoded sequence, which may be a memory map."""

    def __init__(self, data):
        data = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
        self.n, self.low_bits = (int(x) for x in data[:16].view("<i8"))
        self.starts, self.high, self.words = np.zeros(2, np.int64), np.zeros(0, np.int64), np.zeros(2, U)
        if self.n:
            size = 8 * (self.n * self.low_bits // 64 + 2)
            self.words = data[16 : 16 + size].view("<u8")
            ones = np.flatnonzero(np.unpackbits(data[16 + size :], bitorder="little"))
            self.high = (ones - np.arange(len(ones))).astype(np.int64)
            # starts[h]: how many values have a smaller high part
            self.starts = np.searchsorted(self.high, np.arange(int(self.high[-1]) + 2))

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U)
        upper = np.where(shift > 0, self.words[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return ((self.words[word] >> shift) | upper) & U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.high[i].astype(U) << U(self.low_bits)) | self.low(i)

    def all(self) -> np.ndarray:
        return self.get(np.arange(self.n)) if self.n else np.zeros(0, U)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Position of the first value >= x (``n`` if there is none)."""
        h = (x >> U(self.low_bits)).astype(np.int64)
        last = len(self.starts) - 2
        inside = (h <= last) & (self.n > 0)
        c = np.minimum(h, last)
        pos = np.where(inside, self.starts[c], self.n)
        end = np.where(inside, self.starts[c + 1], self.n)
        want = x & U((1 << self.low_bits) - 1)
        todo = np.flatnonzero(pos < end)
        while len(todo):  # binary search among the values of the same high part
            mid = (pos[todo] + end[todo]) >> 1
            less = self.low(mid) < want[todo]
            pos[todo] = np.where(less, mid + 1, pos[todo])
            end[todo] = np.where(less, end[todo], mid)
            todo = todo[pos[todo] < end[todo]]
        return pos

    def find(self, x: np.ndarray) -> np.ndarray:
        """Position of x, or -1."""
        pos = self.successor(x)
        there = np.flatnonzero(pos < self.n)
        out = np.full(len(x), -1, np.int64)
        hit = there[self.get(pos[there]) == x[there]]
        out[hit] = pos[hit]
        return out


def build_trie(context: np.ndarray, word: np.ndarray, codes: np.ndarray, context_bits: int, word_bits: int) -> bytes:
    """Levels of a trie: contexts, monotone pointers to their children, children, one code per child.

    Rows are sorted by (context, word) and distinct. A child is stored as its
    word plus its context's number times 2^word_bits, so that the whole level is
    one monotone sequence.
    """
    new = np.flatnonzero(np.diff(context, prepend=context[:1] ^ U(1) if len(context) else context))
    number = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(context))))
    levels = [
        encode(context[new], context_bits),
        encode(np.append(new, len(context)), max(1, len(context).bit_length())),
        encode((number.astype(U) << U(word_bits)) | word, word_bits + max(1, len(new).bit_length())),
        codes.astype(np.uint8).tobytes(),
    ]
    pad = [x + b"\0" * (-len(x) % 8) for x in levels]
    return np.array([word_bits, *map(len, pad)], "<i8").tobytes() + b"".join(pad)


class Trie:
    """Lookup in the levels written by ``build_trie``; ``data`` may be a memory map."""

    def __init__(self, data: np.ndarray):
        head = data[:40].view("<i8")
        self.word_bits = int(head[0])
        at = 40 + np.concatenate([[0], np.cumsum(head[1:])])
        self.contexts, self.pointers, self.children = (Sequence(data[at[i] : at[i + 1]]) for i in range(3))
        self.codes = data[at[3] :]

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Code of each (context, word), 0 where it is not in the trie."""
        out = np.zeros(len(word), np.uint8)
        number = self.contexts.find(context)
        here = np.flatnonzero(number >= 0)
        if len(here):
            want = (number[here].astype(U) << U(self.word_bits)) | word[here]
            pos = self.children.successor(want)  # the successor relative to the context's own range
            inside = pos < self.pointers.get(number[here] + 1).astype(np.int64)
            here, pos, want = here[inside], pos[inside], want[inside]
            hit = self.children.get(pos) == want
            out[here[hit]] = self.codes[pos[hit]]
        return out
