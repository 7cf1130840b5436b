"""Edit distances of many pairs of strings at once, up to a bound for each.

Myers' bit-parallel columns, kept to the band of diagonals that a script within the bound can
visit and carried for a whole block of pairs by numpy. Values along the diagonal that ends in
the last cell never fall, so a pair leaves its block as soon as they pass its bound.
"""

from __future__ import annotations

import numpy as np

#: Entries of a block's table of places, and columns between two looks at who is left.
TABLE_WORDS = 1 << 20
LOOK = 16
_ONE = np.uint64(1)
_ALL = np.uint64((1 << 64) - 1)


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the Levenshtein distance of a[i] and b[i] is at most most[i]."""
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    m = np.array([len(x) for x, _ in pairs], dtype=np.int64)
    n = np.array([len(y) for _, y in pairs], dtype=np.int64)
    out = m <= most
    todo = np.flatnonzero(~out & (m - n <= most))
    # Pairs of like lengths and like differences of length, which need like bands.
    todo = todo[np.lexsort((m[todo] - n[todo], m[todo] // 64))]
    at = 0
    while at < len(todo):
        # The table of the longest of so many must fit.
        size = min(2048, max(16, TABLE_WORDS // (100 * (int(m[todo[min(at + 255, len(todo) - 1)]]) // 64 + 3))))
        part = todo[at : at + size]
        out[part] = _block([pairs[i][0] for i in part], [pairs[i][1] for i in part], most[part].astype(np.int64))
        at += size
    return out


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _block(a: list[str], b: list[str], k: np.ndarray) -> np.ndarray:
    """As within, for pairs whose first string is not the shorter one."""
    pairs = len(a)
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    # A script of k edits that ends on diagonal m - n goes no farther than this to either side of the first one.
    below, above = int((k - (m - n)).max()) // 2, int((k + (m - n)).max()) // 2
    width = below + above + 1
    words = -(-width // 64)
    top = _ALL >> np.uint64(64 * words - width)

    letters, flat = np.unique(np.concatenate([_codes(a), _codes(b)]), return_inverse=True)
    none = len(letters)
    columns = (max(int(m.max()) + below, int(n.max())) >> 6) + words + 2
    if pairs > 1 and pairs * (none + 1) * columns > 4 * TABLE_WORDS:
        half = pairs // 2
        return np.concatenate([_block(a[:half], b[:half], k[:half]), _block(a[half:], b[half:], k[half:])])
    # Row p * (none + 1) + c: the places of letter c in a[p], after as many zero bits as the band reaches below.
    owner = np.repeat(np.arange(pairs), m)
    place = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + below
    table = np.zeros((pairs * (none + 1), columns), dtype=np.uint64)
    np.bitwise_or.at(table, (owner * (none + 1) + flat[: len(owner)], place >> 6), _ONE << (place & 63).astype(np.uint64))
    text = np.full((pairs, int(n.max())), none, dtype=np.int64)
    text[np.repeat(np.arange(pairs), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] = flat[len(owner) :]
    text += np.arange(pairs)[:, None] * (none + 1)
    text = np.ascontiguousarray(text.T)

    # Rows 1 and on of column 0 rise by one; the rows of the band above them do not.
    up = np.zeros((words, pairs), dtype=np.uint64)
    down = np.zeros((words, pairs), dtype=np.uint64)
    for w in range(words):
        rising = [1 << (bit - 64 * w) for bit in range(max(below, 64 * w), min(width, 64 * w + 64))]
        up[w] += np.uint64(sum(rising))
    out = np.zeros(pairs, dtype=bool)
    live = np.arange(pairs)
    # The value on the last cell's diagonal, and the bit of the band that stands for it.
    score = m - n
    bit = m - n + below
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    for j in range(text.shape[0]):
        if j % LOOK == 0 and j:
            done = n <= j
            out[live[done]] = score[done] <= k[done]
            stay = np.flatnonzero(~done & (score <= k))
            if len(stay) < 0.9 * len(live):
                live, n, k, score, word, shift = live[stay], n[stay], k[stay], score[stay], word[stay], shift[stay]
                up, down = up[:, stay], down[:, stay]
            if not len(live):
                return out
        q, s = j >> 6, np.uint64(j & 63)
        window = table[text[j][live], q : q + words + 1].T
        carry = None
        flat_steps = np.empty_like(up)
        for w in range(words):
            x = window[w] >> s
            if s:
                x |= window[w + 1] << (np.uint64(64) - s)
            if w == words - 1:
                x &= top
            v = up[w]
            t = x & v
            total = t + v
            if w + 1 < words:
                over = total < t
            if carry is not None:
                total += carry
                if w + 1 < words:
                    over |= total < carry
            if w + 1 < words:
                carry = over.astype(np.uint64)
            np.bitwise_or((total ^ v) | x, down[w], out=flat_steps[w])
        flat_steps[-1] &= top
        score += (n > j) & ((flat_steps[word, np.arange(len(live))] >> shift) & _ONE == 0)
        lower = flat_steps >> _ONE
        lower[:-1] |= flat_steps[1:] << np.uint64(63)
        rises = down | ~(flat_steps | up)
        rises[-1] &= top
        falls = flat_steps & up
        up = falls | ~(lower | rises)
        up[-1] &= top
        down = lower & rises
    out[live] = score <= k
    return out
