"""Deep-shallow sorting of byte strings: multikey refinement to a shallow depth, blind tries for what is still tied."""

from __future__ import annotations

import numpy as np

SHALLOW = 24


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian 64-bit words, zero-padded: comparing words compares bytes."""
    pad = -rows.shape[1] % 8
    wide = np.pad(rows, ((0, 0), (0, pad))) if pad else np.ascontiguousarray(rows)
    return wide.view(">u8").astype(np.uint64)


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Indices of the strings (equal length) in order. Inner nodes hold only a depth and branch bytes; an insertion
    walks down blindly, compares one string to find its common prefix, and branches there."""
    root: list | int = 0
    same: dict[int, list[int]] = {0: [0]}
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node, list):
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        other = strings[node]
        if other == s:
            same[node].append(i)
            continue
        lo, hi = 0, len(s)
        while lo < hi:  # length of the common prefix
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if s[:mid] == other[:mid] else (lo, mid - 1)
        same[i] = [i]
        up, key, node = None, 0, root
        while isinstance(node, list) and node[0] < lo:
            up, key, node = node, s[node[0]], node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == lo:
            node[1][s[lo]] = i
            continue
        new = [lo, {other[lo]: node, s[lo]: i}]
        if up is None:
            root = new
        else:
            up[1][key] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += same[node]
    return out


def deep_shallow(group: np.ndarray, rows: np.ndarray, lengths: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (group, bytes, length) and common prefix of each row with the one before it (-1 at a new group).

    rows: n x width bytes, zero beyond each row's length. Common prefixes count real bytes only.
    """
    n = len(rows)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    words = _words(rows)
    order = np.argsort(group, kind="stable")
    tied = np.r_[False, group[order[1:]] == group[order[:-1]]]  # with the row before
    for w in range(min(-(-shallow // 8), words.shape[1])):
        block = np.cumsum(~tied)
        inner = tied | np.r_[tied[1:], False]
        at = np.flatnonzero(inner)  # only tied runs are sorted further
        if not len(at):
            break
        own = order[at]
        again = np.lexsort((words[own, w], block[at]))
        order[at] = own[again]
        tied[1:] &= words[order[1:], w] == words[order[:-1], w]
    deep = 8 * -(-shallow // 8)
    edges = np.flatnonzero(~tied)
    sizes = np.diff(np.r_[edges, n])
    for s, m in zip(edges[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        own = order[s : s + m]
        tails = [rows[i, deep:].tobytes() + int(lengths[i]).to_bytes(4, "big") for i in own.tolist()]
        if tails.count(tails[0]) < m:
            order[s : s + m] = own[blind_trie_order(tails)]
    lcp = np.full(n, -1, dtype=np.int64)
    width = rows.shape[1]
    for s in range(1, n, 1 << 16):
        e = min(n, s + (1 << 16))
        a, b = order[s - 1 : e - 1], order[s:e]
        differ = rows[a] != rows[b]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lcp[s:e] = np.where(group[a] == group[b], np.minimum(same, np.minimum(lengths[a], lengths[b])), -1)
    return order, lcp
