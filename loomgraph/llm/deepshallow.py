"""Deep-shallow sorting of strings (Manzini and Ferragina): multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

#: Characters that multikey quicksort looks at beyond the common prefix before a group goes to a blind trie.
SHALLOW = 16


def lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "children")

    def __init__(self, depth: int):
        self.depth, self.children = depth, {}


def blind_trie(strings: list[bytes], rows: list[int]) -> tuple[list[int], list[int]]:
    """Sorted rows, and the common prefix length of each with the one before (the first has 0).

    The trie holds only the depths at which strings branch and the characters there (-1 where one ends).  An insertion goes down
    blindly to some leaf, compares with that one string, and hangs the new leaf where the two part.  Equal strings share a leaf.
    """
    if len(rows) == 1:
        return rows, [0]
    root: _Node | list = [rows[0]]
    for row in rows[1:]:
        s = strings[row]
        at = root
        while isinstance(at, _Node):
            c = s[at.depth] if at.depth < len(s) else -1
            at = at.children[c] if c in at.children else next(iter(at.children.values()))
        t = strings[at[0]]
        d = lcp(s, t)
        if d == len(s) == len(t):
            at.append(row)
            continue
        parent, c, at = None, 0, root
        while isinstance(at, _Node) and at.depth < d:
            parent, c = at, (s[at.depth] if at.depth < len(s) else -1)
            at = at.children[c]
        if isinstance(at, _Node) and at.depth == d:
            at.children[s[d] if d < len(s) else -1] = [row]
            continue
        node = _Node(d)
        node.children[t[d] if d < len(t) else -1] = at
        node.children[s[d] if d < len(s) else -1] = [row]
        if parent is None:
            root = node
        else:
            parent.children[c] = node
    order: list[int] = []
    common: list[int] = []
    stack: list[tuple] = [(root, 0)]
    while stack:
        at, before = stack.pop()
        if isinstance(at, _Node):
            keys = sorted(at.children, reverse=True)
            for c in keys:  # the last pushed, the smallest, keeps what stands between it and the one before
                stack.append((at.children[c], before if c == keys[-1] else at.depth))
        else:
            order += at
            common += [before] + [len(strings[at[0]])] * (len(at) - 1)
    return order, common


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Indices in sorted order, and the common prefix length of each with the one before (the first has 0)."""
    order: list[int] = []
    common: list[int] = []
    if not strings:
        return order, common
    start = lcp(min(strings), max(strings))
    # Tasks: (rows, depth known to be common, common prefix with what precedes the group in sorted order).
    stack = [(list(range(len(strings))), start, 0)]
    while stack:
        rows, depth, before = stack.pop()
        if len(rows) == 1:
            order += rows
            common.append(before)
            continue
        if depth - start >= shallow or len(rows) <= 8:
            o, c = blind_trie(strings, rows)
            c[0] = before
            order += o
            common += c
            continue
        chars = [strings[r][depth] if depth < len(strings[r]) else -1 for r in rows]
        pivot = sorted(chars[:: max(1, len(chars) // 9)])[min(4, (len(chars) - 1) // 2)] if len(chars) >= 9 else chars[len(chars) // 2]
        less = [r for r, c in zip(rows, chars) if c < pivot]
        same = [r for r, c in zip(rows, chars) if c == pivot]
        more = [r for r, c in zip(rows, chars) if c > pivot]
        parts = [(less, depth), (same, depth + 1 if pivot >= 0 else -1), (more, depth)]
        parts = [p for p in parts if p[0]]
        for k in range(len(parts) - 1, -1, -1):
            sub, d = parts[k]
            ahead = before if k == 0 else depth
            stack.append((sub, start + shallow if d < 0 else d, ahead))  # strings that end here are equal: one trie leaf
    return order, common
