"""Sorted runs of byte strings: front coding, and merging by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two strings that are known to agree before start."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n if not x else n - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of each string of a sorted run, how much it shares with the one before it, and the rest."""
    shared, rest, last = [], [], b""
    for s in strings:
        n = common_prefix(last, s)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return shared, rest


def decode(run: tuple[list[int], list[bytes]]) -> Iterator[tuple[int, bytes]]:
    last = b""
    for n, rest in zip(*run, strict=True):
        last = last[:n] + rest
        yield n, last


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, common prefix with the string before, string) of all runs in order; ties by run.

    A node keeps the loser of its match with the prefix that it shares with the winner. When the winner's run moves on,
    its next string and every loser on its path are known relative to that winner, so the longer known prefix wins
    unseen, and equal ones are compared only beyond it.
    """
    k = len(runs)
    streams = [decode(r) for r in runs]
    strings: list[bytes | None] = [None] * k
    shared = [0] * k

    def advance(r: int) -> None:
        got = next(streams[r], None)
        shared[r], strings[r] = got if got is not None else (0, None)

    def beats(a: int, b: int) -> bool:
        """Whether run a's string comes first; sets what the loser shares with the winner."""
        x, y = strings[a], strings[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        n = common_prefix(x, y, shared[a])
        first = (x[n:] < y[n:]) if x != y else a < b
        shared[b if first else a] = n
        return first

    size = 1
    while size < k:
        size *= 2
    for r in range(k):
        advance(r)
        shared[r] = 0
    tree = [-1] * size

    def play(node: int) -> int:
        if node >= size:
            return node - size if node - size < k else -1
        a, b = play(2 * node), play(2 * node + 1)
        if a < 0 or b < 0:
            return max(a, b)
        won = beats(a, b)
        tree[node] = b if won else a
        return a if won else b

    winner = play(1) if k else -1
    while winner >= 0 and strings[winner] is not None:
        yield winner, shared[winner], strings[winner]
        advance(winner)
        node = (winner + size) // 2
        while node:
            other = tree[node]
            if other >= 0 and not beats(winner, other):
                tree[node], winner = winner, other
            node //= 2
