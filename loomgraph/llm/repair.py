"""Grammars of token sequences.

``re_pair`` replaces the most frequent pairs of one sequence again and again;
its rules show how much a text repeats itself. ``shared_phrases`` parses locally:
where a phrase ends depends on the tokens around that place alone, so a piece
that two files have in common is made of the same rules in both, whether or not
it repeats within either.
"""

from __future__ import annotations

from collections import Counter

import xxhash


def re_pair(sequence: list, least: int = 2) -> tuple[list, dict[int, tuple]]:
    """(start rule, rules): rules map a negative symbol to the pair it stands for.

    Each round replaces, left to right, all pairs that are at least half as
    frequent as the most frequent one, so the rounds grow with the logarithm of
    the length; pairs that occur fewer than ``least`` times stay. Equal pairs
    overlap only in runs, where every second one is taken.
    """
    coded: dict = {}
    seq = [coded.setdefault(token, len(coded)) for token in sequence]
    rules: dict[int, tuple] = {}
    named: dict[tuple, int] = {}
    while len(seq) > 3:
        counts = Counter(zip(seq, seq[1:]))
        top = max(counts.values())
        if top < least:
            break
        # Once only the rarest pairs are left, they are all replaced in one round.
        bar = max(least, (top + 1) // 2)
        chosen = {pair for pair, n in counts.items() if n >= bar}
        out, i, last = [], 0, len(seq) - 1
        used: Counter = Counter()
        while i < last:
            pair = (seq[i], seq[i + 1])
            if pair in chosen:
                symbol = named.get(pair)
                if symbol is None:
                    symbol = named[pair] = -len(named) - 1
                    rules[symbol] = pair
                used[symbol] += 1
                out.append(symbol)
                i += 2
            else:
                out.append(seq[i])
                i += 1
        if i == last:
            out.append(seq[last])
        if len(out) == len(seq):
            break
        seq = out
        if bar == least and max(used.values()) < least:
            break
    back = list(coded)
    start = [back[s] if s >= 0 else ("rule", s) for s in seq]
    return start, {s: tuple(back[x] if x >= 0 else ("rule", x) for x in pair) for s, pair in rules.items()}


def grammar_size(start: list, rules: dict) -> int:
    return len(start) + 2 * len(rules)


def explained(start: list, rules: dict) -> Counter:
    """How often each token stands in the part of the sequence that rules explain."""
    uses = Counter(x[1] for x in start if isinstance(x, tuple))
    tokens: Counter = Counter()
    # A rule is made of tokens and of older rules.
    for symbol in sorted(rules):
        for x in rules[symbol]:
            if isinstance(x, tuple):
                uses[x[1]] += uses[symbol]
            else:
                tokens[x] += uses[symbol]
    return tokens


def shared_phrases(sequence: list[str], least: int) -> list[int]:
    """Hashes of the rules of at least ``least`` tokens in a locally consistent grammar of the sequence.

    On every level a phrase ends before a symbol whose hash is smaller than
    those on both sides, so a phrase has two symbols or more and a level less
    than half as many as the one below. The first and last phrase of a level
    are cut by the ends of the file and no rules.
    """
    level = [(xxhash.xxh64_intdigest(token), 1, False) for token in sequence]
    found: set[int] = set()
    while len(level) > 2:
        cuts = [i for i in range(1, len(level) - 1) if level[i - 1][0] > level[i][0] <= level[i + 1][0]]
        bounds = [0, *cuts, len(level)]
        above = []
        for a, b in zip(bounds, bounds[1:]):
            parts = level[a:b]
            size, broken = sum(p[1] for p in parts), a == 0 or b == len(level) or any(p[2] for p in parts)
            h = xxhash.xxh64_intdigest(b"".join(p[0].to_bytes(8, "big") for p in parts))
            above.append((h, size, broken))
            if size >= least and not broken:
                found.add(h - (1 << 64) if h >> 63 else h)
        if len(above) == len(level):
            break
        level = above
    return sorted(found)
