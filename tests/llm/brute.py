"""Plain versions to hold operators against."""

import re
from collections import Counter, defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}


def jaccard_classes(rows, size, percent):
    """(doc_id, tokens, least reachable id) by comparing all pairs that share a token."""
    sets = {}
    for i, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))) if ws else frozenset()
    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in sets.items():
        shared = Counter(j for g in s for j in inverted[g] if j < i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def smith_waterman(a, b, match=2, mismatch=-1, gap=-1):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), h[i - 1][j] + gap, h[i][j - 1] + gap)
            best = max(best, h[i][j])
    return best


def viterbi(scores, penalty):
    """Best sum over all paths by dynamic programming, one word at a time."""
    best = [0.0] * len(scores[0])
    for row in scores:
        top = max(best)
        best = [max(b, top - penalty) + s for b, s in zip(best, row, strict=True)]
    return max(best)
