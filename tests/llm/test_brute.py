"""Plain forms that the other tests compare with."""

from collections import defaultdict


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def shingles(text, n=5):
    w = (text or "").lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < n else (tuple(w[i : i + n]) for i in range(len(w) - n + 1)))


def jaccard_links(rows, least=0.8):
    """All pairs of ids with equal sets or a similarity of ``least`` or more, found through an inverted index."""
    sets = [(i, shingles(t)) for i, t in rows]
    holders, common = defaultdict(list), defaultdict(int)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for ks in holders.values():
        for a in range(len(ks)):
            for b in range(a):
                common[ks[b], ks[a]] += 1
    return [(sets[a][0], sets[b][0]) for (a, b), n in common.items() if n / (len(sets[a][1]) + len(sets[b][1]) - n) >= least]


def test_jaccard_links_by_hand():
    rows = [(1, "a b c d e"), (2, "A b c  d e"), (3, "a b c d e f"), (4, "a b"), (5, "a b"), (6, "")]
    assert sorted(jaccard_links(rows)) == [(1, 2), (4, 5)]
