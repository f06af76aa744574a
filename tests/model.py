"""An independent plain-Python model of the overlap rules."""

BAD = set("HIJKLMNOXYZ[\\]^_hijklmnoxyz{|}~\x7f")
CODE = {"A": 1, "C": 2, "T": 3, "G": 4}


def complement(seq):
    return "".join({"A": "T", "T": "A", "C": "G", "G": "C"}[c] for c in reversed(seq.upper()))


def fp(seq, p1=536870909, r1=5, p2=536870879, r2=7):
    a = b = 0
    for c in seq:
        a, b = (a * r1 + CODE[c]) % p1, (b * r2 + CODE[c]) % p2
    return a << 32 | b


def unique(reads):
    seen = {}
    for n, seq in enumerate(r for r in reads if not BAD & set(r)):
        for i, s in ((2 * n, seq), (2 * n + 1, complement(seq))):
            seen.setdefault(s, i)
    return {i: s for s, i in seen.items()}


def pairs(rows, n):
    by = {}
    for i, s in rows.items():
        by.setdefault(s[:n], []).append(i)
    return [(i, j) for i, s in rows.items() for j in by.get(s[-n:], []) if i // 2 != j // 2]


def all_overlaps(rows, least):
    size = len(next(iter(rows.values()), ""))
    return {(i, j, n) for n in range(least, size) for i, j in pairs(rows, n)}


def greedy(rows, least):
    size = len(next(iter(rows.values()), ""))
    out, used_src, used_dst = set(), set(), set()
    for n in range(size - 1, least - 1, -1):
        new = {(i, j) for i, j in pairs(rows, n) if i not in used_src and j not in used_dst}
        out |= {(i, j, n) for i, j in new}
        used_src |= {i for i, _ in new}
        used_dst |= {j for _, j in new}
    return out
