"""Plain, literal versions of the kernels: full matrices, cell by cell."""

from __future__ import annotations


def segment(r: str, monomers: list[str], ins=-1, dele=-1, mis=-1, match=1):
    n, low = len(r), -(10**9)
    mm = lambda i, j, k: match if monomers[j][k] == r[i] else mis
    d = [[[low] * len(m) for m in monomers] for _ in range(n)]
    top = [low] * n
    for j, m in enumerate(monomers):
        for k in range(len(m)):
            d[0][j][k] = mm(0, j, 0) if k == 0 else max(d[0][j][k - 1] + dele, dele * (k - 1) + mm(0, j, k))
    for i in range(1, n):
        top[i] = max(d[i - 1][j][-1] for j in range(len(monomers)))
        for j, m in enumerate(monomers):
            for k in range(len(m)):
                best = top[i] + mm(i, j, k) + k * dele
                if k:
                    best = max(best, d[i - 1][j][k - 1] + mm(i, j, k), d[i - 1][j][k] + ins, d[i][j][k - 1] + dele)
                d[i][j][k] = best
    total = max(d[n - 1][j][-1] for j in range(len(monomers)))
    first = lambda i, v: next(j for j in range(len(monomers)) if d[i][j][-1] == v)
    i, v, out = n - 1, total, []
    while True:
        j = first(i, v)
        k, end, score = len(monomers[j]) - 1, i, v
        while True:
            here = d[i][j][k]
            if k and here == d[i][j][k - 1] + dele:
                k -= 1
            elif i and here == d[i - 1][j][k] + ins:
                i -= 1
            elif i and k and here == d[i - 1][j][k - 1] + mm(i, j, k):
                i, k = i - 1, k - 1
            else:
                break
        if i == 0:
            out.append((j, 0, end, score))
            return out[::-1]
        out.append((j, i, end, score - top[i]))
        v, i = top[i], i - 1


def matrix(q: str, t: str, free: bool, same=lambda a, b: a == b):
    d = [[0 if free else j for j in range(len(t) + 1)]]
    for i in range(1, len(q) + 1):
        row = [i]
        for j in range(1, len(t) + 1):
            row.append(min(d[i - 1][j] + 1, row[j - 1] + 1, d[i - 1][j - 1] + (not same(q[i - 1], t[j - 1]))))
        d.append(row)
    return d


def path(q: str, t: str) -> str:
    d, i, j, out = matrix(q, t, False), len(q), len(t), ""
    while i or j:
        if i and d[i][j] == d[i - 1][j] + 1:
            out, i = "I" + out, i - 1
        elif j and d[i][j] == d[i][j - 1] + 1:
            out, j = "D" + out, j - 1
        else:
            out, i, j = ("=" if q[i - 1] == t[j - 1] else "X") + out, i - 1, j - 1
    return out


def fold(blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The first block stays. Where it covers over half of one of the six after it, the blocks up to that
    one go and the next stays, unlooked at; the same holds for what follows."""
    if not blocks:
        return []
    (_, end), rest = blocks[0], blocks[1:]
    covered = [k for k, (a, b) in enumerate(rest[:6]) if 2 * (end - a) > b - a]
    tail = rest[covered[0] + 1 :] if covered else rest
    unseen = tail[: bool(covered)]
    return blocks[:1] + unseen + fold(tail[len(unseen) :])
