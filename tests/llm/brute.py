"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def substring_dedup(rows):
    """rows: (doc_id, text). For each row (n_words, n_removed, sha256 of the kept words)."""
    out, first = [], {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 49) if i is not None else ():
            x = tuple(w[p : p + 50])
            first[x] = min(i, first.get(x, i))
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        kept = " ".join(v for k, v in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingle_set(t):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), (min(ids) if ids else None) if sets[k] else i))
    return out


def quality(t):
    w = words(t)
    n_dup, seen = 0, set()
    for line in (t or "").split("\n"):
        if words(line):
            n_dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {i + k for v in where.values() if len(v) > 1 for i in v for k in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in t or "")
    if not w:
        symbols = 0
    return len(w), sum(map(len, w)), symbols, n_dup, len(again)
