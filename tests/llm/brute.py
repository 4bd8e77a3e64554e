"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def exact(rows):
    """(doc_id, text) -> {(doc_id, text): (keep_id, group_size, kept, sha)}"""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[SPACE.sub("", text or "")].append((doc_id, text))
    out = {}
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0))[0]
        for m in members:
            out[m] = keep, len(members), m[0] == keep, sha(norm)
    return out


def simhash(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def classes(nodes, linked):
    """Smallest node of each node's component."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    order = sorted(nodes)
    for i, a in enumerate(order):
        for b in order[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def simhash_classes(rows):
    prints = {i: simhash(t) for i, t in rows}
    return prints, classes(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)


def repeats(texts, match=400):
    """Which bytes of each text a string of match bytes covers that also starts elsewhere."""
    seen = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - match + 1):
            seen[d[i : i + match]] += 1
    out = []
    for d in data:
        covered = bytearray(len(d))
        for i in range(len(d) - match + 1):
            if seen[d[i : i + match]] > 1:
                covered[i : i + match] = b"\1" * match
        out.append(covered)
    return data, out


def mix(rows, weights=(5, 2, 1), most=3):
    """(doc_id, source, text) -> source sizes, targets, and taken per row by sorting each source's documents."""
    size = [len(words(t)) for _, _, t in rows]
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[1] == s) for s in sources}
    weight = {s: weights[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(size))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        capped = {s for s in free if share[s] > most * total[s]}
        if not capped:
            target.update(share)
            break
        for s in capped:
            target[s] = float(most * total[s])
            left -= target[s]
        free -= capped
    taken = []
    for (doc_id, s, text), n in zip(rows, size):
        whole = int(target[s] // total[s]) if total[s] else 0
        place = lambda i, t: int(hashlib.md5(f"{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
        budget = target[s] - whole * total[s]
        up_to = sum(m for (i, s2, t), m in zip(rows, size) if s2 == s and place(i, t) <= place(doc_id, text))
        taken.append(n * (whole + (up_to <= budget)))
    return size, total, target, taken
