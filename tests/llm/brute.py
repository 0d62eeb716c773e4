"""Plain reference versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower_az(text))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text))


def shingle_set(text, n=4):
    w = space_words(text)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if len(w) >= n else {tuple(w)}


def jaccard_components(rows, n=4, percent=85):
    sets = {d: shingle_set(t, n) for d, t in rows}
    index = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    common = Counter()
    for own in index.values():
        own.sort()
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                common[a, b] += 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), k in common.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def contamination(rows, items, window=13, share=20):
    windows = {}
    for i, t in items:
        w = alnum_words(t)
        if len(w) < window:
            if w:
                windows.setdefault(tuple(w), set()).add(str(i))
        else:
            for a in range(len(w) - window + 1):
                windows.setdefault(tuple(w[a : a + window]), set()).add(str(i))
    sizes = sorted({len(x) for x in windows})
    out = {}
    for d, t in rows:
        w = alnum_words(t)
        hit, found = set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[a : a + k]))) is not None:
                    hit.update(range(a, a + k))
                    found |= own
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and share * len(hit) >= len(w))
    return out


def base_scores(rows):
    import math
    import zlib

    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    count = Counter()
    for d, t in rows:
        if not held[d]:
            count.update([*space_words(t), None])
    total, distinct = sum(count.values()), len(count)
    out = {}
    for d, t in rows:
        own = [*space_words(t), None]
        out[d] = (held[d], len(own), sum(count[w] > 0 for w in own), total, sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own))
    return out


def repeated_bytes(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            if w in seen:
                gone[a : a + length] = b"\x01" * length
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def pii_base(text):
    """Plain regex matches of the base kinds, checked afterwards."""
    text = text or ""

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]
