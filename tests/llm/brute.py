"""Plain Python twins of the operators' contracts, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def remainder(key: object, of: int) -> int:
    return zlib.crc32(str(key).encode()) % of


def decontaminate(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    wins = set()
    for item, text in items:
        words = ALNUM_WORD.findall((text or "").translate(UPPER))
        if words and item is not None:
            size = min(10, len(words))
            wins |= {(item, tuple(words[i : i + size])) for i in range(len(words) - size + 1)}
    by = defaultdict(set)
    for item, w in wins:
        by[w].add(item)
    sizes = {len(w) for w in by}
    out = []
    for key, text in docs:
        words = ALNUM_WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in by:
                    hit.update(range(i, i + n))
                    found |= by[w]
        out.append((key, len(words), len(hit), len(found), sha256(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def substrings(docs: list[tuple], window: int = 13) -> list[tuple]:
    least: dict[tuple, int] = {}
    split = [(k, SPACE_WORD.findall(t or "")) for k, t in docs]
    for k, words in split:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if k is not None:
                least[w] = min(k, least.get(w, k))
    out = []
    for k, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in least and (k is None or least[w] < k):
                gone.update(range(i, i + window))
        out.append((k, len(words), len(gone), sha256(" ".join(x for i, x in enumerate(words) if i not in gone))))
    return out


def base_scores(docs: list[tuple]) -> list[tuple]:
    tokens = [(k, [*SPACE_WORD.findall((t or "").translate(UPPER)), None]) for k, t in docs]
    held = lambda k: k is not None and remainder(k, 10) == 0
    counts = Counter(x for k, ts in tokens if not held(k) for x in ts)
    n, v = sum(counts.values()), len(counts)
    return [(k, held(k), len(ts), sum(counts[x] > 0 for x in ts), n, sum(log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts)) for k, ts in tokens]


def ppm_scores(docs: list[tuple], order: int = 5) -> list[float]:
    """Prediction by partial matching, method C with symbol exclusion, as one byte trie."""
    held = lambda k: k is not None and remainder(k, 10) == 0
    follow: dict[bytes, Counter] = defaultdict(Counter)
    for k, t in docs:
        if not held(k):
            data = b"\xff" * order + (t or "").encode() + b"\xff"
            for i in range(order, len(data)):
                for size in range(order + 1):
                    follow[data[i - size : i]][data[i]] += 1
    scores = []
    for _, t in docs:
        data, total = b"\xff" * order + (t or "").encode() + b"\xff", 0.0
        for i in range(order, len(data)):
            p, gone = 1.0, set()
            for size in range(order, -1, -1):
                seen = {b: c for b, c in follow.get(data[i - size : i], {}).items() if b not in gone}
                if not seen and not follow.get(data[i - size : i]):
                    continue
                kinds = len(seen) if len(seen) + len(gone) < 256 else 0
                whole = sum(seen.values()) + kinds
                if data[i] in seen:
                    p *= seen[data[i]] / whole
                    break
                if whole:
                    p *= kinds / whole
                gone |= seen.keys()
            else:
                p /= max(1, 256 - len(gone))
            total += log10(p)
        scores.append(total)
    return scores


def warc(pages: list[tuple]) -> list[tuple]:
    payload = [(k, (h or "").encode()) for k, h in pages]
    last: dict[bytes, int] = {}
    for k, p in payload:
        last[p] = max(k, last.get(p, k))
    digest = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    return [(k, len(p), digest(p), "response" if last[p] == k else "revisit", None if last[p] == k else last[p]) for k, p in payload]


def quality(docs: list[tuple]) -> list[tuple]:
    out = []
    for k, t in docs:
        t = t or ""
        words = SPACE_WORD.findall(t)
        lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
        tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeat = {j for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
        out.append((k, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat), failed))
    return out


def shingles(text: str | None, k: int) -> frozenset:
    words = SPACE_WORD.findall((text or "").translate(UPPER))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def jaccard(docs: list[tuple], k: int, percent: int) -> list[tuple]:
    sets = [shingles(t, k) for _, t in docs]
    up = list(range(len(docs)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    usable = sorted((i for i in range(len(docs)) if docs[i][0] is not None and sets[i]), key=lambda i: len(sets[i]))
    for a, i in enumerate(usable):
        for j in usable[a + 1 :]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least: dict[int, int] = {}
    for i in usable:
        least[top(i)] = min(docs[i][0], least.get(top(i), docs[i][0]))
    return [(key, len(s), least[top(i)] if key is not None and s else key) for i, ((key, _), s) in enumerate(zip(docs, sets, strict=True))]


def targets(sizes: dict, weights: tuple = (1, 2, 3), most: int = 3) -> dict:
    """Targets by source: shares by weight of all sizes, each at most ``most`` times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: dict = {}
    total = sum(sizes.values())
    while True:
        left = [s for s in names if s not in full]
        share = (total - sum(full.values())) / sum(weight[s] for s in left) if left else 0
        over = [s for s in left if share * weight[s] > most * sizes[s]]
        if not over:
            return full | {s: share * weight[s] for s in left}
        full |= {s: most * sizes[s] for s in over}


def simhash(docs: list[tuple], shingle: int = 3, bits: int = 2) -> list[tuple]:
    import xxhash

    prints = []
    for _, text in docs:
        words = SPACE_WORD.findall((text or "").translate(UPPER))
        shingles = [words[i : i + shingle] for i in range(len(words) - shingle + 1)] or ([words] if words else [])
        hashed = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed)))
    component = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            for j in range(len(docs)):
                if (prints[i] ^ prints[j]).bit_count() <= bits and component[j] < component[i]:
                    component[i], changed = component[j], True
    least: dict[int, int] = {}
    for (k, _), c in zip(docs, component, strict=True):
        if k is not None:
            least[c] = min(k, least.get(c, k))
    return [(k, f"{p:016x}", least.get(c)) for (k, _), p, c in zip(docs, prints, component, strict=True)]


def repaired(rows: list[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation's (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cache: dict[tuple, tuple] = {}

    def best(i: int, made: str, free: int) -> tuple:
        """(cost, audit, turns) of the rest, after the initial ``made``; ``free``: inserts still allowed here."""
        if (i, made, free) in cache:
            return cache[i, made, free]
        ways = []
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[made]
        if i == len(rows) and made in ("", "a"):
            ways.append((0, "", ()))
        for x in "ua":
            if x in allowed and free:
                c, a, t = best(i, x, free - 1)
                ways.append((c + 2, "I" + a, (({"u": "user", "a": "assistant"}[x] + ":"), *t)))
        if i < len(rows):
            c, a, t = best(i + 1, made, 3)
            ways.append((c + 3, "D" + a, t))
            if faults[i] in ("", "truncated"):
                more = faults[i] == "truncated"
                if initials[i] and initials[i] in allowed:
                    c, a, t = best(i + 1, initials[i], 3)
                    ways.append((c + more, "K" + a, (f"{rows[i][1]}:{rows[i][2]}", *t)))
                for x in "ua":
                    if x in allowed:
                        c, a, t = best(i + 1, x, 3)
                        ways.append((c + 2 + more, "R" + a, (f"{ {'u': 'user', 'a': 'assistant'}[x] }:{rows[i][2]}", *t)))
        cache[i, made, free] = min(ways, default=(1 << 40, "", ()))
        return cache[i, made, free]

    for i in range(len(rows), 0, -1):  # from the end, so that the recursion stays shallow
        for made in ("", "s", "u", "a"):
            best(i, made, 3)
    cost, audit, made = best(0, "", 3)
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha256("\n".join(made))


def damaged(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = remainder(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}", 20)
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def repairs(rows: list[tuple], ids: list) -> list[tuple]:
    by = defaultdict(list)
    for conv, *rest in rows:
        by[conv].append(tuple(rest))
    return [(conv, *(repaired(by[conv]) if conv in by else (0, 0, 0, 0, 0, 0, "", sha256("")))) for conv in set(ids)]


def runs(words: list[str], shortest: int = 6, times: int = 4) -> list[tuple]:
    """(start, length, period) of each run, by looking at every period."""
    out, taken = [], set()
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if length >= max(shortest, times * q) and (s, length) not in taken:
                taken.add((s, length))  # a smaller period has the same stretch
                out.append((s, length, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def with_periods(key: object, words: list[str]) -> list[str]:
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if key is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def periodic(docs: list[tuple]) -> list[tuple]:
    from fractions import Fraction

    out = []
    for key, text in docs:
        words = with_periods(key, SPACE_WORD.findall(text or ""))
        found = runs(words)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        columns = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((key, len(found), *columns, sha256("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha256(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out
