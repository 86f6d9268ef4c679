"""Plain single-process versions of the operators, for comparison on small tables."""

import hashlib
import math
import re
from collections import defaultdict


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def letters(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORDS.findall(low)


def contamination(docs, items, n=10):
    """doc_id -> n_words, n_hit, items."""
    windows = defaultdict(set)
    for item, text in items:
        words = letters(text)
        size = min(n, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[i:i + size])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        words, hit, held = letters(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if found := windows.get(tuple(words[i:i + size])):
                    hit.update(range(i, i + size))
                    held |= found
        out[doc] = (len(words), len(hit), sorted(map(str, held)))
    return out


def near_links(docs, n=5, threshold=0.8):
    """doc_id -> (class_id, copy_id, n_links) by comparing all pairs."""
    sets = {}
    for doc, text in docs:
        words = letters(text)
        sets[doc] = frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()
    holders = defaultdict(set)
    for doc, grams in sets.items():
        for g in grams:
            holders[g].add(doc)
    links = defaultdict(set)
    for doc, grams in sets.items():
        shared = defaultdict(int)
        for g in grams:
            for other in holders[g]:
                shared[other] += 1
        for other, common in shared.items():
            if other != doc and common >= threshold * (len(grams) + len(sets[other]) - common) - 1e-12:
                links[doc].add(other)
    group = {}
    for doc in sorted(sets):
        if doc not in group:
            todo = [doc]
            while todo:
                d = todo.pop()
                if d not in group:
                    group[d] = doc
                    todo.extend(links[d])
    same = {}
    for doc in sorted(sets):
        same.setdefault(sets[doc] or (doc,), doc)
    return {d: (group[d], same[sets[d] or (d,)], len(links[d])) for d in sets}


def repeated_windows(docs, size=20):
    """doc_id -> n_words, n_removed, sha of the kept words."""
    split = {doc: re.findall(r"[^\x20\x09-\x0D]+", text or "") for doc, text in docs}
    seen, out = set(), {}
    for doc in sorted(split):
        words, gone = split[doc], set()
        for i in range(len(words) - size + 1):
            window = tuple(words[i:i + size])
            if window in seen:
                gone.update(range(i, i + size))
            seen.add(window)
        out[doc] = (len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind, found):
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def personal_data(text):
    """Base spans as "kind:start:end", by kind, then start."""
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern in KINDS.items()
            for m in re.finditer(pattern, text or "") if _valid(kind, m[0])]


def spaced(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def surface(text):
    """The features of the quality scorer, one by one."""
    data = (text or "").encode()
    if not data:
        return [0.0] * 18
    sets = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"|<>{}[]=_\\/", b"#$%&*@^~+", b" \t", b".,;:'\"-()", b"\r\n"]
    share = [sum(b in s for b in data) / len(data) for s in sets]
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    lines = [x for x in re.split(rb"[\r\n]+", data) if x]
    n, size = max(len(words), 1), [len(w) for w in words]
    mean = sum(size) / n
    pure = sum(map(len, re.findall(rb"[0-9A-Za-z\x80-\xff]+", data)))
    return [math.log1p(len(data)), share[0], share[1], 1 - sum(share), *share[2:7],
            math.log1p(max(len(lines), 1)) / math.log1p(len(data)), mean,
            math.sqrt(max(sum(s * s for s in size) / n - mean ** 2, 0)), len(set(words)) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n, len(set(lines)) / max(len(lines), 1),
            pure / max(sum(size), 1), sum(65 <= w[0] <= 90 for w in words) / n, math.log1p(len(words))]


def continuations(grams, discount):
    """Kneser-Ney probability of the last byte of a four-byte sequence after the three before it, as a function of
    (context, byte), from the six-byte sequences seen."""
    four = defaultdict(int)
    for g in set(grams):
        four[g[2:]] += 1
    two = defaultdict(int)
    for f in four:
        two[f[2:]] += 1

    def p(level, lower, context, byte):
        after = {k: n for k, n in level.items() if k[:-1] == context}
        if not after:
            return lower(context[1:], byte)
        total = sum(after.values())
        return (max(after.get(context + byte, 0) - discount, 0) + discount * len(after) * lower(context[1:], byte)) / total

    def uniform(context, byte):
        return 1 / 256
    return lambda context, byte: p(four, lambda c, b: p(two, uniform, c[-1:], b), context, byte)
