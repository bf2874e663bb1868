"""Plain versions of the operators over lists of rows, for comparison."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str | None) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int], radius: int = 2) -> list[int]:
    """For each place the least place that a chain of links reaches."""
    parent = list(range(len(prints)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def near_roots(texts: list[str | None], shingle: int = 5) -> list[int]:
    """For each place the least place that a chain of links reaches: four fifths of all shingles in common."""
    sets = []
    for text in texts:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def contamination(text: str | None, items: list[tuple[str, str | None]], window: int = 10) -> tuple[int, int, list[str]]:
    """Words, hit words and sorted ids of the items found."""
    words = ITEM_WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        w = ITEM_WORD.findall((body or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            for at in range(len(words) - len(part) + 1):
                if words[at : at + len(part)] == part:
                    hit.update(range(at, at + len(part)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def measures(text: str | None) -> dict[str, int]:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_letters": len(re.findall(r"[A-Za-z]|[^\x00-\x7F]", text)), "n_capitals": len(re.findall("[A-Z]", text)),
        "n_stutter": sum(a == b for a, b in zip(words, words[1:], strict=False)),
    }


def kept(text: str | None) -> bool:
    m = measures(text)
    return not (
        m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"] or 10 * m["n_symbols"] > m["n_words"]
        or 2 * m["n_dup_lines"] > m["n_lines"] or 2 * m["n_capitals"] > m["n_letters"] or 2 * m["word_chars"] < 5 * m["n_words"]
        or m["word_chars"] > 12 * m["n_words"] or 5 * m["n_stutter"] > m["n_words"] or 2 * m["n_letters"] < m["word_chars"]
    )


def targets(sizes: dict[str | None, int], cycle=(1, 2, 3), most: int = 3) -> dict[str | None, float]:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        free = [s for s in names if s not in full]
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return share | {s: float(most * sizes[s]) for s in full}
        full |= over


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def copies(rows: list[tuple[int, str | None, str | None]], seed: int = 20) -> list[int]:
    """Copies that the mix takes of each (doc_id, text, source)."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    by_source: dict = {}
    for i, (_, _, s) in enumerate(rows):
        by_source.setdefault(s, []).append(i)
    total = {s: sum(size[i] for i in x) for s, x in by_source.items()}
    target, out = targets(total), [0] * len(rows)
    for s, members in by_source.items():
        ratio = target[s] / total[s] if total[s] else 0.0
        whole, part = int(ratio), ratio - int(ratio)
        prefer = {i: 1000 * size[i] // (size[i] + 200) for i in members}
        mean = sum(size[i] * prefer[i] for i in members) / total[s] / 1000 if total[s] else 0.0
        order = []
        for i in members:
            out[i] = whole
            if part <= 0:
                continue
            p = min(1.0, max(0.0, part * (1 + min(1.0, (1 - part) / part) * (prefer[i] / 1000 - mean))))
            doc, text = rows[i][:2]
            ident = -(1 << 63) if doc is None else doc
            check = 0 if text is None else _signed(xxhash.xxh64_intdigest(text.encode(), 42))
            h = 42
            for data in (seed.to_bytes(4, "little"), ident.to_bytes(8, "little", signed=True), check.to_bytes(8, "little", signed=True)):
                h = xxhash.xxh64_intdigest(data, h)
            u = ((h & ((1 << 52) - 1)) + 0.5) / (1 << 52)
            if p > 0:
                order.append(((u / (1 - u)) * (1 - p) / p, ident, check, i))
        order.sort()
        need, taken, k = target[s] - whole * total[s], 0, 0
        while k < len(order) and taken + size[order[k][3]] <= need:
            taken += size[order[k][3]]
            out[order[k][3]] += 1
            k += 1
        rest = [(abs(need - taken - size[x[3]]), x) for x in order[k:]]
        if rest and min(rest)[0] < need - taken:
            out[min(rest)[1][3]] += 1
    return out
