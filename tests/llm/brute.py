"""Plain versions of the operators, over lists."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text: str | None, width: int) -> set[tuple[str, ...]]:
    words = WORD.findall((text or "").translate(UPPER))
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def components(texts: dict[int, str | None], width: int, percent: int = 80) -> dict[int, int]:
    """Smallest id reachable over similar pairs, by an inverted index of all shingles."""
    sets = {i: shingle_set(t, width) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    held: dict[tuple[str, ...], list[int]] = {}
    for i in sorted(sets):
        seen: dict[int, int] = {}
        for s in sets[i]:
            for j in held.get(s, ()):
                seen[j] = seen.get(j, 0) + 1
            held.setdefault(s, []).append(i)
        for j, n in seen.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in texts}


def removed(texts: dict[int, str | None], width: int) -> dict[int, tuple[int, int, str]]:
    owner: dict[tuple[str, ...], int] = {}
    for i in sorted(texts):
        words = WORD.findall(texts[i] or "")
        for k in range(len(words) - width + 1):
            owner.setdefault(tuple(words[k : k + width]), i)
    out = {}
    for i, text in texts.items():
        words = WORD.findall(text or "")
        gone = set()
        for k in range(len(words) - width + 1):
            if owner[tuple(words[k : k + width])] < i:
                gone.update(range(k, k + width))
        out[i] = len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)
    return out


ASSIGN = re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def chain_probability(gram: bytes, counted: dict[bytes, int], shared: set[bytes], discount) -> float:
    """Interpolated Kneser-Ney probability of a six-byte gram's last byte, straight from the definition.

    ``counted``: six-byte grams of the class; ``shared``: those of all classes.
    """
    p = 1 / 256
    for order in range(1, 7):
        if order == 6:
            table = dict(counted)
        else:
            table = {}
            longer = {g[5 - order :] for g in (shared if order < 3 else counted)}
            for g in longer:
                table[g[1:]] = table.get(g[1:], 0) + 1
        d = discount(order, table)
        context = gram[6 - order : 5]
        following = {g: n for g, n in table.items() if g[:-1] == context}
        total = sum(following.values())
        if total:
            n = following.get(gram[6 - order :], 0)
            spare = sum(d[min(v, 3)] for v in following.values())
            p = (max(n - d[min(n, 3)], 0) + spare * p) / total
    return p
