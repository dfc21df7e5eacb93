"""Plain Python restatements of the operators' contracts, for tests on small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).hexdigest()


def rules(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "base_failed": len(words) < 50 or 100 * len(hit) > 50 * len(words),
    }


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else 2 * d - (9 if d > 4 else 0)
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    any_case = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = re.compile("(" + any_case + """)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def decontaminate(text: str | None, items: list[tuple[int, str | None]]) -> tuple[int, int, list[int]]:
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    word = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    words = word.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        own = word.findall(lower(t))
        n = min(10, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(words), len(hit), sorted(map(str, found))


def shingles(text: str | None, width: int = 5) -> set:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def near(docs: list[tuple[int, str | None]]) -> list[tuple[int, int, int, bool]]:
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(docs)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[root(a)] = root(b)
    first: dict[int, int] = {}
    for k, (i, _) in enumerate(sets):
        r = root(k)
        first[r] = min(first.get(r, i), i)
    return [(i, len(s), first[root(k)], i == first[root(k)]) for k, (i, s) in enumerate(sets)]


def repeats(docs: list[tuple[int, str | None]], width: int = 100) -> list[tuple[int, int, int, int, str]]:
    seen: set[bytes] = set()
    out = []
    for i, text in sorted(docs, key=lambda x: x[0]):
        raw = (text or "").encode("utf-8", "surrogatepass")
        gone = bytearray(len(raw))
        for k in range(len(raw) - width + 1):
            w = raw[k : k + width]
            if w in seen:
                gone[k : k + width] = b"\x01" * width
            else:
                seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, sha(kept)))
    return out
