"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def simhash(text: str | None) -> int:
    words = SPACE_WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items: list, linked) -> dict:
    """The representative of each item's component; ``items`` are tried in all pairs."""
    parent = list(range(len(items)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in range(len(items))}


def removed(texts: list[tuple], length: int) -> list[tuple]:
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(b[s : s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = set()
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone.update(range(s, s + length))
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        spans = sum(1 for k in gone if k - 1 not in gone)
        out.append((i, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PII = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 13 <= len(_digits(s)) <= 19 and luhn(_digits(s))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(_digits(s)) <= 15),
}


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    return [
        (kind, m.start(), m.end()) for kind, (p, ok) in PII.items() for m in p.finditer(text or "") if ok(m.group())
    ]


def item_words(text: str | None) -> list[str]:
    return ITEM_WORD.findall((text or "").translate(LOWER))


def contamination(documents: list[tuple], items: list[tuple]) -> list[tuple]:
    grams = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[k : k + n])].add("" if i is None else str(i))
    lengths = set(map(len, grams))
    out = []
    for i, t in documents:
        w, hit, found = item_words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (owners := grams.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def quality_counts(text: str | None) -> tuple:
    text = text or ""
    words = SPACE_WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def _rounded(v: int) -> int:
    return v - v % (1 << max(0, v.bit_length() - 6))


def quality_kept(rows: list[tuple], rules) -> list[bool]:
    """Verdicts for ``(text, lang, source)`` rows by sorting all values of each group."""

    def measures(text: str | None) -> dict:
        words, chars, symbols, dup, covered, _ = quality_counts(text)
        lines = sum(bool(SPACE_WORD.search(x)) for x in (text or "").split("\n"))
        upper = sum("A" <= c <= "Z" for c in text or "")
        per = lambda a, b, k: k * a // b if b else 0
        return {
            "symbols": per(symbols, chars, 1000), "capitals": per(upper, chars, 1000), "dup_lines": per(dup, lines, 1000),
            "repeats": per(covered, words, 1000), "word_length": per(chars, words, 10),
        }

    found = [(quality_counts(t)[-1], measures(t), lang, src) for t, lang, src in rows]
    groups = defaultdict(list)
    for failed, m, lang, src in found:
        if not failed:
            for key in (("o", lang, src), ("l", lang), ("e",)):
                groups[key].append(m)
    verdicts = []
    for failed, m, lang, src in found:
        keys = [("o", lang, src), ("l", lang), ("e",)]
        if failed:
            verdicts.append(False)
            continue
        key = next((k for k in keys[:2] if len(groups[k]) >= rules.least_rows), keys[2])
        ok = True
        for name, spread, margin in rules.measures:
            values = sorted(_rounded(g[name]) for g in groups[key])
            at = lambda q: values[-(-q * len(values) // 100) - 1]  # noqa: E731, B023
            reach = rules.reach * max(at(75) - at(25), spread)
            ok &= m[name] <= min(at(75) + reach, at(99) + max(at(99) // 4, margin))
            ok &= name != "word_length" or m[name] >= max(at(25) - reach, at(1) - max(at(1) // 4, margin))
        verdicts.append(ok)
    return verdicts
