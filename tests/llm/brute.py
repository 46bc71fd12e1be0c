"""Plain versions of the operators' results, on lists of rows."""

from __future__ import annotations

import collections
import hashlib
import re

BIG = 2**63
LOWER = {i: i + 32 for i in range(65, 91)}
WORDS = re.compile("[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORDS.findall(text or "")


def contamination(docs, items, window=13):
    known = {}
    for item, text in items:
        ws = ITEM_WORDS.findall((text or "").translate(LOWER))
        for k in range(max(1, len(ws) - window + 1)) if ws else ():
            known.setdefault(tuple(ws[k : k + window]), set()).add("" if item is None else str(item))
    lengths = {len(x) for x in known}
    out = []
    for doc, text in docs:
        ws, hit, found = ITEM_WORDS.findall((text or "").translate(LOWER)), set(), set()
        for k in range(len(ws)):
            for n in lengths:
                if k + n <= len(ws) and (own := known.get(tuple(ws[k : k + n]))):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((doc, len(ws), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def shingles(text, width):
    ws = words((text or "").translate(LOWER))
    return frozenset(tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))) if ws else frozenset()


def near_duplicates(docs, width, percent=80):
    """Rows of one doc_id are one document; rows without an id are linked with nothing."""
    sets = [(d, shingles(t, width)) for d, t in docs]
    up = {d: d for d, _ in docs if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    named = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, s) in enumerate(named):
        for b, z in named[:i]:
            both = len(s & z)
            if 100 * both >= percent * (len(s) + len(z) - both) and top(a) != top(b):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return [(d, len(s), None if d is None else top(d), d is None or top(d) == d) for d, s in sets]


def repeats(docs, length=50):
    first, out = {}, []
    for doc, text in docs:
        ws, doc = words(text), BIG if doc is None else doc
        for i in range(len(ws) - length + 1):
            key = tuple(ws[i : i + length])
            first[key] = min(first.get(key, doc), doc)
    for doc, text in docs:
        ws, gone = words(text), set()
        for i in range(len(ws) - length + 1):
            if first[tuple(ws[i : i + length])] < (BIG if doc is None else doc):
                gone.update(range(i, i + length))
        out.append((doc, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def quality_counts(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        ws = words(text)
        seen = collections.Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
        again = {j for i in range(len(ws) - 2) if seen[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if words(x)]
        out.append(
            (doc, len(ws), sum(map(len, ws)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again),
             len(ws) < 50 or 100 * len(again) > 50 * len(ws))
        )
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in out)


def archived(pages, least=1000):
    payloads = [(p, (h or "").encode()) for p, _, h in pages]
    groups = collections.defaultdict(list)
    for page, data in payloads:
        if len(data) >= least and page is not None:
            groups[data].append(page)
    out = []
    for page, data in payloads:
        top = max(groups.get(data, [None])) if data in groups else None
        again = len(data) >= least and top is not None and page != top
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    return out
