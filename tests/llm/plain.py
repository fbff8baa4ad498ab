"""The operators in plain Python, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")
NORMAL = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(text or "")


def measures(text):
    found, lines = words(text), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    repeated = set()
    for i in range(len(found) - 7):
        if windows[tuple(found[i : i + 8])] > 1:
            repeated.update(range(i, i + 8))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(repeated)


def contamination(text, items):
    found, hit, names = NORMAL.findall((text or "").translate(LOWER)), set(), set()
    for item, other in items:
        own = NORMAL.findall((other or "").translate(LOWER))
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(found) - size + 1):
            if tuple(found[i : i + size]) in windows:
                hit.update(range(i, i + size))
                names.add("" if item is None else str(item))
    return len(found), hit, sorted(names)


def shingles(text, size):
    found = words((text or "").translate(LOWER))
    if len(found) < size:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1))


def groups(rows, size):
    """doc_id -> smallest linked doc_id; `rows` are (doc_id, text), ids may repeat."""
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def cut_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = set()
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone.update(range(i, i + length))
        spans = sum(i in gone and i - 1 not in gone for i in range(len(b)))
        out.append((len(b), len(gone), spans, bytes(c for i, c in enumerate(b) if i not in gone)))
    return out


def cut_words(rows, window):
    first = defaultdict(lambda: float("inf"))
    order = [(float("inf") if i is None else i, words(t)) for i, t in rows]
    for i, found in order:
        for n in range(len(found) - window + 1):
            key = tuple(found[n : n + window])
            first[key] = min(first[key], i)
    out = []
    for i, found in order:
        gone = set()
        for n in range(len(found) - window + 1):
            if first[tuple(found[n : n + window])] < i:
                gone.update(range(n, n + window))
        out.append((len(found), len(gone), " ".join(w for n, w in enumerate(found) if n not in gone)))
    return out


def sha256(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def runs(found):
    """(start, length, period) of all runs of at least max(6, 4 periods) words."""
    n, out = len(found), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if found[i] != found[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and found[j] == found[j + q]:
                j += 1
            size = j + q - i
            if size >= max(6, 4 * q) and not any(
                all(found[k] == found[k + r] for k in range(i, j + q - r)) for r in range(1, q)
            ):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def cheapest_edits(codes):
    """(letters, cost) of the cheapest edits, the least letters of equal ones, state by state.

    Codes: 0 to 3 for a role that begins with s, u, a or another letter, plus 8 if the turn must go, plus 4
    if it is cut off.
    """
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    wanted = {0: 2, 1: 2, 2: 3, 3: 2}

    def with_inserts(best):
        for _ in range(3):
            for state, (cost, letters) in list(best.items()):
                new = (cost + 3, letters + "I")
                best[wanted[state]] = min(best.get(wanted[state], new), new)
        return best

    best = {0: (0, "")}
    for code in codes:
        ways = []
        for state, (cost, letters) in with_inserts(best).items():
            ways.append((state, (cost + 4, letters + "D")))
            if code < 8:
                more, initial = 3 * (code >= 4), "suax"[code % 4]
                ways.append((wanted[state], (cost + 3 + more, letters + "R")))
                if (state, initial) in after:
                    ways.append((after[state, initial], (cost + more, letters + "K")))
        best = {}
        for state, way in ways:
            best[state] = min(best.get(state, way), way)
    best = with_inserts(best)
    cost, letters = min(best[s] for s in (0, 3) if s in best)
    return letters, cost


def conversation(turns):
    """Facts, audit and the repaired text's hash of one conversation's (turn, role, text) in order."""
    codes, seen, counts = [], set(), Counter()
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else ""
        if not fault and body[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        counts[fault] += 1
        initial = "sua".find(role[0]) if role else -1
        codes.append((initial if initial >= 0 else 3) + {"blank": 8, "duplicate": 8, "truncated": 4, "": 0}[fault])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    known = {t for t, _, _ in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    letters, cost = cheapest_edits(codes)
    lines, rest, last = [], iter(turns), ""
    for letter in letters:
        role, text = next(rest)[1:] if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if last == "u" else "user"
        last = role[0]
        lines.append(f"{role}:{text}")
    facts = [counts[c] for c in ("blank", "duplicate", "truncated")]
    return gaps, *facts, illegal, cost, letters, sha256("\n".join(lines))


def cut_long_repeats(texts, length):
    """Bytes left when every word of a repeated string of `length` words goes, with what is between two."""
    places = [[m.span() for m in WORD.finditer(t or "")] for t in texts]
    strings = [[(t or "")[a:z] for a, z in p] for t, p in zip(texts, places)]
    counts = Counter(tuple(w[i : i + length]) for w in strings for i in range(len(w) - length + 1))
    out = []
    for text, spans, found in zip(texts, places, strings):
        gone = set()
        for i in range(len(found) - length + 1):
            if counts[tuple(found[i : i + length])] > 1:
                gone.update(range(i, i + length))
        chars = set()
        for i in gone:
            chars.update(range(spans[i][0], spans[i + 1][0] if i + 1 in gone else spans[i][1]))
        out.append("".join(c for i, c in enumerate(text or "") if i not in chars))
    return out
