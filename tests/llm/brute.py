"""Plain Python answers for small tables, written from the operators' contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(spans):
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return hashlib.sha256(joined.encode()).hexdigest(), joined


def secrets(text):
    """Base spans of operator 6."""
    text = text or ""
    found = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def private(text):
    """Base spans of operator 3."""
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def words(text):
    return WORD.findall(text or "")


def base_quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of operator 7."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def line_quality(docs, least_docs, share, least_left):
    """docs: (doc_id, text, host). kept by doc_id, for lines that need no normalising beyond lower case, blanks and digits."""
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", x.strip(" ").lower()))
    held, hosts = defaultdict(set), defaultdict(set)
    lines = {}
    for i, text, host in docs:
        lines[i] = [x for x in (text or "").split("\n") if WORD.search(x)]
        hosts[host or ""].add(text or "")
        for x in lines[i]:
            held[host or "", norm(x)].add(text or "")
    kept = {}
    for i, text, host in docs:
        own = lines[i]
        limit = max(least_docs, share * len(hosts[host or ""]))
        left = sum(len(x) for x in own if len(held[host or "", norm(x)]) <= limit)
        n, _, _, _, repeats = base_quality(text)
        kept[i] = not (n < 10 or 100 * repeats > 20 * n) and (not own or left >= least_left * sum(map(len, own)) - 1e-9)
    return kept


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def near(docs):
    """docs: (doc_id, text). {doc_id: (n_shingles, component_id)} with links at 75 of 100."""
    sets = {i: shingles(t) for i, t in docs}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    shared = Counter()
    for ids in index.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[a], ids[b]] += 1
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(texts, least):
    """For each text: which bytes are covered by a string of ``least`` bytes that starts elsewhere too."""
    raw = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + least] for r in raw for i in range(len(r) - least + 1))
    masks = []
    for r in raw:
        mask = bytearray(len(r))
        for i in range(len(r) - least + 1):
            if n[r[i : i + least]] > 1:
                mask[i : i + least] = b"\1" * least
        masks.append(mask)
    return masks
