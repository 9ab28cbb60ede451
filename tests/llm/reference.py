"""Plain Python forms of the operators, written from their definitions alone."""

import hashlib
import random
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def quality_base(text):
    words = WORD.findall(text or "")
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    often = {w for w, k in Counter(windows).items() if k > 1}
    covered = {i + j for i, w in enumerate(windows) if w in often for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": n, "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def exact_groups(rows):
    """{row index: (keep_id, group size)} of (doc_id, text) rows."""
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(SPACE.sub("", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = {}
    for members in groups.values():
        best = min(members)
        for m in members:
            out[m[3]] = (None if best[1] else best[2], len(members))
    return out


def shingles(text, k=5):
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def components(rows):
    """{doc_id: smallest doc_id reachable} by comparing all pairs of (doc_id, text)."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            common = len(s & t)
            if s and t and 100 * common >= 80 * (len(s) + len(t) - common):
                x, y = sorted((find(sets[a][0]), find(sets[b][0])))
                parent[y] = x
    return {i: find(i) for i, _ in rows}


ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)


def base_spans(text):
    """(start, kind number, end) of the fixed secret patterns."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def base_sha(text):
    return sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base_spans(text)))


def repeated_bytes(rows, width=50):
    """{doc_id: (bytes, removed, spans, sha of the rest)} of (doc_id, text) rows."""
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < i:
                gone[s : s + width] = b"\x01" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeated_windows(rows, width=20):
    """{row index: (words, removed, sha of the rest)} of (doc_id, text) rows."""
    first, split = {}, [WORD.findall(t or "") for _, t in rows]
    last = 1 << 63
    own = [last if i is None else i for i, _ in rows]
    for doc, words in zip(own, split, strict=True):
        for s in range(len(words) - width + 1):
            w = tuple(words[s : s + width])
            first[w] = min(first.get(w, (doc, s)), (doc, s))
    out = {}
    for row, (doc, words) in enumerate(zip(own, split, strict=True)):
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            if first[tuple(words[s : s + width])] < (doc, s):
                gone[s : s + width] = [True] * width
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[row] = (len(words), sum(gone), sha(kept))
    return out


def conversation_trie(rows):
    """Node rows by definition, of (conv_id, turn, role, text) rows."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    members = {}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - c % 20 if c >= 0 else c + -c % 20, [])
        full[c] = tuple(base[:h] + turns[h:])
        for d in range(len(full[c]) + 1):
            members.setdefault(full[c][:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        has_kid = {n[:-1] for n in below if n}
        ends = sorted(c for c in convs if len(full[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids),
            sum(n not in has_kid for n in below),
            sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in below if n),
            sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def prose(draw: random.Random, n: int) -> str:
    return " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(n))
