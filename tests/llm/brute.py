"""Plain versions of the operators, one document at a time."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    nodes = list(nodes)
    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if linked(a, b):
                parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def fingerprint(text):
    import xxhash

    words = BLANK_WORDS.findall(lower_ascii(text))
    if not words:
        return 0
    width = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + width]).encode(), 42) for k in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows):
    """(doc_id, fingerprint as hex, component_id) of (doc_id, text)."""
    prints = [fingerprint(text) for _, text in rows]
    root = roots(dict.fromkeys(prints), lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(list)
    for (doc_id, _), p in zip(rows, prints, strict=True):
        if doc_id is not None:
            least[root[p]].append(doc_id)
    return [(d, f"{p:016x}", min(least[root[p]], default=None)) for (d, _), p in zip(rows, prints, strict=True)]


def base_rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = BLANK_WORDS.findall(text)
    lines = [x for x in text.split("\n") if BLANK_WORDS.search(x)]
    windows = defaultdict(list)
    for k in range(len(words) - 2):
        windows[tuple(words[k : k + 3])].append(k)
    inside = {k + d for places in windows.values() if len(places) > 1 for k in places for d in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def quality_rules(rows, min_docs=20, share=0.1, min_words=50, min_left=0.3):
    """(doc_id, figures, base_failed, n_frequent_words, kept) of (doc_id, text, host)."""

    def normal(line):
        return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")

    hosts = defaultdict(set)
    for _, text, host in rows:
        hosts[host or ""].add(text)
    frequent = {}
    for host, texts in hosts.items():
        seen = Counter(x for t in texts for x in {normal(y) for y in (t or "").split("\n") if BLANK_WORDS.search(y)})
        frequent[host] = {x for x, n in seen.items() if n > min_docs and n > share * len(texts)}
    out = []
    for doc_id, text, host in rows:
        figures = base_rules(text)
        lines = [y for y in (text or "").split("\n") if normal(y) in frequent[host or ""]]
        gone = sum(len(BLANK_WORDS.findall(y)) for y in lines)
        failed = figures[0] < min_words or 100 * figures[4] > 50 * figures[0]
        left = figures[0] - gone
        out.append((doc_id, *figures, failed, gone, not failed and left >= min_words and left >= min_left * figures[0]))
    return out


def contaminated(rows, items, width=10):
    """(doc_id, n_words, n_hit, n_items, digest, contaminated) of (doc_id, text)."""
    windows = defaultdict(set)
    for name, text in items:
        words = tuple(ALNUM_WORDS.findall(lower_ascii(text)))
        size = min(width, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            windows[words[k : k + size]].add("" if name is None else str(name))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in rows:
        words = tuple(ALNUM_WORDS.findall(lower_ascii(text)))
        hit, names = set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if words[k : k + size] in windows:
                    hit |= set(range(k, k + size))
                    names |= windows[words[k : k + size]]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(names), digest, bool(hit)))
    return out


def base_score(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score) of (doc_id, text)."""

    def tokens(text):
        return [*BLANK_WORDS.findall(lower_ascii(text)), None]

    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows}
    counts = Counter(t for d, text in rows if not held[d] for t in tokens(text))
    total, kinds = sum(counts.values()), len(counts)
    out = {}
    for d, text in rows:
        own = tokens(text)  # a null id counts as the empty text
        score = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in own)
        out[d] = (held[d], len(own), sum(counts[t] > 0 for t in own), total, score)
    return out


def same(found, expected):
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, expected), key=repr)


def line_dedup(rows, min_tokens=5, min_chars=10, similar=0.8, min_left=0.3):
    """(doc_id, n_tokens, n_lines, n_dropped, dropped, kept) of (doc_id, text)."""
    import xxhash

    def hash_of(text):
        value = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
        return value - (1 << 64) if value >> 63 else value

    def names(line):
        """The line itself and its templates; none if it is not compared."""
        own = tuple(BLANK_WORDS.findall(line))
        mask = tuple("<*>" if re.search("[0-9]", t) else t for t in own)
        if len(own) < min_tokens or set(mask) == {"<*>"}:
            return {own} if len(" ".join(own)) >= min_chars else set()
        vary = int((1 - similar) * len(mask) + 1e-9)
        width = max(1, vary // 2)
        places = range(3, len(mask), width)
        out = {mask}
        for holes in itertools.combinations(places, min(vary, 2)) if vary else ():
            wild = {k for a in holes for k in range(a, a + width)}
            out.add((holes, tuple(None if k in wild else t for k, t in enumerate(mask))))
        return out

    texts = {}
    for doc_id, text in rows:
        order = (doc_id is None, doc_id or 0, hash_of(text))
        texts[text] = min(texts.get(text, order), order)
    lines = {text: [(k, x, names(x)) for k, x in enumerate((text or "").split("\n")) if BLANK_WORDS.search(x)] for text in texts}
    first = {}
    for text, own in lines.items():
        for _, _, found in own:
            for name in found:
                first[name] = min(first.get(name, texts[text]), texts[text])
    out = []
    for doc_id, text in rows:
        gone = [(pos, x) for pos, x, found in lines[text] if found and min(first[n] for n in found) < texts[text]]
        size = sum(len(BLANK_WORDS.findall(x)) for _, x, _ in lines[text])
        left = size - sum(len(BLANK_WORDS.findall(x)) for _, x in gone)
        out.append((doc_id, size, len(lines[text]), len(gone), [pos for pos, _ in gone], left >= min_left * size))
    return out


def shards(rows, max_bytes):
    """doc_id -> (shard, its bytes, its rows) of (doc_id, text) with different ids."""

    def bits(doc_id):
        digest = hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15]
        return f"{int(digest, 16):060b}"

    sizes = {d: len((t or "").encode()) for d, t in rows}
    out = {}

    def split(prefix, ids):
        total = sum(sizes[d] for d in ids)
        if total <= max_bytes or len(ids) == 1:
            out.update(dict.fromkeys(ids, (prefix, total, len(ids))))
            return
        for bit in "01":
            own = [d for d in ids if bits(d)[len(prefix)] == bit]
            if own:
                split(prefix + bit, own)

    split("", [d for d, _ in rows])
    return out


def jaccard(a, b, words=5):
    def shingles(text):
        split = BLANK_WORDS.findall(lower_ascii(text))
        return {tuple(split[k : k + words]) for k in range(max(1, len(split) - words + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)
