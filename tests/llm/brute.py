"""Plain Python versions of the contracts, written from their wording and as slowly as it takes."""

import hashlib
import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def secrets(text):
    text = text or ""
    letters = {k: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key")}
    kinds = [
        ("assign", r"""(%s)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % "|".join(letters.values()), 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ]
    return [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern, group, least) in enumerate(kinds)
        for m in re.finditer(pattern, text)
        if len(m[group]) >= least
    ]


def _luhn(digits):
    values = [int(d) for d in digits]
    for i in range(len(values) - 2, -1, -2):
        values[i] = values[i] * 2 if values[i] < 5 else values[i] * 2 - 9
    return sum(values) % 10 == 0


def personal(text):
    text = text or ""

    def digits(m):
        return [c for c in m[0] if c in "0123456789"]

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern, good) in enumerate(kinds)
        for m in re.finditer(pattern, text)
        if good(m)
    ]


def text_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": sum(line in lines[:i] for i, line in enumerate(lines)),
        "n_repeat_words": len(repeated),
        "base_failed": len(words) < 50 or 100 * len(repeated) > 50 * len(words),
    }


def normal_line(line):
    return " ".join(WORD.findall(line.lower()))


def frequent_lines(rows, max_percent, min_documents):
    """Lines (host, line) over both limits; near copies (fingerprints joined over links) are one document."""
    prints = {text: fingerprint(text) for _, text in rows}
    values = sorted(set(prints.values()))
    ids = dict(component_ids_of(values))
    documents, holders = defaultdict(set), defaultdict(set)
    for host, text in rows:
        document = ids[prints[text]]
        documents[host].add(document)
        for line in (text or "").split("\n"):
            if normal_line(line):
                holders[host, normal_line(line)].add(document)
    return {k for k, held in holders.items() if len(held) > min_documents and 100 * len(held) > max_percent * len(documents[k[0]])}


def component_ids_of(values):
    """(value, smallest value of its component) of different fingerprints."""
    return zip(values, component_ids([(v, v) for v in values]))


def benchmark_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def overlaps(texts, items):
    """texts: list; items: (id, text). Per text: n_words, n_hit, item ids as sorted text, hit places."""
    windows = defaultdict(set)
    for name, text in items:
        words = benchmark_words(text)
        for i in range(max(1, len(words) - 12) if words else 0):
            windows[tuple(words[i : i + 13])].add(str(name))
    lengths = {len(w) for w in windows}
    out = []
    for text in texts:
        words, hit, names = benchmark_words(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                found = windows.get(tuple(words[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    names |= found
        out.append((len(words), len(hit), sorted(names), hit))
    return out


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def component_ids(rows):
    """rows: (id, fingerprint). The smallest id reachable over links of 3 bits or fewer, row by row."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    prints = sorted({f for _, f in rows})
    for i, a in enumerate(prints):
        find(a)
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for name, f in rows:
        least[find(f)].append(name)
    return [min((n for n in least[find(f)] if n is not None), default=None) for _, f in rows]


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def targets(sizes):
    """sizes: source -> words. Share 150 % by weights 5, 2, 1; stop at twice; share the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        rest = total - sum(stopped.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            return {**stopped, **share}
        stopped.update({s: 2.0 * sizes[s] for s in above})
