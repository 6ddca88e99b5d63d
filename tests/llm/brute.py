"""Plain Python versions of the operators, for small tables."""

import collections
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(AZ))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def groups(docs, k, t):
    """doc_id -> (set size, smallest linked doc_id, links to other sets) for {doc_id: text}."""
    sets = {d: shingles(x, k) for d, x in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct, links = {}, collections.Counter()
    for d in sorted(sets):
        if sets[d]:
            first = distinct.setdefault(sets[d], d)
            root[find(d)] = find(first)
    reps = sorted(distinct.values())
    for i, a in enumerate(reps):
        for b in reps[:i]:
            inter = len(sets[a] & sets[b])
            if 100 * inter >= t * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
                links[sets[a]] += 1
                links[sets[b]] += 1
    return {d: (len(sets[d]), find(d), links[sets[d]]) for d in docs}


def dedup_lines(docs, size=3):
    """{doc_id: text} -> {doc_id: (text, number of lines gone)}; occurrences in order of doc_id."""
    seen, out = set(), {}
    for d in sorted(docs):
        if docs[d] is None:
            out[d] = (None, 0)
            continue
        lines = docs[d].split("\n")
        full = [(i, x.strip(" \t\v\f\r")) for i, x in enumerate(lines) if x.strip(" \t\v\f\r")]
        gone = set()
        for a in range(max(len(full) - size + 1, min(len(full), 1))):
            own = full[a : a + size]
            key = tuple(x for _, x in own)
            if key in seen:
                gone |= set(range(own[0][0], own[-1][0] + 1))
            seen.add(key)
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


GAP = re.compile(r"[\s!-/:-@\[-`{-~]+", re.A)


def grams(words, k):
    return collections.Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def leaks(docs, items, k=5, similar=80):
    """{(doc_id, item_id)} whose best window of the item's length is similar percent alike or more."""
    parts = lambda t: [w for w in GAP.split((t or "").lower()) if w]
    own = {i: parts(t) for i, t in items.items()}
    own = {i: (w, min(k, len(w))) for i, w in own.items() if w}
    sets = {i: grams(w, g) for i, (w, g) in own.items()}
    df = collections.Counter(g for s in sets.values() for g in s)
    weight = lambda g: round(100 * (1 + math.log(len(sets) / df.get(g, 1))))
    total = lambda s: sum(n * weight(g) for g, n in s.items())
    out = set()
    for d, text in docs.items():
        w = parts(text)
        for i, (item, g) in own.items():
            for a in range(max(1, len(w) - len(item) + 1)):
                x = grams(w[a : a + len(item)], g)
                inter = sum(min(n, sets[i][y]) * weight(y) for y, n in x.items())
                if inter and 100 * inter >= similar * (total(x) + total(sets[i]) - inter):
                    out.add((d, i))
                    break
    return out


LETTERS = re.compile(r"[^\W\d_]")


def statistics(text):
    """The numbers of quality.NAMES by plain Python."""
    raw = (text or "").encode()
    share = lambda chars: sum(raw.count(c) for c in chars.encode()) / max(1, len(raw))
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words, own = re.findall(rb"[^ \t\n\v\f\r]+", raw), re.findall(rb"[^ \t\n\v\f\r]+", low)
    lines = [x for x in low.split(b"\n") if x]
    some = max(1, len(words))
    log = math.log1p
    return {
        "bytes": log(len(raw)), "words": log(len(words)), "word_bytes": log(sum(map(len, words)) / some),
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": share("0123456789"), "marks": share(".,;:?'\"()-"), "symbols": share("#$%&*+/<=>@[\\]^_`{}~"),
        "high_bytes": sum(b > 127 for b in raw) / max(1, len(raw)), "blanks": share(" \t\r\n"), "lines": log(len(lines)), "line_bytes": log(len(raw) / max(1, len(lines))),
        "distinct": len(set(own)) / some, "repeats": sum(a == b for a, b in zip(own, own[1:])) / some, "top_line": 1 - len(set(lines)) / max(1, len(lines)),
        "ends_marked": sum(w[-1:] in b".,;:!?|" for w in words) / some, "single": sum(len(w) == 1 for w in words) / some, "long_words": sum(len(w) > 20 for w in words) / some,
        "bars": share("|"), "shouts": share("!"), "capitalised": sum(65 <= w[0] <= 90 for w in words) / some,
    }


def pooled(points):
    """Isotonic fit of (x, n, ones) by the minimax formula: (x, height) of each bin."""
    out = []
    for i in range(len(points)):
        share = lambda a, b: sum(p[2] for p in points[a : b + 1]) / sum(p[1] for p in points[a : b + 1])
        out.append((points[i][0], max(min(share(a, b) for b in range(i, len(points))) for a in range(i + 1))))
    return out


def letter_grams(text, n):
    """n-grams of a text's lower-case letters, other characters between them as one blank."""
    out, low = [], " ".join(re.findall(r"(?:[^\W\d_])+", text or ""))
    padded = f" {low} " if low else " "
    padded = "".join(c.lower()[0] for c in padded)
    for i in range(len(padded) - n + 1):
        if padded[i : i + n].strip():
            out.append(padded[i : i + n])
    return out


def languages(rows, labelled, n, share):
    """{id: (language, score)} by exact sets of the labelled texts' n-grams."""
    counts = collections.defaultdict(collections.Counter)
    for text, lang in labelled:
        counts[lang].update(letter_grams(text, n))
    held = {k: {g for g, m in c.items() if m >= max(2, share * sum(c.values()))} for k, c in counts.items()}
    out = {}
    for i, text in rows:
        hits = {k: sum(g in held[k] for g in letter_grams(text, n)) for k in sorted(held)}
        best = max(hits, key=hits.get, default="und")
        some = bool(LETTERS.search(text or ""))
        out[i] = (best if some else "und", hits[best] / sum(hits.values()) if some and sum(hits.values()) else 0.0)
    return out
