"""Plain Python versions of what the queries return, over a list of (doc_id, text)."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import xxhash

SPACED = re.compile("[^\x20\x09-\x0d]+")
LETTERED = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return SPACED.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def op1(docs, width=20):
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            window = tuple(w[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        out[doc_id] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def op2(docs):
    """doc_id -> (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    out = {}
    for doc_id, text in docs:
        text = text or ""
        w = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many, hit = Counter(windows), set()
        for i, window in enumerate(windows):
            if many[window] > 1:
                hit.update(range(i, i + 5))
        n, r = len(w), len(hit)
        out[doc_id] = (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n)
    return out


def op5(docs):
    """doc_id -> (n_words, n_base, first_word, last_word, base_labels)."""
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    out = {}
    for doc_id, text in docs:
        w = LETTERED.findall(lower(text))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w) - len(p) + 1) if tuple(w[i : i + len(p)]) == p]
        out[doc_id] = (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))
    return out


def op6(docs):
    """doc_id -> (n_chars, edited text)."""
    rows = sorted((d, t or "") for d, t in docs)
    out = {}
    for k, (doc_id, text) in enumerate(rows):
        n = len(text) // 4
        after = rows[(k + 1) % len(rows)][1]
        out[doc_id] = (len(text), text[: len(text) - n] + after[:n])
    return out


def fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints):
    """doc_id -> smallest doc_id reachable, over fingerprints at 4 differing bits or fewer."""
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    listed = sorted(prints.items())
    for k, (a, x) in enumerate(listed):
        for b, y in listed[k + 1 :]:
            if (x ^ y).bit_count() <= 4:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d in prints}


def _luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def spans(text):
    """(start, number of the kind, kind, end) of base spans by start."""
    text = text or ""
    only = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(only(s)) <= 19 and _luhn(only(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(only(s)) <= 15),
    ]
    return sorted((m.start(), k, kind, m.end()) for k, (kind, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, text) if good(m[0]))


def op8(docs):
    """doc_id -> (n_email, n_ip, n_card, n_phone, base_sha256)."""
    out = {}
    for doc_id, text in docs:
        found = spans(text)
        counts = [sum(k == n for _, k, _, _ in found) for n in range(4)]
        out[doc_id] = (*counts, sha(",".join(f"{kind}:{a}:{z}" for a, _, kind, z in found)))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def murmur(words, seed=42):
    """Spark's hash of several strings: Murmur3 of each, seeded with the one before."""
    mask, h = 0xFFFFFFFF, seed
    turn = lambda x, r: (x << r | x >> (32 - r)) & mask
    for word in words:
        data = word.encode()
        whole = len(data) // 4 * 4
        blocks = [int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)] + [b - 256 if b > 127 else b for b in data[whole:]]
        for k in blocks:
            k = turn((k & mask) * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
            h = (turn(h ^ k, 13) * 5 + 0xE6546B64) & mask
        h ^= len(data)
        h = (h ^ h >> 16) * 0x85EBCA6B & mask
        h = (h ^ h >> 13) * 0xC2B2AE35 & mask
        h ^= h >> 16
    return h


def signatures(text, anchors, chain=2, reach=8):
    """The set of signatures of a text, as unsigned numbers."""
    w = LETTERED.findall((text or "").lower())
    n, stop = len(w), set(anchors)
    places, out = [i for i, x in enumerate(w) if x in stop], set()
    triples = lambda a, z: {murmur(w[i : i + 3]) for i in range(a, z - 2)}
    for i in places:
        content = [x for x in w[i + 1 : i + 1 + reach] if x not in stop][:chain]
        if len(content) == chain:
            out.add(murmur([w[i], *content]))
        elif i + 3 <= n:
            out.add(murmur(w[i : i + 3]))
    for begin, end in zip([0, *(i + reach + 1 for i in places)], [*places, n]):
        out |= triples(begin, end)
    if not out:
        out = triples(0, n) if n >= 3 else {murmur(w)} if n else set()
    return out


def secret_features(value, before, after, path, keywords, dictionary):
    """The numbers by which a candidate is judged."""
    n = max(len(value), 1)
    gone = lambda pattern, text: (len(text) - len(re.sub(pattern, "", text))) / n
    shape = re.sub("[0-9]+", "0", re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", value)))
    harmless = r"(?i)(?:sha-?\d*|md5|checksum|digest|commit|revision|uuid|guid|etag|example|placeholder|sample|isbn|version|integrity)"
    digits = gone("[0-9]", value)
    flags = [
        re.search("^[0-9a-f]+$", value) or re.search("^[0-9A-F]+$", value),
        re.search("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", value),
        re.search(r"^[A-Za-z0-9._-]*/[A-Za-z0-9._/-]*[a-z]{3,}", value) and digits < 0.2,
        re.search(rf"(?i)(?:{keywords}|bearer|authorization)", before),
        re.search(harmless, before) or re.search(harmless, after),
        re.search(r"(?i)(?:test|spec|fixture|mock|example|sample|docs?)", path),
        re.search(rf"(?i)(?:{keywords})[\"']?[ \t]{{0,3}}[:=]+>?[ \t]{{0,3}}[\"']?$", before),
    ]
    code = re.search(r"[(){}\[\]$%]|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$", value)
    return [len(value), (len(shape) - 1) / n, gone("|".join(dictionary), value.lower()), digits, gone("[A-Z]", value), len(set(value)) / n, *(float(bool(f)) for f in flags), gone("[^A-Za-z0-9_/+=-]", value), float(bool(code))]


def candidates(text, candidate, assigned, near=48):
    """(start, end, value, before, after) of the places that look like a secret."""
    found, last, name = [], 0, ""
    matches = list(re.finditer(candidate, text))
    for k, m in enumerate(matches):
        inner = re.fullmatch(assigned, m[0])
        value = inner[1] if inner else m[0]
        gap = text[last : m.start()]
        lead = name if k and gap == "=" else ""
        after = text[m.end() : matches[k + 1].start() if k + 1 < len(matches) else len(text)][:near]
        found.append((m.end() - len(value), m.end(), value, lead + gap[-near:] + m[0][: len(m[0]) - len(value)], after))
        last, name = m.end(), m[0]
    return found


def gam_features(text):
    """The twelve statistics of a text that the quality model reads, by name."""
    w, lines, n = words(text), [x for x in (text or "").split("\n") if x], len((text or "").encode())
    data = (text or "").encode()
    body = sum(len(x.encode()) for x in w)
    held = lambda chars: sum(b in chars for b in data)
    share = lambda a, b: a / max(b, 1)
    again = lambda xs: len(xs) - len(set(xs))
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in data)
    values = [
        math.log1p(len(w)), share(body, len(w)), share(held(b"#*$%&<>~^=_\\@{}[]"), body), share(sum(65 <= b <= 90 for b in data), letters), share(held(b"0123456789"), body),
        share(held(b".,;:'\"()-"), len(w)), share(len(set(w)), len(w)), share(again([tuple(w[i : i + 3]) for i in range(len(w) - 2)]), len(w)), share(again(lines), len(lines)),
        share(sum(len(x.encode()) > 14 for x in w), len(w)), share(held(b"|"), len(w)), share(held(b"!?"), len(w)),
    ]
    return values if n else [0.0] * 12


def gam_score(x, model):
    """One lookup after another."""
    at = lambda cuts, v: sum(c <= v for c in cuts)
    total = model.intercept + sum(t[at(c, v)] for c, t, v in zip(model.cuts, model.tables, x))
    total += sum(t[at(model.pair_cuts[i], x[i]), at(model.pair_cuts[j], x[j])] for i, j, t in model.pairs)
    return 1 / (1 + math.exp(-min(max(total, -30), 30)))


def rule_features(text):
    """The shares by which the rules judge a text, in their order."""
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    (_, (n, chars, symbols, dup_lines, repeats, _)), *_ = op2([(0, text)]).items()
    share = lambda a, b: a / b if b else 0.0
    upper, digits = (sum(test(c) for c in text) for test in (lambda c: unicodedata.category(c) == "Lu", lambda c: c in "0123456789"))
    return [n, share(chars, n), share(symbols, chars), share(dup_lines, len(lines)), share(repeats, n), share(upper, chars), share(len(set(w)), n), share(digits, chars)]
