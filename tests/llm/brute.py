"""Plain-Python versions of the corpus operators' contracts, and rows with every awkward case."""

import datetime
import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def alnum_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD)) if w]


def space_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def odd_rows():
    """(doc_id, text, lang, source, n_chars, shard): nulls, empty and long texts, ties, repeated rows, a clashing name."""
    prose = "the quick brown fox jumps over the lazy dog near a quiet river bank while seven grey herons watch from the reeds"
    words = prose.split()
    long = " ".join(words[i * i % len(words)] + str(i % 91) for i in range(12_000))
    return [
        (1, prose, "en", "a", 10, 0),
        (2, prose.upper(), "en", "a", 10, 0),
        (3, prose + " again", None, "b", 10, 1),
        (4, None, "en", None, None, None),
        (5, "", "en", "b", 0, 1),
        (6, " \n\t ", None, None, 0, 1),
        (7, "...", "fr", "c", 3, 2),
        (8, "word", "fr", "c", 4, 2),
        (8, "word", "fr", "c", 4, 2),
        (9, long, "de", "a", 1, 1),
        (None, prose, "en", "a", 1, 1),
        (None, None, None, None, None, None),
        (10, "All rights reserved. CC-BY, cc by! General\nPublic license é 日本語 all", "en", "c", 1, 1),
        (11, "a b\na b\n\na b\nx y z x y z", "en", "a", 1, 1),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int"


def contamination(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = alnum_words(text)
        if item is None or not w:
            continue
        k = min(window, len(w))
        for i in range(len(w) - k + 1):
            wins.setdefault(tuple(w[i : i + k]), set()).add(item)
    lengths = {len(x) for x in wins}
    out = []
    for doc_id, text in docs:
        w = alnum_words(text)
        hit, found = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                got = wins.get(tuple(w[i : i + k]))
                if got:
                    hit |= set(range(i, i + k))
                    found |= got
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, bool(hit)))
    return out


def licenses(text):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    w = alnum_words(text)
    at, labels = [], set()
    for p, label in phrases.items():
        q = p.split()
        got = [i for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
        at += got
        if got:
            labels.add(label)
    return len(w), len(at), min(at) if at else None, max(at) if at else None, ",".join(sorted(labels))


def templates_matched(text, templates, threshold, step_of):
    """(labels, number of matching blocks, best share), every block against every template."""
    w = alnum_words(text)
    labels, n, best = set(), 0, 0.0
    for t in templates:
        step, want = step_of(t), set(t.text.split())
        for s in range(0, max(1, len(w) - step), step):
            have = set(w[s : s + 2 * step])
            share = len(want & have) / len(want)
            if share < threshold - 1e-9:
                continue
            n, best = n + 1, max(best, share)
            block, reach = w[s : s + 2 * step], len(t.text.split())
            near = [set(block[max(0, i - reach) : i + reach + 1]) for i, x in enumerate(block) if x in t.needs[:1]]
            if not t.needs or any(set(t.needs) <= x and not set(t.bars) & x for x in near):
                labels.add(t.label)
    return labels, n, best


def quality(text):
    w = space_words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if space_words(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def dup_share(text, n):
    w = space_words(text)
    grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    rep = {j for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
    return sum(len(w[j]) for j in rep) / max(1, sum(map(len, w)))


def shingles(text, size):
    w = space_words((text or "").translate(FOLD))
    if len(w) >= size:
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def near(docs, size, percent=80):
    """{doc_id: (n_shingles, component)} for distinct non-null ids."""
    sets = {i: shingles(t, size) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def crc_of(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())


def feistel(a, b, of_a, of_b, key, tweak):
    noise = lambda r, x: int(hashlib.sha256(f"{key}|{tweak}|{r}|{x}".encode()).hexdigest()[:14], 16)
    for r in range(10):
        if r % 2:
            b = (b + noise(r, a)) % of_b
        else:
            a = (a + noise(r, b)) % of_a
    return a, b


def permuted(s, base, key, tweak):
    """A string of digits (base 10) or letters (base 26) as another of the same length."""
    zero = ord("0") if base == 10 else ord("a")
    u = len(s) // 2
    number = lambda t: sum((ord(c) - zero) * base**i for i, c in enumerate(reversed(t)))
    spell = lambda x, n: "".join(chr(zero + x // base**i % base) for i in reversed(range(n)))
    a, b = feistel(number(s[:u]), number(s[u:]), base**u, base ** (len(s) - u), key, tweak)
    return spell(a, u) + spell(b, len(s) - u)


def refill(m, new, kind):
    new = iter(new)
    return "".join(next(new) if re.fullmatch(kind, c) else c for c in m)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def pseudonym(kind, m, key, issuers):
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        local, domain = m.lower().split("@")
        for base, size, wanted in ((26, 26, "[a-z]"), (10, 36, "[0-9]")):
            own = "".join(re.findall(wanted, local))
            pieces = [own[i : i + size] for i in range(0, len(own), size)]
            local = refill(local, "".join(permuted(p, base, key, f"email{i or ''}") for i, p in enumerate(pieces)), wanted)
        return f"{local}@{domain}"
    if kind == "ip":
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return m
        a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "phone":
        head = "+1" if m.startswith("+1") else ""
        d = d[-10:]
        area, exchange, line = int(d[:3]), int(d[3:6]), int(d[6:])
        (la, na), (le, ne) = ((0, 200) if x < 200 else (200, 800) for x in (area, exchange))
        a, b = feistel((area - la) * ne + exchange - le, line, na * ne, 10_000, key, "phone")
        return head + refill(m[len(head) :], f"{a // ne + la:03}{a % ne + le:03}{b:04}", "[0-9]")
    if kind == "ssn":
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return m
        a, b = feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
        at = a // 99
        return f"{at + 1 + (at >= 665):03}-{a % 99 + 1:02}-{b + 1:04}"
    if kind == "date":
        y, mo, day = (m[:4], m[5:7], m[8:]) if "-" in m else (m[6:], m[:2], m[3:5])
        try:
            n = (datetime.date(int(y), int(mo), int(day)) - datetime.date(1900, 1, 1)).days
        except ValueError:
            return m
        if not 0 <= n < 17 * 4297:
            return m
        a, b = feistel(n // 4297, n % 4297, 17, 4297, key, "date")
        new = datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)
        return new.strftime("%Y-%m-%d" if "-" in m else "%m/%d/%Y")
    if kind == "iban":
        plain = m.replace(" ", "")
        if not 15 <= len(plain) <= 34 or mod97(plain[4:] + plain[:4]) != 1:
            return m
        own = re.sub("[^0-9]", "", plain[4:])
        new = refill(plain[4:], permuted(own, 10, key, "iban"), "[0-9]") if len(own) > 1 else plain[4:]
        return refill(m, f"{plain[:2]}{98 - mod97(new + plain[:2] + '00'):02}{new}", "[A-Z0-9]")
    if not re.match(issuers, d) or luhn(d):
        return m
    body = d[:4] + permuted(d[4:-1], 10, key, "card")
    return refill(m, body + str(-luhn(body + "0") % 10), "[0-9]")


def pseudonymise(text, key, patterns, issuers):
    """(text, {kind: values replaced})."""
    counts = Counter()
    whole = "|".join(f"(?:{p})" for p in patterns.values()).replace("([ -])", "(?P<sep>[ -])").replace(r"\1", "(?P=sep)")

    def put(found):
        kind = next(k for k, p in patterns.items() if re.fullmatch(p, found[0], re.A))
        new = pseudonym(kind, found[0], key, issuers)
        counts[kind] += new != found[0]
        return new

    return text and re.sub(whole, put, text, flags=re.A), counts
