"""Plain versions of the operators' rules, written from what they promise: all pairs, whole texts, no shared code but fixed values."""

import math
import re
from collections import Counter
from itertools import pairwise

from test_corpus import WORD, base_spans, counted, fingerprint, words
from tokenizers import Tokenizer

from promptsift.llm import quality, secret_scan


def coverage(t):
    """The largest share of its limit that characters inside repeated n-grams have, and that of repeated lines."""
    w = words(t)
    total, worst = max(1, sum(map(len, w))), 0.0
    for n, most in quality.COVERAGE.items():
        grams = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) > n else Counter()
        inside = {j for k in range(len(w) - n + 1) if grams[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
        worst = max(worst, sum(len(w[j]) for j in inside) / total / most)
    seen, again = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            again += sum(map(len, words(line))) if line in seen else 0
            seen.add(line)
    return worst, again / total


def is_kept(t):
    n, _, symbols, _, _, failed = counted(t)
    worst, lines = coverage(t)
    return not failed and worst <= 1 and lines <= quality.LINE_COVERAGE and symbols <= quality.SYMBOLS * n


def chi_tail(x, k):
    """P(chi-squared of k degrees > x), by its series."""
    if x <= 0:
        return 1.0
    a, term, total, n = k / 2, 1 / (k / 2), 1 / (k / 2), 0
    while term > total * 1e-16:
        n += 1
        term *= x / 2 / (a + n)
        total += term
    return max(0.0, 1 - total * math.exp(-x / 2 + a * math.log(x / 2) - math.lgamma(a)))


def fisher(ps):
    return chi_tail(-2 * sum(math.log(max(p, 1e-300)) for p in ps), 2 * len(ps))


def looks_random(token, chars, classes):
    """The four tests against a uniform draw from the alphabet, joined."""
    m, n = len(chars), len(token)
    at = [chars.index(c) for c in token]
    parts, low = [], 0
    for size in classes:
        parts.append(set(range(low, low + size)))
        low += size
    if len(parts) > 3:
        parts = [parts[0] | parts[3], parts[1], parts[2]]
    slices = max(2, min(m, n // 5))
    cut = [{x for x in range(m) if x * slices // m == k} for k in range(slices)]
    chi = lambda sets: chi_tail(sum((sum(x in s for x in at) - n * len(s) / m) ** 2 / (n * len(s) / m) for s in sets), len(sets) - 1)
    above = [2 * x >= m for x in at]
    ones, zeros = sum(above), n - sum(above)
    mean = 1 + 2 * ones * zeros / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    two = lambda z: math.erfc(abs(z) / math.sqrt(2))
    runs = two((1 + sum(a != b for a, b in pairwise(above)) - mean) / math.sqrt(spread)) if spread > 0 else 0.0
    mid = sum(at) / n
    square = sum((x - mid) ** 2 for x in at)
    serial = sum((a - mid) * (b - mid) for a, b in pairwise(at)) / square if square else 1.0
    return fisher([chi(parts), chi(cut), runs, two((serial + 1 / n) * math.sqrt(n))]) >= secret_scan.RANDOM


def letters():
    """Chances of a letter alone, and after another, in the sample of ordinary words."""
    sample = re.findall("[a-z]+", secret_scan._SAMPLE.lower())
    one, two = Counter(c for w in sample for c in w), Counter(a + b for w in sample for a, b in pairwise(w))
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    alone = {c: (one[c] + 1) / (sum(one.values()) + 26) for c in alphabet}
    after = Counter()
    for pair, n in two.items():
        after[pair[0]] += n
    return alone, lambda a, b: (two[a + b] + 10 * alone[b]) / (after[a] + 10)


ALONE, AFTER = letters()


def kind(c):
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def p_value(token):
    """The likelihood ratio of ordinary text against the narrowest alphabet, for tokens that pass as random."""
    fits = [(chars, classes) for chars, classes in secret_scan.ENCODINGS.values() if set(token) <= set(chars)]
    if token.isdigit() or not fits or re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", token):
        return 1.0
    log = len(token) * math.log(len(fits[0][0]))
    for a, b in pairwise("+" + token):
        log += math.log(secret_scan._FOLLOWS[kind(a)][kind(b)])
        if kind(b) < 2:
            log += math.log(AFTER(a.lower(), b.lower()) if kind(a) < 2 else ALONE[b.lower()])
        else:
            log -= math.log(10 if kind(b) == 2 else 4)
    return math.exp(log) if log < 0 and looks_random(token, *fits[0]) else 1.0


def all_spans(t):
    """(start, end, kind) of the base patterns and of what the false-discovery procedure adds."""
    base = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base_spans(t))]
    tokens = [(m.start(), m.end(), m[0].rstrip("=")) for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", t or "")]
    mean = sum(len(x) for _, _, x in tokens) / max(1, len(tokens))
    ranked = sorted((p_value(x) * mean / len(x), a, b) for a, b, x in tokens)
    passed = [k for k, (p, _, _) in enumerate(ranked, 1) if p <= secret_scan.FALSE * k / len(ranked)]
    found = [(a, b, "random") for _, a, b in ranked[: max(passed, default=0)]]
    order = (*secret_scan.KINDS, "random")
    return sorted(base + [f for f in found if not any(f[0] < b and a < f[1] for a, b, _ in base)], key=lambda x: (x[0], order.index(x[2])))


def redacted(t):
    """Each span, or run of overlapping ones, replaced by the mark."""
    marks = [None] * len(t)
    for n, (a, b, _) in enumerate(all_spans(t)):
        for k in range(a, b):
            marks[k] = marks[a] if marks[a] is not None and marks[a] != n else n
    out = []
    for k, c in enumerate(t):
        if marks[k] is None:
            out.append(c)
        elif k == 0 or marks[k - 1] != marks[k]:
            out.append("[SECRET]")
    return "".join(out)


def shingles(t):
    w = words(t.encode().lower().decode())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_groups(texts):
    """The least id of each id's group: two bits of fingerprint, or 0.8 of five-word shingles."""
    prints, parts = {k: fingerprint(t) for k, t in texts.items()}, {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(texts)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            both = len(parts[a] & parts[b])
            if (prints[a] ^ prints[b]).bit_count() <= 2 or both and both >= 0.8 * (len(parts[a]) + len(parts[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def brute_pieces(docs):
    """Tokens of each kept document, with the end id."""
    kept = {k: t or "" for k, t in docs if is_kept(t)}
    least = near_groups(kept)
    t = Tokenizer.from_file(WORD)
    return {k: len(t.encode(redacted(x), add_special_tokens=False).ids) + 1 for k, x in kept.items() if least[k] == k}
