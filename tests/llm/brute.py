"""Plain versions of what the operators do, one text and one word at a time."""

import math
import re
from collections import Counter, defaultdict

import regex

from .conftest import lowered, words

KINDS = ["email", "ip", "card", "phone", "generalise", "remove"]
TAGS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", ""]
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
LETTERS = regex.compile(r"[\p{L}\p{M}]{3,}")


def _fine(kind, x):
    digits = re.sub("[^0-9]", "", x)
    if kind == 1:
        return all(int(p) <= 255 for p in x.split("."))
    if kind == 2:
        back = [int(c) for c in digits[::-1]]
        return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(back)) % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def base(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "", re.ASCII) if _fine(k, m[0]))


def _entity(kind, value):
    return f"{kind}:" + (value.lower() if kind == 0 else value if kind == 1 else re.sub("[^0-9]", "", value))


def _masked(text, spans):
    out = list(text)
    for a, _, b in spans:
        out[a:b] = " " * (b - a)
    return "".join(out)


def all_spans(given, near=6, support=3, generalise=0.8, remove=0.95):
    """Of each text: the base spans and those of terms that disclose an entity."""
    found = [(t, base(t)) for t in given]
    n = sum(t is not None for t in given)
    of_term, of_entity, of_both, texts = Counter(), Counter(), Counter(), defaultdict(set)
    for t, spans in found:
        if t is None:
            continue
        plain, blank = LETTERS.findall(t.lower()), _masked(t, spans)
        placed = [(m.start(), m[0].lower()) for m in LETTERS.finditer(blank)]
        of_term.update(set(plain) | (set(LETTERS.findall(blank.lower())) if spans else set()))
        of_entity.update({_entity(k, t[a:b]) for a, k, b in spans})
        pairs = set()
        for a, k, b in spans:
            before = [w for p, w in placed if p < a]
            pairs |= {(_entity(k, t[a:b]), w) for w in before[-near:] + [w for p, w in placed if p > a][:near]}
        of_both.update(pairs)
        for p in pairs:
            texts[p].add(t)
    kind = {}
    for (e, w), k in of_both.items():
        own = math.log2(n / of_entity[e])
        if len(texts[e, w]) >= support and own > 0:
            share = min(math.log2(n * k / (of_entity[e] * of_term[w])) / own, 1)
            if share >= generalise:
                kind[e, w] = 5 if share >= remove else 4
    by_entity = defaultdict(dict)
    for (e, w), k in kind.items():
        by_entity[e][w] = k
    for t, spans in found:
        terms = {}
        for e in {_entity(k, t[a:b]) for a, k, b in spans}:
            for w, k in by_entity[e].items():
                terms[w] = max(k, terms.get(w, 0))
        more = [(m.start(), terms[m[0].lower()], m.end()) for m in LETTERS.finditer(_masked(t, spans)) if m[0].lower() in terms] if terms else []
        yield sorted(spans + more)


def replaced(text, spans):
    out, at = "", 0
    for a, k, b in spans:
        if a >= at:
            out += text[at:a] + TAGS[k]
        at = max(at, b)
    return out + text[at:]


def removed(given, window=50):
    """(how many words go, the others) of each (doc_id, text)."""
    least = {}
    for i, t in given:
        w = words(t)
        for p in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[p : p + window])
            least[key] = min(i, least.get(key, i))
    for i, t in given:
        w, cut = words(t), set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[p : p + window])] < i:
                cut.update(range(p, p + window))
        yield len(cut), [x for p, x in enumerate(w) if p not in cut]


def similar_groups(texts, size=5, similarity=0.8):
    """A number for each text; texts of one number are linked by sets of shingles of at least that similarity."""
    sets = {}
    for t in set(texts):
        w = words(lowered(t))
        sets[t] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}
    names = list(sets)
    root = {t: t for t in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(names):
        for y in names[:i]:
            a, b = sets[x], sets[y]
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b) - 1e-12:
                root[find(x)] = find(y)
    return [find(t) for t in texts]


def features(text):
    """What the quality rules look at."""
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    chars = "".join(w)
    return {
        "n_words": len(w), "word_chars": len(chars), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeat), "n_lines": len(lines), "n_distinct": len(set(w)),
        "n_upper": sum("A" <= c <= "Z" for c in text), "n_letters": sum("A" <= c <= "Z" or "a" <= c <= "z" or ord(c) > 127 for c in text), "n_digits": sum("0" <= c <= "9" for c in text), "n_shout": sum(x.endswith("!") for x in w),
    }


def votes(f):
    w, c = f["n_words"], f["word_chars"]
    vote = lambda good, bad: -1 if bad else 1 if good else 0
    return (
        vote(w >= 100, w < 50),
        vote(f["n_symbols"] * 1000 <= c, f["n_symbols"] * 100 > 2 * c),
        vote(f["n_dup_lines"] * 10 <= f["n_lines"], f["n_dup_lines"] * 100 > 30 * f["n_lines"]),
        vote(f["n_repeat_words"] * 100 <= 10 * w, f["n_repeat_words"] * 100 > 30 * w),
        vote(f["n_upper"] * 100 <= 15 * c, f["n_upper"] * 100 > 40 * c),
        vote(f["n_shout"] * 100 <= 2 * w, f["n_shout"] * 100 > 20 * w),
        vote(3 * w <= c <= 9 * w, c * 10 < 22 * w or c > 14 * w),
        vote(f["n_letters"] * 100 >= 85 * c, f["n_letters"] * 100 < 70 * c),
        vote(f["n_digits"] * 100 <= 3 * c, f["n_digits"] * 100 > 20 * c),
        vote(f["n_distinct"] * 100 >= 40 * w or f["n_distinct"] >= 400, f["n_distinct"] * 100 < 15 * min(w, 2000)),
    )


def quality(texts, rounds=60):
    """(posterior, kept) of each text, by expectation-maximisation over texts one at a time."""
    found = [features(t) for t in texts]
    cast = [votes(f) for f in found]
    n = len(cast)
    q = [1 / (1 + math.exp(-(sum(x > 0 for x in v) - 6 * sum(x < 0 for x in v)))) for v in cast]
    weight = max(2.0, n / 1000)
    belief = [[6 / 9, 2 / 9, 1 / 9], [0.5 / 8.5, 2 / 8.5, 6 / 8.5]]
    for _ in range(rounds):
        table = [[[belief[k][v] * weight for v in range(3)] for k in range(2)] for _ in range(10)]
        for good, v in zip(q, cast, strict=True):
            for r, x in enumerate(v):
                table[r][0][x + 1] += 1 - good
                table[r][1][x + 1] += good
        table = [[[x / sum(side) for x in side] for side in rule] for rule in table]
        share = (sum(q) + 1) / (n + 2)
        now = []
        for v in cast:
            odds = math.log(share / (1 - share)) + sum(math.log(table[r][1][x + 1] / table[r][0][x + 1]) for r, x in enumerate(v))
            now.append(1 / (1 + math.exp(-odds)))
        done = max(map(abs, map(float.__sub__, now, q))) < 1e-10
        q = now
        if done:
            break
    failed = [f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"] for f in found]
    return [(p, p >= 0.5 and not bad) for p, bad in zip(q, failed, strict=True)]


def language(learned, texts, size=300):
    """(language, score) of each text, from (text, lang) pairs: out-of-place distance over n-grams of 1 to 3 letters with
    word boundaries; ties in rank go to the n-gram whose code points are smaller, ties in distance to the smaller name."""

    def grams(text):
        parts = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")
        out = Counter()
        for w in parts:
            if w:
                out.update(w)
                padded = "\0" + w + "\0"
                out.update(padded[i : i + 2] for i in range(len(padded) - 1))
                out.update(padded[i : i + 3] for i in range(len(padded) - 2))
        return out

    def code(gram):
        out = 0
        for c in gram:
            out = out << 21 | (ord(c) if c != "\0" else 1)
        return out

    def profile(counts):
        return {g: r for r, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:size])}

    by_lang = defaultdict(Counter)
    for t, lang in learned:
        if t is not None and lang is not None:
            by_lang[lang].update(grams(t))
    profiles = {k: profile(v) for k, v in by_lang.items() if v}
    for t in texts:
        own = profile(grams(t))
        if not own or not profiles:
            yield "und", 0.0
            continue
        far = {k: sum(abs(r - p[g]) if g in p else size for g, r in own.items()) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        yield best, 1 - far[best] / (size * len(own))
