"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import re

from tokenizers import Tokenizer

from vettra.llm.queries import tokenizer

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LIBRARY = Tokenizer.from_file(tokenizer())


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def figures(text):
    words = BLANK.findall(text or "")
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(3)}
    lines, dup = [], 0
    for line in (text or "").split("\n"):
        if BLANK.search(line):
            dup += line in lines
            lines.append(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": dup,
        "n_repeat_words": len(repeated),
        "base_failed": len(words) < 50 or 100 * len(repeated) > 50 * len(words),
    }


def line_verdicts(rows, max_docs, max_share, min_left, copies_once, first_stays):
    """(words removed, lines removed, kept) of each (doc_id, text, host), by comparing every line with every document."""

    def normal(text):
        lines = [re.split(r"[\x20\x09-\x0D]+", lower(line).strip("\x20\t\n\v\f\r")) for line in (text or "").split("\n")]
        return [" ".join(words) for words in lines if words != [""]]

    out = []
    held = [(i, text or "", host, normal(text)) for i, text, host in rows]
    for i, text, host, lines in held:
        same = [x for x in held if x[2] == host]
        n = len({x[1] if copies_once else x[0] for x in same})
        removed = count = 0
        for line in lines:
            holders = [x for x in same if line in x[3]]
            docs = {x[1] if copies_once else x[0] for x in holders}
            first = min((x[0] for x in holders if x[0] is not None), default=None)
            if len(docs) > max_docs and len(docs) > max_share * n and not (first_stays and i == first):
                removed, count = removed + len(line.split(" ")), count + 1
        told = figures(text)
        out.append((removed, count, not told["base_failed"] and told["n_words"] - removed >= min_left * told["n_words"]))
    return out


def hits(text, items, window):
    """(words hit, items found) of one text; items by id."""
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for item, told in items:
        run = WORD.findall(lower(told))
        k = min(window, len(run))
        wins = {tuple(run[i : i + k]) for i in range(len(run) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in wins:
                found.add(item)
                hit |= set(range(i, i + k))
    return len(words), len(hit), sorted(found)


def shingles(text, size):
    words = BLANK.findall(lower(text))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def groups(docs, size, percent):
    """Component by doc_id of (doc_id, text) pairs with distinct ids."""
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def personal(text):
    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def digest(values):
    return hashlib.sha256(",".join(values).encode()).hexdigest()
