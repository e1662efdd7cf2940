"""A plain Python model of the scoring rules, for comparison on small inputs."""

from __future__ import annotations


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def ratio(a: str, b: str) -> float:
    return 1.0 if not a and not b else 2.0 * lcs(a, b) / (len(a) + len(b))


def score(a: str, b: str, dob_a, dob_b) -> float:
    def ordered(s):
        return " ".join(sorted(s.split()))

    base = max(ratio(a, b), ratio(ordered(a), ordered(b)))
    if dob_a is None or dob_b is None:
        return round(base, 4)
    return round(min(1.0, base + 0.03), 4) if dob_a == dob_b else round(min(base, 0.75), 4)


def letters(*every: str) -> set[str]:
    return {t[0] for n in every for t in n.split() if t}


def matches(profiles, entries, limit=None):
    """{(client, entry): (matched_name, score)} for profiles (client, name, dob) and entries (id, list, names, dob)."""
    out = {}
    for client, name, dob in profiles:
        for provider in {e[1] for e in entries}:
            page = sorted(e for e in entries if e[1] == provider and letters(*e[2]) & letters(name))
            for eid, _, every, edob in page[:limit]:
                best, best_name = -1.0, None
                for n in every:
                    s = score(name, n, dob, edob)
                    if s > best:
                        best, best_name = s, n
                if best >= 0.82:
                    out[client, eid] = (best_name, best)
    return out
