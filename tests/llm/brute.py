"""Plain single-machine versions of what the operators compute."""

import hashlib
import re


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


SECRETS = (
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)


def secrets(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(SECRETS):
        found += [
            (m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least
        ]
    return ",".join(s for _, _, s in sorted(found))


def contamination(text, items, window=13):
    own, hit, named = words(text), set(), set()
    for name, item in items:
        theirs = words(item)
        width = min(window, len(theirs))
        if not width:
            continue
        wanted = {tuple(theirs[i : i + width]) for i in range(len(theirs) - width + 1)}
        for i in range(len(own) - width + 1):
            if tuple(own[i : i + width]) in wanted:
                hit.update(range(i, i + width))
                named.add(str(name))
    digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
    return len(own), len(hit), len(named), digest, bool(hit) and 20 * len(hit) >= len(own)


def shingles(text, width):
    own = spaced(text)
    if len(own) < width:
        return {tuple(own)} if own else set()
    return {tuple(own[i : i + width]) for i in range(len(own) - width + 1)}


def components(rows, width, percent):
    """(id, set size, smallest id reached) of each row; all ids differ."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i in sorted(sets):
        near = set()
        for gram in sets[i]:
            near.update(index.setdefault(gram, []))
            index[gram].append(i)
        for j in near:
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), root(i)) for i in sets}


def license_places(text):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    own = words(text)
    hits = [(i, label) for i in range(len(own)) for p, label in phrases.items() if tuple(own[i : i + len(p)]) == p]
    starts = [i for i, _ in hits]
    return (len(own), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits})))


def license_templates(text, templates, idf):
    """Best (coverage, start, end) of each label: every template tried at every start."""
    own, best, tried = words(text), {}, []
    for t in templates:
        template = words(t.text)
        places = [(next(i for i in range(len(template)) if template[i : i + len(key)] == key), key) for key in map(words, t.keys)]
        tried.append((t, template, [(place + i, w) for place, key in places for i, w in enumerate(key)]))
    for start in range(-max(len(template) for _, template, _ in tried), len(own)):
        for t, template, mandatory in tried:
            at = lambda i: own[start + i] if 0 <= start + i < len(own) else None
            whole = all(at(i) == w for i, w in mandatory)
            if not whole:
                continue
            standing = [w for i, w in enumerate(template) if at(i) == w]
            if len(set(standing)) < min(2, len(set(template))):
                continue
            total = sum(idf[w] for w in template)
            coverage = min(1.0, sum(idf[w] for w in standing) / total) if total > 0 else 1.0
            if coverage >= 0.5 and coverage > best.get(t.label, (0.0,))[0]:
                best[t.label] = (coverage, max(start, 0), start + len(template))
    return best
