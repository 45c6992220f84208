"""Plain-Python versions of the operators' contracts."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(docs, threshold=75):
    """docs: [(doc_id, text)] with distinct ids -> {doc_id: (size, component)}"""
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for d in ids:
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    from collections import Counter

    for d in ids:
        both = Counter(e for s in sets[d] for e in by[s] if e < d)
        for e, n in both.items():
            if 100 * n >= threshold * (len(sets[d]) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in ids}


def rule_counts(text):
    """word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words"""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w)


def longest_earlier(docs):
    """docs: [(doc_id, text)] with distinct ids -> {doc_id: [(line number, line, longest run from it that stands before)]}"""
    lines = {d: [(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\f\v")] for d, t in docs}
    order = [(d, k) for d in sorted(lines) for k in range(len(lines[d]))]
    out = {d: [] for d in lines}
    for n, (d, k) in enumerate(order):
        best = 0
        for e, j in order[:n]:
            m = 0
            while k + m < len(lines[d]) and j + m < len(lines[e]) and lines[d][k + m][1] == lines[e][j + m][1]:
                m += 1
            best = max(best, m)
        out[d].append((*lines[d][k], best))
    return out


def without_copies(docs, min_lines=2, min_chars=100):
    """{doc_id: (text, lines removed, longest run)} by the lengths above"""
    found, out = longest_earlier(docs), {}
    for d, text in docs:
        gone, run, reach = set(), 0, -1
        for k, (i, x, n) in enumerate(found[d]):
            if n >= min_lines:
                reach = max(reach, k + n)
            if reach > k or n and len(x) >= min_chars:
                gone.add(i)
            if n >= min_lines or n and len(x) >= min_chars:
                run = max(run, n)
        out[d] = (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), len(gone), run)
    return out


def tree_importance(pages):
    """pages: [(host, nodes_of(html))] -> {(host, path): importance}, one node at a time"""
    import math
    import re
    from collections import Counter

    from panelspark.llm import main_text as m

    def entropy(counts, n):
        return -sum(c / n * math.log(c / n) for c in counts) if n else 0.0

    def tree(found):
        out = {}
        for path, nodes in found.items():
            n = len(nodes)
            texts = Counter(t for x in nodes for t in {y["text"] for y in x["texts"]})
            occurrences = sum(texts.values())
            mean = sum(c * math.log(c) for c in texts.values()) / occurrences if occurrences else None
            out[path] = (n, sum(x["share"] for x in nodes) / n, None if n < 2 or mean is None else 1 - mean / math.log(n), None if n < 2 else entropy(Counter(x["style"] for x in nodes).values(), n) / math.log(n))
        return out

    def drawn(n, value, to):
        return ((n - 1) * (value or 0.0) + m.DRAWN * to) / (n - 1 + m.DRAWN)

    by_host, all_ = {}, {}
    for host, nodes in pages:
        for x in nodes:
            by_host.setdefault(host, {}).setdefault(x["path"], []).append(x)
            all_.setdefault(x["path"], []).append(x)
    wide = {p: (drawn(n, c, m.NEUTRAL_CONTENT), drawn(n, s, m.NEUTRAL_STYLE)) for p, (n, _, c, s) in tree(all_).items()}
    out = {}
    for host, found in by_host.items():
        own = {p: (n, share, wide[p][0] if c is None and n > 1 else drawn(n, c, wide[p][0]), drawn(n, s, wide[p][1])) for p, (n, share, c, s) in tree(found).items()}
        for path, (n, share, content, _) in own.items():
            if not share:
                continue
            steps, looks = path.split("/"), 0.0
            for k in range(2, len(steps) + 1):
                if not re.match(r"(html|body)(\.|$)", steps[k - 1]):
                    looks = max(looks, own["/".join(steps[:k])][3] * m.FADE ** (len(steps) - k))
            out[host, path] = m.CONTENT * content + (1 - m.CONTENT) * (1 - (1 - looks) * (1 - share))
    return out


def em(rows, rounds=500):
    """rows: vote lists -> posterior of each document: good or one of two kinds of bad, one document and one rule at a time."""
    k = len(rows[0])
    n_bad = [sum(x < 0 for x in v) for v in rows]
    p = [[0.9, 0.05, 0.05] if n == 0 else [0.1, 0.1, 0.8] if n == 1 else [0.1, 0.8, 0.1] for n in n_bad]
    clip = lambda x, low=0.001: min(max(x, low), 0.999)
    before = None
    for _ in range(rounds):
        right = [[0.0] * k for _ in range(3)]
        for j in range(k):
            for c in range(3):
                up = sum(q[c] for q, v in zip(p, rows) if v[j] > 0)
                down = sum(q[c] for q, v in zip(p, rows) if v[j] < 0)
                right[c][j] = clip((up + 19) / (up + down + 20), 0.995) if c == 0 else clip((down + 2) / (up + down + 4))
        share = [clip((sum(q[c] for q in p) + (8, 1, 1)[c]) / (len(p) + 10)) for c in range(3)]
        p = []
        for v in rows:
            odds = []
            for c in range(3):
                x = share[c]
                for z, r in zip(v, right[c]):
                    if z:
                        x *= r if (z > 0) == (c == 0) else 1 - r
                odds.append(x)
            p.append([x / sum(odds) for x in odds])
        now = [x for r in right for x in r] + share
        if before and max(abs(a - b) for a, b in zip(before, now)) < 1e-9:
            break
        before = now
    return [q[0] for q in p]


def sequences_needed(counts, limit):
    """A lower bound: pieces over half need one each; of the rest those from k on fit no gap of pieces over limit - k."""
    most = 0
    for k in range(1, limit // 2 + 1):
        free = sum((limit - x) * counts.get(x, 0) for x in range(limit // 2 + 1, limit - k + 1))
        small = sum(x * counts.get(x, 0) for x in range(k, limit // 2 + 1))
        most = max(most, -((free - small) // limit))
    return most + sum(n for x, n in counts.items() if x > limit // 2)
