"""Straightforward single-process models the Spark plans are checked against."""

import math

import regex

BLANKS = "\t\n\x0b\x0c\r   " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"


def terms(text, fold=True):
    text = text.lower()
    if fold:
        for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
            text = text.replace(a, b)
    parts = regex.split(r"[^\p{L}\p{N}\-]+", text)
    return [p for p in parts if len(p.encode("utf-16-le")) > 2]


def split_blanks(text):
    return [t for t in regex.split("[" + regex.escape(BLANKS) + "]+", text) if t]


def windows(text, window, overlap):
    tokens = split_blanks(text)
    out, start, step = [], 0, max(1, window - overlap)
    while start < len(tokens):
        end = min(len(tokens), start + window)
        out.append((start, end, " ".join(tokens[start:end])))
        if end == len(tokens):
            break
        start += step
    return out


def rankings(query, chunks, k=50):
    """Both lexical rankings of ``{id: text}`` as lists of (id, score)."""
    sets = {cid: set(terms(text)) for cid, text in chunks.items()}
    n = len(chunks)
    asked = set(terms(query))

    def idf(term):
        df = sum(term in s for s in sets.values())
        return math.log(1 + (n - df + 0.5) / (df + 0.5))

    weight = {t: idf(t) for t in sorted(asked)}
    total = sum(weight.values())
    dense, bm25 = {}, {}
    for cid, found in sets.items():
        matched = sum(w for t, w in weight.items() if t in found)
        base = matched / total if total and found else 0.0
        density = min(0.2, matched / max(10, len(found)))
        dense[cid] = round(min(1.0, base), 6)
        bm25[cid] = round(min(1.0, base + base * density), 6)
    order = lambda s: sorted(s.items(), key=lambda x: (-x[1], x[0]))[:k]
    return order(dense), order(bm25)


def retrieve(query, chunks, top_k=8, dense=None):
    lexical, bm25 = rankings(query, chunks)
    if dense is not None:
        scored = {c: round(dense.get(c, 0.0), 6) for c in chunks}
        lexical = sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:50]
    fused = {}
    for ranked in (lexical, bm25):
        for i, (cid, _) in enumerate(ranked):
            fused[cid] = fused.get(cid, 0.0) + 1 / (60 + i + 1)
    merged = sorted(((c, round(s, 6)) for c, s in fused.items()), key=lambda x: (-x[1], x[0]))
    evidence = dict(bm25)
    final = [(c, s) for c, s in merged if evidence.get(c, 0.0) >= 0.3][:top_k]
    best = max([0.0, *evidence.values()])
    return merged, final, best < 0.3, best


def attempts(events, window, limit):
    """Verdicts of (key, ts) events in order."""
    state, out = {}, []
    for key, now in events:
        start, used = state.get(key, (None, 0))
        if start is None or now - start >= window:
            start, used = now, 0
        ok = used < limit
        used += ok
        state[key] = (start, used)
        out.append(ok)
    return out


def write_limits(events, window, per_client, per_scope):
    """Verdicts of (scope, client, ts) events in order; state is never pruned here."""
    state, out = {}, []

    def live(key, now):
        w = state.get(key)
        return None if w is None or now - w[0] >= window else w

    for scope, client, now in events:
        mine, all_ = live((scope, "c", client), now), live((scope, "g"), now)
        ok = (mine is None or mine[1] < per_client) and (all_ is None or all_[1] < per_scope)
        if ok:
            for key, w in (((scope, "c", client), mine), ((scope, "g"), all_)):
                state[key] = (now, 1) if w is None else (w[0], w[1] + 1)
        out.append(ok)
    return out


def cover_density(sequence, wanted):
    needed, total, last = set(wanted), 0.0, -1
    hits = [(i, t) for i, t in enumerate(sequence) if t in needed]
    for r in range(len(hits)):
        for left in range(r, -1, -1):
            if {t for _, t in hits[left : r + 1]} == needed:
                if left > last:
                    last = left
                    total += 0.1 / (1 + (hits[r][0] - hits[left][0]) - (r - left))
                break
    return round(total, 6)
