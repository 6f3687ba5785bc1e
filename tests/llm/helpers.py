"""Plain forms of the contracts, written without the operators."""

import hashlib
import re

import xxhash


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def groups(ids, links):
    """Smallest id reachable from each id."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def contamination(docs, items):
    """{doc_id: (n_words, n_hit, n_items, items_sha256)} by comparing all windows."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        names = sorted(str(i) for i in found if i is not None)
        out[doc] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest())
    return out


def simhash(text, size=4, remixed=0):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for _ in range(remixed):
            h = (h ^ h >> 31) * 0x9E3779B97F4A7C15 % 2**64
            h ^= h >> 29
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii(text):
    out = []
    for k, p in PII.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == "card" and not (14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if k == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], list(PII).index(s[2])))


def conversation(turns):
    """(n_turns, turns_sha256, loss_chars, loss_sha256) of (role, text) turns."""
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def jaccard(a, b, size=5):
    a, b = ({" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} for w in (re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in (a, b)))
    return len(a & b) / len(a | b)
