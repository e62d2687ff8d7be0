"""Brute-force versions and shared fixtures of the operator tests."""

import hashlib
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, sources=None, ids=None):
    rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else f"s{i % 3}",
             len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def write_docs(spark, folder, texts, **kw):
    docs_frame(spark, texts, **kw).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


SECRETS = {
    "assign": re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
                         r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?"
                         r"([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base_secrets(text):
    """{kind: spans} of the agreed kinds."""
    text = text or ""
    keep = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20,
            "hex": lambda m: len(m[0]) >= 24}
    return {k: [m.span() for m in p.finditer(text) if keep[k](m)] for k, p in SECRETS.items()}


PRIVATE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_private(text):
    text = text or ""
    only = lambda m: re.sub(r"[^0-9]", "", m[0])
    keep = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")),
            "card": lambda m: 12 <= len(only(m)) <= 19 and luhn(only(m)),
            "phone": lambda m: 9 <= len(only(m)) <= 15}
    return {k: [m.span() for m in p.finditer(text) if keep[k](m)] for k, p in PRIVATE.items()}


def joined(by_kind):
    order = list(by_kind)
    spans = sorted((s, order.index(k), e, k) for k, v in by_kind.items() for s, e in v)
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def simhash(text, shingle=3):
    import xxhash
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(n, linked):
    """Root of each of ``n`` nodes under ``linked`` pairs."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]
