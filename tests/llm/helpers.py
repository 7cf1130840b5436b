"""Small tables and brute-force versions."""

import re

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(_LOW)


def docs(spark, texts, schema=DOCS):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


#: Null, empty, blank, one word, accents and symbols, repeated rows, and a long text.
ODD = [None, "", " \n\t ", "word", "Ünïcödé #*$ <x> 漢字", "same text here\nsame text here", "a b c " * 30_000, "x" * 50_000]


def shingles(text, width=5):
    w = WORD.findall(low(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


class Sets:
    """Union-find whose roots are the least members."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]
