"""The pipeline's rows against the same stages by brute force, in plain Python."""

import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken

import corpus_pipeline
from foliant.llm import byte_bpe, line_dedup, mixing, quality_rules
from foliant.llm import text as X
from tests.llm.helpers import SF, WORD, Sets, distance, low, shingles
from tests.llm.test_rows import _base, _water


def _kept(docs):
    counts = defaultdict(list)
    for t in docs.values():
        for k, v in zip(quality_rules.COUNTS, _base(t), strict=True):
            counts[k].append(v)
        words, letters = WORD.findall(t or ""), [c for c in t or "" if c.isascii() and c.isalpha()]
        counts["n_lines"].append(sum(bool(WORD.search(x)) for x in (t or "").split("\n")))
        counts["n_letters"].append(len(letters))
        counts["n_upper"].append(sum(c.isupper() for c in letters))
        counts["n_marked_words"].append(sum(any(c in "#*$%&|<>" for c in w) for w in words))
        counts["n_bang_words"].append(sum(w.endswith("!") for w in words))
    v = quality_rules.votes({k: np.array(x) for k, x in counts.items()})
    model = quality_rules.fit(v, np.ones(len(v)))
    good = model.posterior(v) >= 0.5
    failed = np.array([n < 50 or 100 * r > 50 * n for n, r in zip(counts["n_words"], counts["n_repeat_words"], strict=True)])
    return {i: t for (i, t), g, f in zip(docs.items(), good, failed, strict=True) if g and not f}


def _norm(line):
    return " ".join("".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low(line)).split())


def _similar_lines(lines):
    """All pairs of edit similarity 0.8, by the number of pairs of neighbouring characters that such lines must share, and the distance."""
    lines = sorted(lines, key=len)
    size = np.array([len(x) for x in lines])
    grams = np.zeros((len(lines), 512), dtype=np.int16)
    for i, x in enumerate(lines):
        np.add.at(grams[i], [(ord(a) * 31 + ord(b)) % 512 for a, b in zip(x, x[1:])], 1)
    for i, x in enumerate(lines):
        first = np.searchsorted(size, -(-size[i] * 80 // 100))
        most = size[i] * 20 // 100
        # An edit takes away two pairs at most.
        shared = np.minimum(grams[first:i], grams[i]).sum(axis=1)
        for j in np.flatnonzero(shared >= size[i] - 1 - 2 * most) + first:
            if distance(lines[j], x) <= most:
                yield lines[j], x


def _deduped(docs):
    """Every pair of lines is looked at: on this table the operator's keys miss none."""
    first = {}
    for i in sorted(docs):
        for k, x in enumerate(docs[i].split("\n")):
            n = _norm(x)
            if len(n.split()) >= line_dedup.MIN_WORDS:
                first.setdefault(n, (i, k))
    own = Sets(range(len(first)))
    names = sorted(first, key=first.get)
    at = {n: j for j, n in enumerate(names)}
    for a, b in _similar_lines(first):
        own.join(at[a], at[b])
    out = {}
    for i, t in docs.items():
        lines = t.split("\n")
        stay = [x for k, x in enumerate(lines) if _norm(x) not in first or first[names[own.root(at[_norm(x)])]] == (i, k)]
        text = "\n".join(stay)
        if len(stay) == len(lines) or WORD.search(text):
            out[i] = text
    return out


def _one_of_each(docs):
    ids = sorted(docs)
    sets = {i: shingles(docs[i]) for i in ids}
    own = Sets(ids)
    for a, b in combinations(ids, 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * n >= 80 * len(sets[a] | sets[b]):
            own.join(a, b)
    return {i: docs[i] for i in ids if own.root(i) == i}


def _mixed(docs, sources):
    size = {i: len(WORD.findall(t)) for i, t in docs.items()}
    total = Counter()
    for i in docs:
        total[sources[i]] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    target = _water(total, {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}, mixing.MAX_EPOCHS)
    times = Counter()
    for s in total:
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, upto = target[s] - whole * total[s], 0
        place = lambda i: hashlib.md5(f"{mixing.SEED}:{i}:{sources[i] or ''}".encode()).hexdigest()
        for i in sorted((i for i in docs if sources[i] == s), key=place):
            upto += size[i]
            times[i] = (whole + (upto - size[i] / 2 <= rest)) if size[i] else 0
    return times


def test_pipeline_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sources = {r.doc_id: r.source for r in rows}
    docs = _one_of_each(_deduped(_kept({r.doc_id: r.text for r in rows})))
    ranks = byte_bpe.codec(P.path(byte_bpe.RANKS)).encoding._mergeable_ranks
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, n in _mixed(docs, sources).items():
        want[i, tuple(plain.encode_ordinary(docs[i]))] += n
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want


def test_words_hash_alike_alone_and_in_a_text():
    c = next(X.chunks(pa.array(["zero one two three"])))
    w = X.words(c)
    h = X.span_hashes(X.prefix_hashes(c.data), w.start, w.end)
    alone = [int(X.span_hashes(X.prefix_hashes(np.frombuffer(t, dtype=np.uint8)), np.array([0]), np.array([len(t)]))[0]) for t in (b"zero", b"one", b"two", b"three")]
    assert h.tolist() == alone
