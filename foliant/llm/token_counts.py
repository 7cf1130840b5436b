"""Token counts: exact counts at prefixes by dynamic programming.

A text is cut into the pieces of the pre-splitting, and no token crosses from one to the next.
Within a piece, the encoding of a prefix ends in the one token t for which the encoding of what
precedes t, followed by t, is stable, so count(k) = count(k - len(t)) + 1. An Aho-Corasick
automaton of the vocabulary names the tokens that end at each k. ``prefix_counts`` adds the pieces up and stores the exact number of tokens at cuts that no token crosses;
``every_prefix`` stores the count at every prefix. Truncation and budget questions are
answered from these tables; no prefix is encoded again. Tables of pieces met before are
kept, up to a bound; a piece of more than ``LONG_PIECE`` bytes is counted by the library.

Defined cases: a null text counts as empty: 0 bytes and 0 tokens; special strings inside a
text are the tokens that the library makes of them by default; a very long text is counted
part by part, and only its table of cuts, one for each ``CUT_CHARS`` characters, is held; repeated
rows count each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm.byte_bpe import safe_parts
from foliant.llm.scratch import small_batches

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
CUT_CHARS = 2048
#: Bytes of a piece beyond which the library counts it, and pieces whose tables a worker keeps.
LONG_PIECE = 4096
KEPT_PIECES = 400_000


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


class PrefixCounter:
    def __init__(self, path: str, cut: int = CUT_CHARS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut = cut
        self.letters = byte_letters()
        self.ends = ahocorasick.Automaton()
        for token in self.tokenizer.get_vocab(with_added_tokens=False):
            self.ends.add_word(token, token)
        self.ends.make_automaton()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.blanks = regex.compile(r"\s+")
        self._stable: dict[tuple[str, str], bool] = {}
        self._pieces: dict[str, list[int]] = {}
        self._totals: dict[str, int] = {}

    def batch(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text its table: (characters, tokens before them) at every cut, the end included."""
        out = []
        for t in texts:
            table = [(0, 0)]
            for part in safe_parts(t, self.cut):
                chars, tokens = table[-1]
                table.append((chars + len(part), tokens + self.part_count(part)))
            out.append(table)
        return out

    def _ids_stable(self, a: str, b: str) -> bool:
        """Whether the library leaves tokens a, b as they are; a empty: whether it leaves b whole."""
        key = (a, b)
        if key not in self._stable:
            if len(self._stable) >= KEPT_PIECES:
                self._stable.clear()
            got = [t.value for t in self.tokenizer.model.tokenize(a + b)]
            self._stable[key] = got == ([a, b] if a else [b])
        return self._stable[key]

    def piece(self, piece: str) -> list[int]:
        """Counts at every byte prefix of one piece of the pre-splitting."""
        if piece in self._pieces:
            return self._pieces[piece]
        s = piece.encode().decode("latin-1").translate(self.letters)
        count, last = [0] * (len(s) + 1), [""] * (len(s) + 1)
        known, done = self._stable, 0
        for at, t in self.ends.iter(s):
            k = at + 1
            if k == done:
                continue
            j = k - len(t)
            stable = known.get((last[j], t))
            if stable is None:
                stable = self._ids_stable(last[j], t)
            if stable:
                count[k], last[k], done = count[j] + 1, t, k
        if len(self._pieces) >= KEPT_PIECES:
            self._pieces.clear()
        self._pieces[piece] = count
        return count

    def total(self, piece: str) -> int:
        """The count of a whole piece."""
        found = self._totals.get(piece)
        if found is None:
            long = len(piece) > LONG_PIECE
            found = len(self.tokenizer.encode(piece, add_special_tokens=False)) if long else self.piece(piece)[-1]
            self._pieces.pop(piece, None)
            if len(self._totals) >= KEPT_PIECES:
                self._totals.clear()
            if not long:
                self._totals[piece] = found
        return found

    def part_count(self, part: str) -> int:
        """The count of a text by dynamic programming over its pieces."""
        out, total = 0, self.total
        for i, segment in enumerate(self.special.split(part) if self.special else [part]):
            out += 1 if i % 2 else sum(map(total, self.pattern.findall(segment)))
        return out

    def prefixes(self, text: str) -> list[int]:
        """Counts at every prefix of the text, by characters, the empty one and the whole text included."""
        out, base = [0], 0
        for i, segment in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                # A special string not yet whole is plain text, and may go together with what precedes it.
                start = len(out) - 1
                out += [len(self.tokenizer.encode(text[: start + k], add_special_tokens=False)) for k in range(1, len(segment))]
                base += 1
                out.append(base)
                continue
            first, starts = len(out), {}
            for m in self.pattern.finditer(segment):
                piece, starts[m.start()] = m[0], base
                counts = self._by_character(piece)
                if piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():
                    # A contraction of two letters is one piece only when both are there.
                    counts = [self.total("'"), self.total("'") + self.total(piece[1]), counts[-1]]
                out += [base + c for c in counts]
                base += counts[-1]
            for m in self.blanks.finditer(segment):
                # Blanks at the end of a prefix are one piece, however the whole text goes on.
                for k, c in enumerate(self._by_character(m[0])):
                    out[first + m.start() + k] = starts[m.start()] + c
        return out

    def _by_character(self, piece: str) -> list[int]:
        counts, at, out = self.piece(piece), 0, []
        for ch in piece:
            at += len(ch.encode())
            out.append(counts[at])
        return out

    def at(self, text: str, table: list[tuple[int, int]], chars: int) -> int:
        """Tokens of text[:chars]."""
        chars = max(0, min(chars, len(text)))
        i = bisect.bisect_right(table, (chars, 1 << 62)) - 1
        start, before = table[i]
        return before + self.part_count(text[start:chars])

    def longest_within(self, text: str, table: list[tuple[int, int]], budget: int) -> int:
        """The largest number of characters, by bisection between two cuts, whose prefix keeps to the budget.

        Counts at prefixes may fall by a few when a character completes a longer token, so all
        prefixes after the last cut within the budget are looked at.
        """
        ok = [c for c, n in table if n <= budget]
        best = ok[-1] if ok else 0
        end = next((c for c, _ in table if c > best), len(text))
        return max([best, *(c for c in range(best + 1, end + 1) if self.at(text, table, c) <= budget)])


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _vocabulary(name: str) -> str:
    return name if "/" in name else public_tokenizers.path(name)


def prefix_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and the table of every text: array<struct<chars, tokens>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(_vocabulary(vocabulary))
        table = pa.list_(pa.struct([("chars", pa.int64()), ("tokens", pa.int64())]))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = b.slice(at, 256)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                cuts = c.batch(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array([x[-1][1] for x in cuts], pa.int64()),
                        pa.array([[{"chars": a, "tokens": n} for a, n in x] for x in cuts], table),
                    ],
                    [id_col, "n_bytes", "n_tokens", "cuts"],
                )

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, cuts array<struct<chars: bigint, tokens: bigint>>")


def every_prefix(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and counts: array<int>, the tokens of every prefix by characters, from the empty one to the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(_vocabulary(vocabulary))
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array([c.prefixes(row.column(1)[0].as_py() or "")], pa.list_(pa.int32()))], [id_col, "counts"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, counts array<int>")


def longest_prefix(counts: Column, budget: int | Column) -> Column:
    """Characters of the longest prefix that keeps to the budget, from the counts at every prefix."""
    fits = F.transform(counts, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: one row for each row of documents."""
    counts = prefix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counts.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {LIMIT} AS over_limit")
