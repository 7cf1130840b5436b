"""Best-fit packing of token sequences by a configuration linear program.

Every text becomes the ids of its tokens and an end id; only one longer than a sequence is cut, into
whole sequences after a first piece of what is left. What is packed is the histogram of the
pieces' lengths, of at most ``CAPACITY`` rows, so the program is solved on the driver whatever the
number of documents. A configuration is a set of lengths that fit one sequence; the program asks for
the fewest configurations that hold all pieces. Multiplicative weights are kept as prices of the
lengths: a knapsack over the prices, by dynamic programming, gives the most valuable configuration,
which is used as often as part of its scarcest length allows, and the prices of what it holds fall
with the share that is packed. Prices bound the number of sequences from below. Multiplicities are then
rounded down, and what is left, with gaps and lengths too small for the program, is filled by best
fit: the longest length first, then what fills the gap exactly with one or two lengths, else the
longest that fits.

Pieces are numbered by length within the task that makes them, and where a task's numbers begin
follows from sums of counts, so that no group of pieces of one length is ever put in order.

Defined cases: a null text counts as empty and has the end id alone; special strings inside a text are
the tokens that the library makes of them by default; a very long text is encoded part by part; repeated
rows and null ids are packed each; an empty table gives an empty result; extra columns are not read.
Which of several pieces of one length takes which place is open; every run packs all.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.byte_bpe import safe_parts
from foliant.llm.scratch import Scratch
from foliant.llm.token_counts import byte_letters

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 0
#: Lengths below one in so many of the capacity are left to fill gaps; knapsacks end after so many rounds.
FINE = 32
ROUNDS = 2000
#: Part of the scarcest length's rest that a round packs, and how far the price of a packed length falls.
STEP = 0.5
RATE = 3.0
#: Phases and plans are good enough this close to the bound; the power to which prices follow what was paid.
CLOSE = 0.0005
LEARN = 0.5
#: Phases without gain after which prices are taken as settled, and how often the plans solve the program.
PATIENCE = 20
SOLVES = (1, 4, 0)


class Encoder:
    """The ids of a byte-level BPE vocabulary of the tokenizers library, without its slower caches."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        special = {t["content"]: t["id"] for t in made["added_tokens"]}
        letters = {letter: b for b, letter in byte_letters().items()}
        ranks = {bytes(letters[c] for c in token): i for token, i in made["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str, end: int | None = None) -> np.ndarray:
        parts = [np.array(self.encoding.encode(p, allowed_special="all"), dtype="<u4") for p in safe_parts(text)]
        return np.concatenate(parts if end is None else [*parts, np.array([end], dtype="<u4")])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def knapsack(prices: np.ndarray, capacity: int, least: int) -> tuple[list[int], float]:
    """Lengths, repeats allowed, of the greatest total price that fit the capacity, and that price; only lengths from ``least`` on count."""
    price = np.where(prices > 0, prices, -np.inf)
    # The best values of smaller capacities, backwards, with nothing before 0.
    back = np.full(2 * capacity + 1, -np.inf)
    back[capacity - least + 1 : capacity + 1] = 0.0
    # No length is below ``least``, so so many capacities at a time follow from smaller ones.
    for lo in range(least, capacity + 1, least):
        hi = min(lo + least, capacity + 1) - 1
        windows = np.lib.stride_tricks.sliding_window_view(back[capacity - hi + least : capacity - lo + hi + 1], hi - least + 1)
        value = (windows + price[least : hi + 1]).max(axis=1)
        value[-1] = max(value[-1], back[capacity - lo + 1])
        back[capacity - hi : capacity - lo + 1] = np.maximum.accumulate(value[::-1])[::-1]
    best, out, left = back[capacity::-1], [], capacity
    while left >= least:
        value = best[left - least :: -1][: left - least + 1] + price[least : left + 1]
        i = int(value.argmax())
        if value[i] <= 0:
            break
        out.append(i + least)
        left -= i + least
    return out, float(best[capacity])


@dataclass
class Plan:
    """Configurations (lengths, copies), and bounds on the number of sequences from below."""

    capacity: int
    configurations: list[tuple[tuple[int, ...], int]] = field(default_factory=list)
    bound: float = 0.0

    @property
    def sequences(self) -> int:
        return sum(copies for _, copies in self.configurations)


def _phase(demand: np.ndarray, prices: np.ndarray, capacity: int, fine: int, rounds: int) -> tuple[dict[tuple[int, ...], float], np.ndarray, float, int]:
    """One pass over the demand at given prices: configurations and how often, what is left, the worth of the best one, rounds."""
    left, now, used, worth, turn = demand.copy(), prices.copy(), {}, 0.0, 0
    for turn in range(1, rounds + 1):
        c, value = knapsack(np.where(left > 0, now, 0.0), capacity, fine)
        if not c:
            break
        worth = max(worth, value)
        holds = Counter(c)
        times = min(left[i] / n for i, n in holds.items())
        times = times * STEP if times > 2 else times
        key = tuple(sorted(c, reverse=True))
        used[key] = used.get(key, 0.0) + times
        for i, n in holds.items():
            left[i] = max(left[i] - times * n, 0.0)
            left[i] = 0.0 if left[i] < 1e-9 else left[i]
            now[i] = prices[i] * np.exp(-RATE * (1 - left[i] / demand[i]))
    return used, left, worth, turn


def _fractional(rest: np.ndarray, capacity: int, fine: int, rounds: int) -> tuple[dict[tuple[int, ...], float], float]:
    """How often the program uses each configuration, and a lower bound on all.

    A phase packs the demand once. After it the price of each length is multiplied by what its pieces
    paid where they were packed: the dearer the poorer their configurations. Where all configurations
    in use are worth as much as the best one, both they and the prices are optimal.
    """
    demand = rest.astype(float)
    demand[:fine] = 0
    prices = np.where(demand > 0, np.arange(len(demand), dtype=float), 0.0)
    kept: tuple[float, dict[tuple[int, ...], float]] = (np.inf, {})
    bound, idle = float(demand @ prices) / capacity, 0
    while rounds > 0 and idle < PATIENCE and demand.any():
        used, left, worth, turns = _phase(demand, prices, capacity, fine, rounds)
        rounds -= turns
        # The number of sequences is at least what all pieces are worth, by what one sequence can be.
        bound = max(bound, float(demand @ prices) / worth)
        cost = sum(used.values()) + float(left @ prices) / worth
        idle = 0 if cost < kept[0] * (1 - CLOSE / 10) else idle + 1
        if cost < kept[0]:
            kept = (cost, used)
        if kept[0] <= bound * (1 + CLOSE):
            break
        paid, packed_ = np.zeros_like(prices), np.zeros_like(prices)
        for c, times in used.items():
            dear = worth / sum(prices[i] for i in c)
            for i, n in Counter(c).items():
                paid[i] += times * n * dear
                packed_[i] += times * n
        prices = prices * np.where(packed_ > 0, paid / np.maximum(packed_, 1e-12), 1.0) ** LEARN
    return kept[1], bound


def _filling(gap: int, rest: np.ndarray) -> list[int]:
    """Lengths that are there to fill a gap: exactly by one or two, else the longest that fits, and on."""
    out: list[int] = []
    here = rest[: gap + 1].copy()
    while gap > 0:
        if here[gap] > 0:
            return [*out, gap]
        half = gap // 2
        pairs = (here[1 : half + 1] > 0) & (here[gap - 1 : gap - half - 1 : -1] > 0)
        if gap % 2 == 0 and half and here[half] < 2:
            pairs[half - 1] = False
        small = int(pairs.argmax()) + 1 if pairs.any() else 0
        if small:
            return [*out, gap - small, small]
        fits = np.flatnonzero(here[: gap + 1] > 0)
        if not len(fits):
            break
        out.append(int(fits[-1]))
        here[fits[-1]] -= 1
        gap -= out[-1]
    return out


class _Rest:
    """Pieces that are not packed yet, by length, and the configurations of the others."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.n, self.made = np.zeros(capacity + 1, dtype=np.int64), []
        for length, n in histogram.items():
            self.n[length] += n

    def put(self, base: tuple[int, ...], copies: int) -> None:
        """At most so many copies of a configuration, as far as its lengths are still there, gaps filled."""
        holds = Counter(base)
        copies = min([copies, *(int(self.n[i]) // n for i, n in holds.items())])
        for i, n in holds.items():
            self.n[i] -= n * copies
        gap = len(self.n) - 1 - sum(base)
        while copies:
            more = Counter(_filling(gap, self.n))
            n = min([copies, *(int(self.n[i]) // k for i, k in more.items())])
            for i, k in more.items():
                self.n[i] -= k * n
            self.made.append((tuple(sorted([*base, *more.elements()], reverse=True)), n))
            copies -= n

    def begin(self, length: int) -> None:
        """As many copies as there can be of the best filling around one piece."""
        self.n[length] -= 1
        holds = Counter([length, *_filling(len(self.n) - 1 - length, self.n)])
        self.n[length] += 1
        copies = min(int(self.n[i]) // n for i, n in holds.items())
        for i, n in holds.items():
            self.n[i] -= n * copies
        self.made.append((tuple(sorted(holds.elements(), reverse=True)), copies))


def pack(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None) -> Plan:
    """A plan that holds every piece of the histogram (length to count) once.

    Several plans are made: the program is solved ``solves`` times, each time for what rounding left, before
    the rest is filled; the one of the fewest sequences stays.
    """
    rounds = ROUNDS if rounds is None else rounds
    total = sum(length * n for length, n in histogram.items())
    bound, best = float(-(-total // capacity)), None
    for solves in SOLVES:
        rest = _Rest(histogram, capacity)
        for turn in range(solves):
            used, least = _fractional(rest.n, capacity, max(1, capacity // FINE), rounds // 2 // (turn + 1))
            bound = bound if turn else max(bound, least)
            for c, times in sorted(used.items(), key=lambda x: (-x[1], x[0])):
                rest.put(c, int(times + (0.5 if turn else 0.0)))
        for length in range(capacity, 0, -1):
            while rest.n[length]:
                rest.begin(length)
        plan = Plan(capacity, rest.made)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences <= np.ceil(bound * (1 + CLOSE) - 1e-6):
            break
    best.bound = bound
    return best


class Places:
    """Where the pieces of each length, numbered from 0, stand in a plan's sequences."""

    def __init__(self, plan: Plan) -> None:
        rows, used, first = [], Counter(), 0
        for lengths, copies in plan.configurations:
            at = 0
            for length, n in sorted(Counter(lengths).items(), reverse=True):
                rows.append((length, used[length], n, first, at))
                used[length] += n * copies
                at += n * length
            first += copies
        rows.sort()
        self.length, self.number, self.each, self.first, self.at = (np.array(c, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else [[]] * 5))
        self.keys = self._key(self.length, self.number)

    @staticmethod
    def _key(length: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (length << np.int64(44)) | number

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        i = np.searchsorted(self.keys, self._key(length, number), side="right") - 1
        turn = number - self.number[i]
        return self.first[i] + turn // self.each[i], self.at[i] + turn % self.each[i] * length


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece, with its task and its number among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        task, met = TaskContext.get().partitionId(), Counter()
        for b in batches:
            rows = []
            for r in range(b.num_rows):
                ids = e.ids(b.column(1)[r].as_py() or "", end)
                # A first piece of what whole sequences leave, then these.
                cuts = [*range(len(ids) % capacity, len(ids) + 1, capacity)]
                cuts = [0, *cuts] if cuts[0] else cuts
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((r, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), met[hi - lo]))
                    met[hi - lo] += 1
            at, *rest = zip(*rows, strict=True) if rows else [()] * 6
            longs = [pa.array(c, pa.int64()) for c in rest]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), longs[0].cast(pa.int32()), *longs[1:], pa.array([task] * len(rows), pa.int32())], [id_col, "piece", "start", "length", "ids_crc32", "number", "task"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, number bigint, task int")


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    scratch = Scratch(docs.sparkSession, "packing")
    items = scratch.save(pieces(docs, vocabulary, id_col, text_col, capacity, end), "pieces")
    parts = scratch.save(items.groupBy("task", "length").agg(F.count("*").alias("n")), "parts")
    places = Places(pack({r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rows = items.join(starts, ["task", "length"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("_before")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.find(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(place, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: one row for each piece of each row of documents."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
