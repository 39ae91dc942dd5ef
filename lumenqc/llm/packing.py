"""Best-fit packing of documents into training sequences, by exact-complement hashing over length counts.

A plan needs the number of pieces of each length only, at most ``capacity`` numbers however large the corpus.
The longest pieces open sequences; a gap is closed by one, two or three lengths that fill it exactly, looked up
among the lengths and their pair sums and checked against what is still available; where none does, the longest
length that fits goes in (best fit) and the rest of the gap is tried again.  A pattern found is used as often
as its lengths allow, so each exhausts a length and there are at most ``capacity`` patterns.

Spark makes the pieces, counts lengths by task, ranks each piece within its length from those counts (no window
over a length, which may hold a third of all rows) and looks its place up in the plan.

Special cases: a null text counts as empty, so its document is the end id alone; repeated rows and ids are packed
each; very long texts are cut; pieces of one length are alike to the plan, so ties between them fall as the pieces were met;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenqc.llm import tokens
from lumenqc.llm.common import is_small, nothing_kept, written


@dataclass
class Plan:
    """Entries by length: pieces of that length ranked from ``first`` on, ``uses`` to a sequence, from sequence ``base`` on, at ``offset``."""

    spans: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sequences: int

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, uses, base, offset = self.spans[length]
        i = np.searchsorted(first, ranks, "right") - 1
        at = ranks - first[i]
        return base[i] + at // uses[i], offset[i] + at % uses[i] * length


class Counts:
    """How many pieces of each length are left, with the index of pair sums."""

    def __init__(self, counts: np.ndarray) -> None:
        self.n = counts.astype(np.int64)
        self.known = None

    def pairs(self) -> np.ndarray:
        """For each sum, whether two lengths at hand make it."""
        there = self.n > 0
        if self.known is None or (there != self.known).any():
            self.known, size = there, 1 << (2 * len(there)).bit_length()
            self.sums = np.fft.irfft(np.fft.rfft(there.astype(float), size) ** 2, size)[: len(there)] > 0.5
        return self.sums

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.n[gap] > 0 else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The two lengths of this sum of which most are left."""
        a = np.arange(1, gap // 2 + 1)
        least = np.minimum(self.n[a], self.n[gap - a])
        if gap % 2 == 0 and len(least):
            least[-1] = self.n[gap // 2] // 2
        if not len(least) or least.max() <= 0:
            return None
        i = int(np.argmax(least))
        return gap - (i + 1), i + 1

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """The first three lengths of this sum, the longest as long as can be."""
        a = np.arange(min(gap - 2, len(self.n) - 1), 0, -1)
        for x in a[(self.n[a] > 0) & self.pairs()[gap - a]].tolist():
            self.n[x] -= 1
            rest = self.pair(gap - x)
            self.n[x] += 1
            if rest:
                return (x, *rest)
        return None

    def best(self, gap: int) -> tuple[int, ...] | None:
        fits = np.flatnonzero(self.n[1 : gap + 1])
        return (int(fits[-1]) + 1,) if len(fits) else None


def plan(counts: np.ndarray, capacity: int) -> Plan:
    """counts[L]: pieces of length L, for L up to capacity."""
    left, found, sequences = Counts(counts), [], 0
    for longest in range(capacity, 0, -1):
        while left.n[longest]:
            used = {longest: 1}
            left.n[longest] -= 1
            gap = capacity - longest
            while gap:
                taken = left.single(gap) or left.pair(gap) or left.triple(gap) or left.best(gap)
                if taken is None:
                    break
                for x in taken:
                    used[x] = used.get(x, 0) + 1
                    left.n[x] -= 1
                gap -= sum(taken)
            again = min(int(left.n[x]) // k for x, k in used.items())
            for x, k in used.items():
                left.n[x] -= again * k
            found.append((used, again + 1))
    spans: dict[int, list[list[int]]] = {}
    ranked: dict[int, int] = {}
    for used, times in found:
        offset = 0
        for x, k in used.items():
            spans.setdefault(x, []).append([ranked.get(x, 0), k, sequences, offset])
            ranked[x] = ranked.get(x, 0) + k * times
            offset += k * x
        sequences += times
    return Plan({x: tuple(np.array(rows, np.int64).T) for x, rows in spans.items()}, sequences)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents' ids with the end id, cut where they are over capacity; ``rank`` counts the earlier pieces of the same length in the task."""
    kept = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = tokens.encoder(tokenizer_path).ids, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            found = enumerate(encode(batch.column(1)))
            while lot := list(itertools.islice(found, 500)):
                which, piece, start, length, crc, rank, cuts = [], [], [], [], [], [], []
                for k, ids in lot:
                    ids = np.concatenate((ids, end))
                    for p, at in enumerate(range(0, len(ids), capacity)):
                        cut = ids[at : at + capacity]
                        which.append(k)
                        piece.append(p)
                        start.append(at)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut))
                        rank.append(seen[len(cut)])
                        seen[len(cut)] += 1
                        cuts.append(cut)
                held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), pa.array(np.concatenate(cuts).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(which), pa.int32()), pa.array(rank, pa.int64()), held],
                    names=[id_col, "piece", "start", "length", "ids_crc32", "task", "rank", "ids"],
                )

    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, rank long, ids array<int>")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence, its place there and its ids: a sequence is its pieces' ids by offset."""
    cut = written(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    by_task = written(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[r.length] = r.n
    made = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    firsts = written(by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "firsts")
    # a row a length and task, so firsts grow with the pieces: they are broadcast while they were counted to be few, and pieces stay where they are
    ranked = cut.join(F.broadcast(firsts) if is_small(firsts) else firsts.hint("merge"), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("first"))

    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        nothing_kept()
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        out = np.zeros((2, len(lengths)), np.int64)
        order = np.argsort(lengths, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if len(at):
                out[:, at] = made.place(int(lengths[at[0]]), ranks[at])
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    # only lengths and ranks go to Python; ids stay where they are, or aren't read if they aren't asked for
    place = F.pandas_udf(placed, "sequence_id long, offset long")
    return ranked.withColumn("place", place("length", "rank")).select(id_col, "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset", "ids")
