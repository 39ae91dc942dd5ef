"""Alignment of two tokenizers' ids over the same bytes.

A text's tokens of both tokenizers are cut into groups at the byte offsets where tokens of both end; the two tokens that end there are linked.

Method: divide and conquer at shared cuts.  An interval holds tokens of A and of B that cover the same bytes.  The A token in its middle is
looked for among the ends of B by bisection, then its neighbours outwards; of an interval where none of these is shared all ends are looked for
and the shared one nearest to the middle is taken.  The interval is cut there and both halves are treated in the same way; one without a shared end
inside is a group.  All intervals of a lot of texts are halved at once, so a level costs a few array operations.

Tokens come from chunks that begin at a space after a visible character: neither tokenizer joins across one (``Pair`` checks the second
file for that; of the first it follows from its pattern).  A worker keeps the ids of the chunks it has met, and what it keeps is bounded.

Counts of linked pairs are summed over the corpus by Spark.  Of two tokens that end together one's bytes are the end of the other's, so
there are no more distinct pairs than ``Pair.most_links`` counts in the vocabularies, however large the corpus: the table may be broadcast.

Special cases: a text that is null or empty, or that either tokenizer doesn't give back byte by byte, has no tokens; names of special tokens
are plain text; texts of any length are encoded whole; rows that repeat an id are aligned and counted each; an empty table gives none;
further columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lumenqc.llm.common import listed, sole, written
from lumenqc.llm.tokens import Ragged

#: Chunks that a worker keeps (beyond, up to half stay, those met most often), the longest of them in bytes, those that are encoded in one line, and bytes of text that are aligned at once.
KEPT, LONGEST, LINE, LOT = 120_000, 200, 500, 700_000
#: So far from the middle ends are looked for one by one.
PROBES = 4
SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<bigint>, times array<int>"
GROUPS = ", a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"
BLANK = "▁"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else one from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = [bytes(letters[c] for c in self.a.id_to_token(k)) if all(c in letters for c in self.a.id_to_token(k)) else b"" for k in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(BLANK, " ").encode() for k, p in enumerate(pieces)]
        self.by_chunk = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_ids, self.b_ids = Ragged(), Ragged()
        self.lossy: set[int] = set()
        self.space = [self.b.piece_to_id(BLANK)]  # a space alone, which the library would leave out before an empty text
        digits = lambda n: np.frombuffer(b"".join(str(k).encode().ljust(7) for k in range(n)), np.uint8).reshape(n, 7)
        self.digits = digits(max(len(pieces), self.a.get_vocab_size()))

    def most_links(self) -> int:
        """How many pairs of ids can ever be linked: those of which one's bytes end the other's."""
        a, b = Counter(self.a_bytes), Counter(self.b_bytes)
        ends = lambda x: (x[k:] for k in range(len(x)))
        longer_a = sum(n * b[e] for x, n in a.items() for e in ends(x))
        return longer_a + sum(n * a[e] for x, n in b.items() for e in ends(x) if e != x)

    def singly(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of strings that begin with a space, and whether both give back their bytes."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = [ids or self.space for ids in self.b.encode([c[1:] for c in chunks], num_threads=1)]
        fine = [self.back(self.a_bytes, x) == c.encode() == self.back(self.b_bytes, y) for c, x, y in zip(chunks, a, b, strict=True)]
        return a, b, fine

    @staticmethod
    def back(table: list[bytes], ids: list[int]) -> bytes:
        return b"".join(map(table.__getitem__, ids))

    def learn(self, chunks: list[str]) -> None:
        """Keeps the ids of new, distinct chunks.  Those after which a text may be cut are encoded in lines of many."""
        odd = []
        if self.by_chunk:
            whole, ends = self.strung([*chunks, " ."])
            safe = np.isin(ends[:-1], self.cuts(whole))
            odd = [chunks[k] for k in np.flatnonzero(~safe)]
            chunks = [chunks[k] for k in np.flatnonzero(safe)] if odd else chunks
            for k in range(0, len(chunks), LINE):
                line = chunks[k : k + LINE]
                raw, ends = self.strung(line)
                a, b = self.a.encode("".join(line), add_special_tokens=False).ids, self.b.encode("".join(line)[1:])
                if not self.back(self.a_bytes, a) == bytes(raw) == self.back(self.b_bytes, b):
                    odd += line
                    continue
                for store, ids, sizes in ((self.a_ids, a, self.a_size), (self.b_ids, b, self.b_size)):
                    ids = np.array(ids, np.uint32)
                    store.add(line, ids, np.searchsorted(np.cumsum(sizes[ids]), ends) + 1)
        else:
            odd = chunks
        if odd:
            first = len(self.a_ids.number)
            a, b, fine = self.singly(odd)
            self.lossy.update(first + k for k, ok in enumerate(fine) if not ok)
            for store, ids in ((self.a_ids, a), (self.b_ids, b)):
                store.add(odd, np.fromiter((i for x in ids for i in x), np.uint32), np.cumsum([len(x) for x in ids]))

    @staticmethod
    def strung(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' bytes one after the other, and where each ends."""
        sizes = pc.binary_length(pa.array(chunks, pa.string())).to_numpy()
        return np.frombuffer("".join(chunks).encode(), np.uint8), np.cumsum(sizes, dtype=np.int64)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of space + text for each: A's and B's ids, where each text's end, and whether a text has tokens at all."""
        if len(self.a_ids.number) > KEPT:
            kept = self.a_ids.often(KEPT // 2)
            self.lossy = set(np.flatnonzero(np.isin(kept, np.fromiter(self.lossy, np.int64))).tolist())
            for store in (self.a_ids, self.b_ids):
                store.keep(kept)
        whole = np.frombuffer((" " + " ".join(texts)).encode(), np.uint8)
        sizes = np.array([len(t.encode()) + 1 for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        cuts = self.cuts(whole) if self.by_chunk else np.zeros(0, np.int64)
        marked = np.zeros(len(whole), bool)
        marked[starts] = marked[cuts] = True
        begins = np.flatnonzero(marked)
        ends = np.append(begins[1:], len(whole))
        chunks = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(whole)).astype(np.int32)), pa.py_buffer(whole))
        text_of = np.searchsorted(starts, begins, "right") - 1
        # long chunks are seldom met twice: they are not kept
        long = np.flatnonzero(ends - begins > LONGEST)
        found = pc.if_else(pa.array(ends - begins > LONGEST), pa.scalar(" "), chunks).dictionary_encode()
        names = listed(found.dictionary)
        number = self.a_ids.number
        numbers = np.fromiter(map(number.get, names, itertools.repeat(-1)), np.int64, len(names))
        lacking = np.flatnonzero(numbers < 0)
        if len(lacking):
            new = [names[k] for k in lacking.tolist()]
            self.learn(new)
            numbers[lacking] = list(map(number.__getitem__, new))
        self.a_ids.met[numbers] += 1
        rows = numbers[found.indices.to_numpy()]
        fine = np.ones(len(texts), bool)
        if self.lossy:
            fine[text_of[np.isin(rows, np.fromiter(self.lossy, np.int64))]] = False  # a space, which stands for long chunks, isn't
        made = []
        extra = self.singly(chunks.take(pa.array(long)).to_pylist()) if len(long) else ([], [], [])
        fine[text_of[long[~np.array(extra[2], bool)]]] = False
        for store, ids in ((self.a_ids, extra[0]), (self.b_ids, extra[1])):
            flat, last = store.gather(rows)
            parts = np.split(flat, last[:-1]) if len(long) else None
            if parts is not None:
                for k, x in zip(long.tolist(), ids, strict=True):
                    parts[k] = np.array(x, np.uint32)
                flat, last = np.concatenate(parts), np.cumsum([len(x) for x in parts])
            text_last = np.append(np.flatnonzero(np.diff(text_of)), len(text_of) - 1)
            kept = np.repeat(fine[text_of], np.diff(last, prepend=0))
            counts = np.diff(last[text_last], prepend=0) * fine
            made.append((flat[kept], np.cumsum(counts)))
        return made[0][0], made[1][0], made[0][1], made[1][1], fine

    @staticmethod
    def cuts(whole: np.ndarray) -> np.ndarray:
        """Places of spaces after a visible character.  After one whose bytes might be those of a kind of white space nothing is cut."""
        at = np.flatnonzero(whole[2:] == 0x20) + 2
        one, two = whole[at - 1], whole[at - 2]
        ascii_mark = (one > 0x20) & (one < 0x7F)
        pair = (one >= 0x80) & (two >= 0xC2) & (two < 0xE0) & ~((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
        longer = (one >= 0x80) & (two >= 0x80) & (two < 0xC0) & ~np.isin(two, (0x80, 0x81, 0x9A, 0xA0, 0xBB))
        return at[ascii_mark | pair | longer]

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])


def pair(a_path: str, b_path: str) -> Pair:
    """One pair of tokenizers in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return sole(("alignment", a_path, b_path), lambda: Pair(a_path, b_path))


def divided(a_ends: np.ndarray, b_ends: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last tokens of all groups, in order: places in ``a_ends`` and in ``b_ends``.

    ``a_ends``, ``b_ends``: ascending end offsets of the tokens of texts that follow one another; ``a_last``, ``b_last``: each text's last tokens, which end together.
    """
    cuts = [(a_last, b_last)]
    first = lambda last: np.concatenate((np.zeros(1, np.int64), last[:-1] + 1))[: len(last)]
    open_ = np.stack((first(a_last), a_last, first(b_last), b_last))  # first and last tokens; the last ones end together
    while open_.shape[1]:
        open_ = open_[:, (open_[1] > open_[0]) & (open_[3] > open_[2])]  # a single token can't be cut
        a0, a1, b0, b1 = open_
        middle = (a0 + a1 - 1) // 2
        at_a, at_b = np.full(len(a0), -1), np.full(len(a0), -1)
        left = np.arange(len(a0))
        for k in range(2 * PROBES + 1):
            off = (k + 1) // 2 * (1 if k % 2 else -1)
            seek = middle[left] + off
            some = (seek >= a0[left]) & (seek < a1[left])
            here, place = left[some], seek[some]
            found = np.searchsorted(b_ends, a_ends[place])  # ends ascend over all texts, so this stays in the interval
            same = b_ends[found] == a_ends[place]
            at_a[here[same]], at_b[here[same]] = place[same], found[same]
            left = left[at_a[left] < 0]
            if not len(left):
                break
        far = left[(a1 - a0)[left] > 2 * PROBES]
        if len(far):  # all ends of these intervals, and of those shared the nearest to the middle
            sizes = (a1 - a0)[far]
            owner = np.repeat(np.arange(len(far)), sizes)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + a0[far][owner]
            found = np.searchsorted(b_ends, a_ends[place])
            same = np.flatnonzero(b_ends[found] == a_ends[place])
            away = np.abs(place - middle[far][owner])[same]
            order = same[np.lexsort((away, owner[same]))]
            heads = order[np.unique(owner[order], return_index=True)[1]]
            at_a[far[owner[heads]]], at_b[far[owner[heads]]] = place[heads], found[heads]
        cut = at_a >= 0
        a0, a1, b0, b1, i, j = a0[cut], a1[cut], b0[cut], b1[cut], at_a[cut], at_b[cut]
        cuts.append((i, j))
        open_ = np.concatenate((np.stack((a0, i, b0, j)), np.stack((i + 1, a1, j + 1, b1))), axis=1)
    a_cuts = np.concatenate([x for x, _ in cuts])
    order = np.argsort(a_cuts)
    return a_cuts[order], np.concatenate([x for _, x in cuts])[order]


def spelled(two: Pair, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups as text, ``a1,a2|b1;`` each, in bytes; and the end of each group."""
    a_len, b_len = np.diff(a_cuts, prepend=-1), np.diff(b_cuts, prepend=-1)
    group_a, group_b = np.repeat(np.arange(len(a_cuts)), a_len), np.repeat(np.arange(len(b_cuts)), b_len)
    at_a = np.arange(len(a)) + np.concatenate((np.zeros(1, np.int64), b_cuts + 1))[group_a]
    at_b = np.arange(len(b)) + (a_cuts + 1)[group_b]
    ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    marks[at_a[a_cuts]], marks[at_b[b_cuts]] = ord("|"), ord(";")
    cells = np.empty((len(ids), 8), np.uint8)
    cells[:, :7], cells[:, 7] = two.digits[ids], marks
    used = cells != 0x20
    ends = np.cumsum(used.sum(1))
    return cells[used], ends[at_b[b_cuts]]


def aligned(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], groups: bool) -> Iterator[pa.RecordBatch]:
    two = pair(*paths)
    n_b = len(two.b_bytes)
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "").to_pylist()
        edges, size = [0], 0
        for k, t in enumerate(texts):
            size += len(t)
            if size > LOT or k + 1 == len(texts):
                edges.append(k + 1)
                size = 0
        for begin, end in zip(edges, edges[1:]):
            some = texts[begin:end]
            filled = [k for k, t in enumerate(some) if t]
            n = end - begin
            out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups")}
            shas, links, times = [""] * n, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int32)] * n
            whole = [[np.zeros(0, np.int32)] * n for _ in range(4)]
            if filled:
                a, b, a_last, b_last, fine = two.tokens([some[k] for k in filled])
                rows = np.array(filled)[fine]
                a_last, b_last = a_last[fine] - 1, b_last[fine] - 1
                a_ends, b_ends = two.ends(a, b)
                a_cuts, b_cuts = divided(a_ends, b_ends, a_last, b_last)
                last = np.searchsorted(a_cuts, a_last) + 1  # groups up to the end of each text
                out["n_a"][rows], out["n_b"][rows], out["n_groups"][rows] = (np.diff(x, prepend=-1) for x in (a_last, b_last, last - 1))
                said, ends = spelled(two, a, b, a_cuts, b_cuts)
                text_of = np.repeat(np.arange(len(rows)), np.diff(last, prepend=0))
                kinds, n_kind = np.unique((text_of << 34) | (a[a_cuts].astype(np.int64) * n_b + b[b_cuts]), return_counts=True)
                parts = np.searchsorted(kinds >> 34, np.arange(len(rows) + 1))
                g = lo = lo_a = lo_b = 0
                for k, row in enumerate(rows.tolist()):
                    hi = int(ends[last[k] - 1])
                    shas[row] = hashlib.sha256(said[lo : hi - 1]).hexdigest()
                    links[row], times[row] = kinds[parts[k] : parts[k + 1]] & ((1 << 34) - 1), n_kind[parts[k] : parts[k + 1]].astype(np.int32)
                    if groups:
                        upto = last[k]
                        cuts_of = ((a, lo_a, int(a_last[k]) + 1, a_cuts), (b, lo_b, int(b_last[k]) + 1, b_cuts))
                        for side, (ids, x, y, cuts) in enumerate(cuts_of):
                            whole[side][row], whole[2 + side][row] = ids[x:y].astype(np.int32), (cuts[g:upto] + 1 - x).astype(np.int32)
                        g, lo_a, lo_b = upto, int(a_last[k]) + 1, int(b_last[k]) + 1
                    lo = hi
            lists = lambda x, kind: pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), pa.array(np.concatenate(x), kind))
            columns = [batch.column("row")[begin:end], batch.column("doc_id")[begin:end], *map(pa.array, out.values()), pa.array(shas), lists(links, pa.int64()), lists(times, pa.int32())]
            names = ["row", "doc_id", *out, "groups_sha256", "links", "times"]
            if groups:
                columns += [lists(x, pa.int32()) for x in whole]
                names += ["a_ids", "b_ids", "a_ends", "b_ends"]
            yield pa.RecordBatch.from_arrays(columns, names)


def align(docs: DataFrame, a_path: str, b_path: str, groups: bool = True) -> DataFrame:
    """Documents (doc_id, text) by row: numbers of tokens and groups, the groups' digest and linked pairs with how often (a * |B| + b).

    With ``groups`` the ids of both tokenizers and the end of each group in them, too.
    """
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.mapInArrow(lambda batches: aligned(batches, (a_path, b_path), groups), SCHEMA + (GROUPS if groups else ""))


def link_counts(found: DataFrame, b_path: str) -> DataFrame:
    """How often each linked pair is linked in the corpus, and whether no pair of its B id is linked more often."""
    n_b = SentencePieceProcessor(model_file=b_path).get_piece_size()
    counts = found.select(F.inline(F.arrays_zip(F.col("links").alias("link"), F.col("times").alias("n")))).groupBy("link").agg(F.sum("n").alias("count"))
    counts = written(counts, "link-counts")
    most = counts.groupBy((F.col("link") % n_b).alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", F.col("link") % n_b).join(most, "b").select("link", "count", (F.col("count") == F.col("most")).alias("best"))


def judged(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Documents with their alignment in numbers: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    c = F.col
    found = written(align(docs, a_path, b_path, groups=False), "aligned")
    told = written(link_counts(found, b_path), "link-table")  # bounded by the vocabularies: see most_links
    kept = ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    each = found.select(*kept, F.inline_outer(F.arrays_zip(c("links").alias("link"), c("times").alias("n")))).join(F.broadcast(told), "link", "left")
    # all of ``kept`` follow from the row: as keys, unlike as first values, they let Spark sum without a sort
    sums = each.groupBy(*kept).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_links"),
        F.coalesce(F.sum(F.when(c("best"), c("n"))), F.lit(0)).alias("n_best"),
        F.coalesce(F.sum(c("n") * c("count")), F.lit(0)).alias("count_sum"),
    )
    return sums.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
