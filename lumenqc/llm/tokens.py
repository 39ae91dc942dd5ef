"""Whole texts to ids with the tokenizers library.

The tokenizer's normaliser turns white space into one space and its pre-tokenizer never joins across it, so
the ids of a text are those of its chunks between white space in order (``splits_at_space`` checks the file for that).
Arrow cuts texts into chunks and numbers the distinct ones; each worker keeps the ids of the chunks that it has met,
and what it keeps is bounded: when that is full, those met in several lots stay; a text's ids are then gathered by number.

Of a new chunk in Latin-1 letters, digits and marks the pieces are found here, by the file's own pattern on the lower-cased
chunk (``plain_pieces`` checks the file for that); the library's byte-pair model then encodes distinct pieces alone, without
normalising and cutting them once more.  Any other chunk goes through the whole tokenizer.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumenqc.llm.common import listed, sole

#: Chunks and pieces that a worker keeps; beyond, up to half stay, those met most often.  Pieces are fewer and cost more to encode again.
CACHE, PIECE_CACHE = 250_000, 600_000
#: Bytes of text that are encoded at once.
LOT = 3_000_000
#: The normaliser and the pattern of pieces that ``plain_pieces`` looks for.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same in Latin-1, and blanks; and what chunks may not hold: other than visible characters that lower-casing keeps there and composition leaves alone.
LETTERS, NUMERALS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
PIECES = re.compile(f"\x20|'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMERALS}]|[^\\s{LETTERS}{NUMERALS}]+")
HARD = re.compile("[^\x20-~¡-¬®-ÿ]")

def splits_at_space(spec: dict) -> bool:
    """Whether the file's pre-tokenizer drops white space and its tokens can't hold any."""
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        bool(steps)
        and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        and not any(x.get("add_prefix_space") for x in steps)
        and not any(c.isspace() for x in spec["added_tokens"] for c in x["content"])
        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
    )


def plain_pieces(spec: dict) -> bool:
    """Whether the file lower-cases, cuts by ``PATTERN`` and marks the end of each piece."""
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS
        and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": PATTERN} and not steps[1]["use_regex"]
        and spec["model"]["type"] == "BPE" and bool(spec["model"]["end_of_word_suffix"]) and not spec["model"]["continuing_subword_prefix"]
    )


class Ragged:
    """Numbered rows of ids, to which rows are added; gathered by number."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.ends = np.zeros(1 << 16, np.uint32), np.zeros((1 << 12) + 1, np.int64)
        self.met = np.zeros(1 << 12, np.int32)  # by row: lots that asked for it

    def add(self, keys: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        n, used = len(self.number), int(self.ends[len(self.number)])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + len(keys) >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        while n + len(keys) > len(self.met):
            self.met = np.concatenate((self.met, np.zeros_like(self.met)))
        self.flat[used : used + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(keys)] = ends + used
        self.number.update(zip(keys, range(n, n + len(keys)), strict=True))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids, one after the other, and the end of each row."""
        begin = self.ends[rows]
        n = self.ends[rows + 1] - begin
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0)
        at += np.repeat(begin - ends + n, n)
        return self.flat[at], ends

    def often(self, most: int) -> np.ndarray:
        """The rows that more than one lot has asked for; at most so many, those asked for most."""
        met = self.met[: len(self.number)]
        rows = np.flatnonzero(met > 1)
        return rows if len(rows) <= most else np.sort(rows[np.argsort(-met[rows], kind="stable")[:most]])

    def keep(self, rows: np.ndarray) -> None:
        """Drops all but these rows, which are numbered anew and must be asked for again to stay once more."""
        keys = list(self.number)
        keys = [keys[k] for k in rows.tolist()]
        ids, ends = self.gather(rows)
        self.__init__()
        self.add(keys, ids, ends)
        self.met[: len(keys)] = 1


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"]}
        self.by_chunk = splits_at_space(spec)
        self.known, self.pieces, self.bare = Ragged(), Ragged(), None
        if self.by_chunk and plain_pieces(spec):
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.bare.model._resize_cache(0)  # its pieces are distinct
            end = spec["model"]["end_of_word_suffix"]
            self.ending = np.array([t.endswith(end) for t, _ in sorted(spec["model"]["vocab"].items(), key=lambda x: x[1])] + [False] * len(spec["added_tokens"]))

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[str]) -> None:
        """Keeps the ids of new, distinct chunks."""
        line, odd = " ".join(chunks), []
        if self.bare is None:
            odd, chunks = chunks, []
        elif HARD.search(line) or any(x in line for x in self.special):
            odd = [c for c in chunks if HARD.search(c) or any(x in c for x in self.special)]
            skipped = set(odd)
            chunks = [c for c in chunks if c not in skipped]
            line = " ".join(chunks)
        if odd:
            made = self.plain(odd)
            self.known.add(odd, np.concatenate(made), np.cumsum([len(x) for x in made]))
        if not chunks:
            return
        found = pa.array(PIECES.findall(line.lower() + " ")).dictionary_encode()
        numbers = self.numbered(self.pieces, listed(found.dictionary), self.learn_pieces)
        ids, ends = self.pieces.gather(numbers[found.indices.to_numpy()])
        blank = found.dictionary.index(" ").as_py()
        self.known.add(chunks, ids, ends[found.indices.to_numpy() == blank])

    def learn_pieces(self, pieces: list[str]) -> None:
        """Keeps the ids of new, distinct pieces; each ends in an id that says so.  The blank between chunks has none."""
        if " " in pieces:
            self.pieces.add([" "], np.zeros(0, np.uint32), np.zeros(1, np.int64))
            pieces = [p for p in pieces if p != " "]
        lots = [pieces[i : i + 500] for i in range(0, len(pieces), 500)]
        for lot, e in zip(lots, self.bare.encode_batch_fast([" ".join(x) for x in lots], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) != len(lot):
                raise ValueError("a piece doesn't end in one id that ends words")
            self.pieces.add(lot, ids, ends)

    def numbered(self, store: Ragged, keys: list[str], learn) -> np.ndarray:
        """The numbers of distinct keys in ``store``, which learns those that it lacks."""
        got = np.array(list(map(store.number.get, keys, itertools.repeat(-1))), np.int64)
        lacking = np.flatnonzero(got < 0)
        if len(lacking):
            new = [keys[k] for k in lacking.tolist()]
            learn(new)
            got[lacking] = list(map(store.number.__getitem__, new))
        store.met[got] += 1
        return got

    def flat_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and where each text's end; null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            made = self.plain(texts.to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *made]), np.cumsum([len(x) for x in made])
        for store, most in ((self.known, CACHE), (self.pieces, PIECE_CACHE)):
            if len(store.number) > most:
                store.keep(store.often(most // 2))
        words = pc.ascii_split_whitespace(texts)
        found = words.flatten().dictionary_encode()
        ids, ends = self.known.gather(self.numbered(self.known, listed(found.dictionary), self.learn)[found.indices.to_numpy()])
        last = np.cumsum(pc.list_value_length(words).to_numpy())
        return ids, np.concatenate((np.zeros(1, np.int64), ends))[last]

    def ids(self, texts: pa.Array | list[str | None], lots: int = 1) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; so many lots at once take more memory and look up fewer chunks."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        lot = np.cumsum(sizes, dtype=np.int64) // (LOT * lots)
        cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            ids, ends = self.flat_ids(texts.slice(a, b - a))
            yield from np.split(ids, ends[:-1]) if b > a else ()


def encoder(path: str) -> Encoder:
    """One encoder a file in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return sole(("tokens", path), lambda: Encoder(path))
