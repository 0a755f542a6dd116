"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts become arrays of codepoint classes. An automaton with eight states walks over them and tells where
a pre-token begins; it is run as an associative scan: every character is a function from state to state,
functions are composed block by block for all blocks at once, the blocks' functions are scanned, and a
second pass marks the beginnings. No regular expression is used. The slices between beginnings go through
pair merging, whose results are held for words that come again. Byte offsets of the tokens are kept.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import id_text, map_rows, tokenizer_path

#: What may follow an apostrophe that begins a pre-token.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, OTHER, WHITE = range(4)

# Symbols of the automaton: the class of a character, made finer by what follows it.
(S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_PREFIX, S_INNER, S_LAST, S_RESET) = range(9)
# States after a character: nothing open; in letters, numbers, others; after a space that belongs to what
# follows; in white space; one or two letters of a suffix to come.
(FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, SUFFIX1, SUFFIX2) = range(8)
STATES = 8
BLOCK = 128
WORDS_HELD = 300_000
#: Bytes over which a pre-token is merged by a heap.
LONG = 256
#: The cost of a pair that doesn't join.
NEVER = 1 << 30


@cache
def _classes() -> np.ndarray:
    """The class of every codepoint, by the tables of the library whose encoding is to be equalled.

    Python's unicodedata is of another Unicode version. An encoding of single bytes that matches one class
    alone gives back the codepoints of that class. Surrogates, which no UTF-8 text has, are OTHER.
    """
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        read = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = read.decode(read.encode_ordinary(every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token begins, for each symbol * STATES + state."""
    after = np.zeros((9, STATES), np.uint8)
    begins = np.ones((9, STATES), bool)
    for symbol, state, goes_on in ((S_LETTER, IN_LETTERS, (IN_LETTERS, AFTER_SPACE)), (S_NUMBER, IN_NUMBERS, (IN_NUMBERS, AFTER_SPACE)), (S_OTHER, IN_OTHERS, (IN_OTHERS, AFTER_SPACE)), (S_INNER, IN_WHITE, (IN_WHITE,)), (S_PREFIX, AFTER_SPACE, ()), (S_LAST, FRESH, ())):
        after[symbol] = state
        begins[symbol, list(goes_on)] = False
    after[S_LETTER, [SUFFIX2, SUFFIX1]] = SUFFIX1, FRESH
    begins[S_LETTER, [SUFFIX2, SUFFIX1]] = False
    for symbol, state in ((S_QUOTE1, SUFFIX1), (S_QUOTE2, SUFFIX2)):  # an apostrophe inside others or after a space is one of them
        after[symbol] = state
        after[symbol, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
        begins[symbol, [IN_OTHERS, AFTER_SPACE]] = False
    after[S_RESET] = FRESH
    begins[S_RESET] = False
    return after.reshape(-1), begins.reshape(-1)


def _symbols(codes: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Symbols of the characters; resets: positions that stand between texts."""
    kind = _classes()[codes]
    kind[resets] = WHITE  # for what comes before: as the end of a text
    at_end = np.zeros(len(codes) + 1, bool)
    at_end[resets] = at_end[-1] = True
    next_white = np.append(kind[1:] == WHITE, True)
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_INNER], np.uint8)[kind]
    out[(kind == WHITE) & ~next_white] = S_LAST
    out[(codes == 0x20) & ~next_white] = S_PREFIX
    quotes = np.flatnonzero((codes == 0x27) & ~next_white)
    if len(quotes):
        wide = np.append(codes, np.zeros(2, codes.dtype))
        one, two = wide[quotes + 1], wide[quotes + 2]
        for suffix in SUFFIXES:
            hit = one == ord(suffix[0])
            if len(suffix) == 2:
                hit &= two == ord(suffix[1])
            out[quotes[hit]] = S_QUOTE1 if len(suffix) == 1 else S_QUOTE2
    out[resets] = S_RESET
    return out


def _compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    return np.take_along_axis(then, first.astype(np.intp), axis=1)


def _scan(symbols: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each symbol."""
    after, begins = _automaton()
    blocks = -(-len(symbols) // BLOCK)
    grid = np.full(blocks * BLOCK, S_RESET, np.int16)
    grid[: len(symbols)] = symbols
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T) * STATES
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for row in grid:  # the function of each block
        whole = after[row[:, None] + whole]
    step = 1
    while step < blocks:  # inclusive scan of the functions by doubling
        whole[step:] = _compose(whole[:-step].copy(), whole[step:])
        step *= 2
    state = np.concatenate((np.array([FRESH], np.uint8), whole[:-1, FRESH]))
    marks = np.empty((BLOCK, blocks), bool)
    for j, row in enumerate(grid):
        at = row + state
        marks[j] = begins[at]
        state = after[at]
    return marks.T.reshape(-1)[: len(symbols)]


def pre_tokens(texts: list[str]) -> list[list[str]]:
    """The pre-tokens of each text, in order; together they are the text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1)
    if not len(texts) or not sizes.sum():
        return [[] for _ in texts]
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero(_scan(_symbols(codes, ends - 1)))
    firsts = np.searchsorted(starts, np.append(0, ends)).tolist()
    flat = _cut(joined, codes, starts)
    out = []
    for a, b, end in zip(firsts, firsts[1:], ends.tolist()):
        own = flat[a:b]
        if own:
            own[-1] = joined[starts[b - 1] : end - 1]  # without what parts the texts
        out.append(own)
    return out


def _cut(joined: str, codes: np.ndarray, starts: np.ndarray) -> list[str]:
    """The slices from each start to the next: by a mark that the text lacks, if there is one."""
    mark = next((c for c in range(1, 9) if chr(c) not in joined), None)
    if mark is None:
        at = starts.tolist()
        return list(map(joined.__getitem__, map(slice, at, [*at[1:], len(joined)])))
    return np.insert(codes, starts, mark).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split(chr(mark))[1:]


@dataclass(frozen=True)
class Encoded:
    """ids of the tokens and the byte at which each begins; offsets has one more, the end."""

    ids: np.ndarray
    offsets: np.ndarray


class ByteBpe:
    """A byte-level BPE given as ranks (base64 of the bytes, a space and the rank on every line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.decimal = [b"%d," % i for i in range(len(self.bytes_of))]
        self.held = _Held()
        self.pairs = _Pairs(ranks)

    def _merge_many(self, raws: list[bytes]) -> list[list[int]]:
        """Of every word: join the adjacent pair of lowest rank, the leftmost of equals, until none joins.

        All words take a step at once; those that are ready leave.
        """
        ids = self.single[np.frombuffer(b"".join(raws), np.uint8)]
        word = np.repeat(np.arange(len(raws)), [len(r) for r in raws])
        done_ids, done_word = [], []
        while len(ids):
            cost = np.append(self.pairs(ids[:-1], ids[1:]), NEVER)
            first = np.append(True, word[1:] != word[:-1])
            starts = np.flatnonzero(first)
            cost[starts[1:] - 1] = NEVER
            least = np.minimum.reduceat(cost, starts)
            runs = np.diff(np.append(starts, len(ids)))
            ready = np.repeat(least == NEVER, runs)
            done_ids.append(ids[ready])
            done_word.append(word[ready])
            at = np.flatnonzero((cost == np.repeat(least, runs)) & ~ready)
            at = at[np.append(True, word[at][1:] != word[at][:-1])] if len(at) else at
            ids[at] = cost[at]
            stay = ~ready
            stay[at + 1] = False
            ids, word = ids[stay], word[stay]
        word = np.concatenate(done_word) if done_word else np.array([], int)
        flat = (np.concatenate(done_ids) if done_ids else word)[np.argsort(word, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(word, minlength=len(raws))).tolist()
        return [flat[x:y] for x, y in zip([0, *ends], ends)]

    def _pair(self, a: int, b: int) -> int:
        return self.ranks.get(self.bytes_of[a] + self.bytes_of[b], NEVER)

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same by a heap and links, so that a slice of any length takes n log n steps."""
        import heapq

        ids = self.single[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(c, i, ids[i], ids[i + 1]) for i in range(n - 1) if (c := self._pair(ids[i], ids[i + 1])) < NEVER]
        heapq.heapify(heap)
        while heap:
            cost, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = cost, False, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (c := self._pair(ids[x], ids[y])) < NEVER:
                    heapq.heappush(heap, (c, x, ids[x], ids[y]))
        return [t for t, there in zip(ids, alive) if there]

    def encode_lists(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each whole text; null is empty."""
        if len(self.held) >= WORDS_HELD:
            self.held.clear()
        collects = gc.isenabled()
        gc.disable()  # nothing here is circular, and the many small lists would set it going again and again
        try:
            rows = [list(map(self.held.__getitem__, words)) for words in pre_tokens([t or "" for t in texts])]
            self._fill()
            return [list(chain.from_iterable(row)) for row in rows]
        finally:
            if collects:
                gc.enable()

    def _fill(self) -> None:
        """Merge the words met for the first time into the lists that already stand for them."""
        many = []
        for word, ids in self.held.new:
            raw = word.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                ids.append(whole)
            elif len(raw) > LONG:
                ids += self._merge_long(raw)
            else:
                many.append((ids, raw))
        self.held.new = []
        if many:
            for (ids, _), merged in zip(many, self._merge_many([r for _, r in many])):
                ids += merged

    def encode(self, texts: list[str | None]) -> list[Encoded]:
        """Encode each whole text with the byte offsets of its tokens; null is empty."""
        found = [np.array(ids, np.int32) for ids in self.encode_lists(texts)]
        return [Encoded(ids, np.concatenate((np.zeros(1, np.int64), np.cumsum(self.sizes[ids])))) for ids in found]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def written(self, ids: list[int]) -> bytes:
        """The ids in decimal, joined by commas."""
        return b"".join(map(self.decimal.__getitem__, ids))[:-1]

    def decode_span(self, encoded: Encoded, first: int, last: int) -> bytes:
        """Bytes first..last of the text, from the tokens that touch them alone."""
        a, b = np.searchsorted(encoded.offsets, (first, last), side="right")
        a = max(int(a) - 1, 0)
        got, at = self.decode(encoded.ids[a:b].tolist()), int(encoded.offsets[a])
        return got[first - at : last - at]


class _Held(dict):
    """Word -> its ids. A word that is new gets an empty list, to be filled before it is read."""

    def __init__(self):
        self.new: list[tuple[str, list[int]]] = []

    def __missing__(self, word: str) -> list[int]:
        ids = self[word] = []
        self.new.append((word, ids))
        return ids


class _Pairs:
    """Ranks of pairs of tokens that join, in a hash table with linear probing over arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[piece[:i]] << 20 | ranks[piece[i:]], rank) for piece, rank in ranks.items() for i in range(1, len(piece)) if piece[:i] in ranks and piece[i:] in ranks]
        key, cost = np.array(found, np.int64).reshape(-1, 2).T
        self.bits = max(4, int(len(found) * 4).bit_length())
        self.key, self.cost = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int64)
        at, self.probes = self._home(key), 0
        while len(key):  # who finds a free place takes it, the others move on
            free = np.flatnonzero(self.key[at] < 0)
            _, chosen = np.unique(at[free], return_index=True)
            taken = free[chosen]
            self.key[at[taken]], self.cost[at[taken]] = key[taken], cost[taken]
            rest = np.ones(len(key), bool)
            rest[taken] = False
            key, cost, at = key[rest], cost[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at, out = self._home(key), np.full(len(key), NEVER, np.int64)
        open_ = np.arange(len(key))
        for _ in range(self.probes):
            there = self.key[at]
            hit = there == key
            out[open_[hit]] = self.cost[at[hit]]
            on = ~hit & (there >= 0)
            if not on.any():
                break
            open_, key, at = open_[on], key[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


@cache
def _loaded(name: str) -> ByteBpe:
    return ByteBpe(tokenizer_path(name))


def encode_rows(docs: DataFrame, tokenizer: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, ids, offsets of every row. A null text is empty: no ids, offsets [0]. Rows that repeat are encoded alike."""

    def of(part: pa.RecordBatch) -> dict:
        found = _loaded(tokenizer).encode(part.column("text").to_pylist())
        return {"doc_id": part.column("doc_id"), "ids": [e.ids for e in found], "offsets": [e.offsets for e in found]}

    return map_rows(id_text(docs), "text", of, "doc_id long, ids array<int>, offsets array<long>")


def decode_rows(encoded: DataFrame, tokenizer: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id and the bytes that `ids` stand for; null ids give no bytes."""

    def run(batches):
        for batch in batches:
            bpe = _loaded(tokenizer)
            raw = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def round_trips(docs: DataFrame, tokenizer: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encode and decode give, without moving the ids out of the task."""

    def of(part: pa.RecordBatch) -> dict:
        bpe = _loaded(tokenizer)
        found = bpe.encode_lists(part.column("text").to_pylist())
        return {
            "doc_id": part.column("doc_id"),
            "n_tokens": list(map(len, found)),
            "ids_sha256": [hashlib.sha256(bpe.written(ids)).hexdigest() for ids in found],
            "decoded_sha256": [hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in found],
        }

    return map_rows(id_text(docs), "text", of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
