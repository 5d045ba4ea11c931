"""Byte-level BPE encoding and decoding.

Texts become arrays of code points, each code point a class (letter, number, white space, other; with
a look ahead for white space and contractions). A small automaton over the classes tells where pieces begin.
It isn't run character by character: every class is a function from states to states, composing such
functions is associative, and the few functions that compositions can reach are numbered, so that a blocked
prefix scan of table look-ups gives the state before every character at once. The slices between boundaries
are merged by rank, with a cache of the slices seen, and the byte offset of every token is kept for decoding.

Defined results: a null text is encoded as an empty one (no tokens); repeated rows are encoded each; texts of
any length go through in blocks that end at piece boundaries.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LETTER, NUMBER, OTHER, QUOTE_1, QUOTE_2, WHITE, SPACE_LAST, WHITE_LAST = range(8)
FIRST = 8  # added to the class of a text's first character
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_SPACE, LEFT_1, LEFT_2 = range(8)
#: Unicode's White_Space characters.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 1 << 18
CACHED = 600_000


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """The class of each code point without look ahead."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    kinds[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = LETTER
    kinds[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "N"]] = NUMBER
    kinds[WHITE_SPACE] = WHITE
    return kinds


def step(state: int, kind: int) -> tuple[int, bool]:
    """The automaton: the next state, and whether a piece begins at the character."""
    if kind >= FIRST:
        return step(NONE, kind - FIRST)
    if state in (LEFT_1, LEFT_2):  # within a contraction
        return (LEFT_1 if state == LEFT_2 else NONE), False
    if kind in (QUOTE_1, QUOTE_2):
        return (IN_OTHERS, False) if state in (IN_OTHERS, AFTER_SPACE) else (LEFT_1 if kind == QUOTE_1 else LEFT_2, True)
    if kind == SPACE_LAST:
        return AFTER_SPACE, True
    if kind == WHITE_LAST:
        return NONE, True
    into = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, WHITE: IN_WHITE}[kind]
    return into, state != into and not (state == AFTER_SPACE and kind != WHITE)


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each class's function, composition table, result from NONE, whether a piece begins by state and class)."""
    kinds = range(2 * FIRST)
    functions = {tuple(range(8)): 0}
    single = [functions.setdefault(tuple(step(s, k)[0] for s in range(8)), len(functions)) for k in kinds]
    done = 0
    while done < len(functions):  # close under composition
        for f in list(functions)[done:]:
            done += 1
            for k in kinds:
                functions.setdefault(tuple(step(s, k)[0] for s in f), len(functions))
    order = list(functions)
    table = np.array([[functions[tuple(g[s] for s in f)] for g in order] for f in order], np.uint16)
    begins = np.array([[step(s, k)[1] for k in kinds] for s in range(8)])
    return np.array(single, np.uint16), table, np.array([f[NONE] for f in order], np.uint8), begins


def scan(functions: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix compositions (each with all before it), by blocks: within blocks side by side, then over block totals."""
    n = len(functions)
    if n <= 256:
        out = functions.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    width = 64
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)  # 0 is the identity
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for i in range(1, width):
        grid[i] = table[grid[i - 1], grid[i]]
    totals = scan(grid[-1].copy(), table)
    before = np.concatenate([np.zeros(1, np.uint16), totals[:-1]])
    return np.ascontiguousarray(table[before[None, :], grid].T).reshape(-1)[:n]


def piece_starts(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces begin. codes: code points of texts one after another; firsts: where each text begins."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kinds = code_point_classes()[codes]
    first = np.zeros(n + 3, bool)
    first[firsts], first[n:] = True, True
    white = np.ones(n + 1, bool)
    white[:n] = kinds == WHITE
    goes_on = ~(white[1:] | first[1 : n + 1])  # the next character is of the same text and not white space
    kinds[white[:n] & goes_on] = WHITE_LAST
    kinds[(codes == 32) & goes_on] = SPACE_LAST
    quotes = np.flatnonzero(codes == 39)
    if len(quotes):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        a, b = padded[quotes + 1], padded[quotes + 2]
        inside_1 = ~first[quotes + 1]
        inside_2 = inside_1 & ~first[quotes + 2]
        is_ = lambda x, c: x == ord(c)
        kinds[quotes[inside_1 & (is_(a, "s") | is_(a, "t") | is_(a, "m") | is_(a, "d"))]] = QUOTE_1
        kinds[quotes[inside_2 & ((is_(a, "r") & is_(b, "e")) | (is_(a, "v") & is_(b, "e")) | (is_(a, "l") & is_(b, "l")))]] = QUOTE_2
    kinds[firsts] += FIRST
    single, table, from_none, begins = automaton()
    states = from_none[scan(single[kinds], table)]
    before = np.concatenate([np.zeros(1, np.uint8), states[:-1]])
    return np.flatnonzero(begins[before, kinds])


def slices(texts: list[str]) -> Iterator[tuple[list[str], list[tuple[int, int, int]]]]:
    """Blocks of pieces in order, with (place of the text, first piece, end) of the texts in it; a long text takes several blocks."""
    held: list[int] = []
    size = 0
    for i, text in enumerate([*texts, None]):
        if held and (text is None or size + len(text) > BLOCK):
            yield from together([(j, texts[j]) for j in held])
            held, size = [], 0
        if text is not None and len(text) > BLOCK:
            yield from by_blocks(i, text)
        elif text:
            held.append(i)
            size += len(text)


def together(some: list[tuple[int, str]]) -> Iterator[tuple[list[str], list[tuple[int, int, int]]]]:
    joined = "".join(t for _, t in some)
    firsts = np.concatenate([[0], np.cumsum([len(t) for _, t in some])])
    starts = piece_starts(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), firsts[:-1])
    cuts = np.searchsorted(starts, firsts).tolist()
    places = [*starts.tolist(), len(joined)]
    pieces = [joined[a:b] for a, b in zip(places, places[1:], strict=False)]
    yield pieces, [(i, a, b) for (i, _), a, b in zip(some, cuts, cuts[1:], strict=False)]


def by_blocks(i: int, text: str) -> Iterator[tuple[list[str], list[tuple[int, int, int]]]]:
    at, width = 0, BLOCK
    while at < len(text):
        part = text[at : at + width + 3]  # the look ahead
        starts = piece_starts(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), np.array([0])).tolist()
        if at + width < len(text):
            starts = [s for s in starts if s <= width]
            if len(starts) < 2:  # one piece fills the block
                width *= 2
                continue
        else:
            starts.append(len(part))
        yield [part[a:b] for a, b in zip(starts, starts[1:], strict=False)], [(i, 0, len(starts) - 1)]
        at, width = at + starts[-1], BLOCK


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of lowest rank is merged, the leftmost first, until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    return merged_short(piece, ranks) if len(piece) <= 64 else merged_long(piece, ranks)


def merged_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """By a list of the ranks of neighbours: time is quadratic, but least for words."""
    never = len(ranks) + 1
    cuts = list(range(len(piece) + 1))
    pair = [ranks.get(piece[i : i + 2], never) for i in range(len(piece) - 1)]
    while pair and (least := min(pair)) < never:
        i = pair.index(least)
        del cuts[i + 1], pair[i]
        if i < len(pair):
            pair[i] = ranks.get(piece[cuts[i] : cuts[i + 2]], never)
        if i:
            pair[i - 1] = ranks.get(piece[cuts[i - 1] : cuts[i + 1]], never)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """By a heap of pairs over linked parts."""
    n = len(piece)
    after, ends = list(range(1, n + 1)), list(range(1, n + 1))  # the part at i covers piece[i:ends[i]]
    before = list(range(-1, n - 1))
    pairs = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(pairs)
    while pairs:
        _, i, end = heapq.heappop(pairs)
        j = after[i] if ends[i] else n
        if j >= n or ends[j] != end:  # one of the two has changed since
            continue
        ends[i], after[i], ends[j] = end, after[j], 0
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(piece[i : ends[after[j]]])) is not None:
                heapq.heappush(pairs, (r, i, ends[after[j]]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : end])) is not None:
            heapq.heappush(pairs, (r, before[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = after[i]
    return out


@lru_cache(2)
def ranks_of(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Ranks by bytes, and bytes by id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    vocabulary = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        vocabulary[i] = token
    return ranks, vocabulary


class Encoder:
    """Encodes batches of texts; ``fresh`` gives the ids of pieces that aren't cached.

    The cache holds ids as packed 32-bit integers, so that a text's ids are one concatenation. It has two halves: when the
    younger one is full it becomes the older, and what is used of that one is taken over, so common pieces stay.
    """

    def __init__(self, fresh: Callable[[list[str]], list[list[int]]]):
        self.fresh, self.cache, self.older = fresh, {}, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found: list[list[bytes]] = [[] for _ in texts]
        for pieces, parts in slices(texts):
            distinct = dict.fromkeys(pieces)  # small beside the cache, so that most look-ups stay near
            if len(self.cache) > CACHED // 2:
                self.cache, self.older = {}, self.cache
            cache, older = self.cache, self.older
            new = [p for p in distinct if p not in cache]
            cache.update((p, older[p]) for p in new if p in older)
            new = [p for p in new if p not in older]
            cache.update((p, pack(f"<{len(ids)}I", *ids)) for p, ids in zip(new, self.fresh(new), strict=True))
            for p in distinct:
                distinct[p] = cache[p]
            ids = [distinct[p] for p in pieces]
            for i, first, end in parts:
                found[i].append(b"".join(ids[first:end]))
        return [np.frombuffer(b"".join(x), "<u4") for x in found]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """An encoder by a file of ranks, kept for the worker's life."""
    ranks, _ = ranks_of(path)
    return Encoder(lambda pieces: [merged(p.encode("utf-8", "surrogatepass"), ranks) for p in pieces])


def offsets_of(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The byte offset of each token, and the length of all."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths[ids], dtype=np.int64)])


def decode(ids: np.ndarray, offsets: np.ndarray, vocabulary: list[bytes], start: int = 0, end: int | None = None) -> bytes:
    """The bytes of the tokens from start to end; the offsets tell how many there must be."""
    end = len(ids) if end is None else end
    out = b"".join(map(vocabulary.__getitem__, ids[start:end].tolist()))
    if len(out) != offsets[end] - offsets[start]:
        raise ValueError("ids and offsets don't belong together")
    return out


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
TOKENS = [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("offsets", T.ArrayType(T.LongType()))]


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_tokens: bool = True) -> DataFrame:
    """Encodes every whole text and decodes it again.

    Returns the key, n_tokens, digests of the ids and of the decoded bytes and, with ``keep_tokens``, the ids and the
    byte offset of each (one more: the end). path: a file of ranks that every worker can read.
    """
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), *DIGESTS, *(TOKENS if keep_tokens else [])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, vocabulary = ranks_of(path)
        lengths = np.array([len(t) for t in vocabulary], np.int64)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                rows = []
                for k, ids in zip(part["key"], encoder(path).encode([t or "" for t in part["text"]]), strict=True):
                    offsets = offsets_of(ids, lengths)
                    row = [k, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids, offsets, vocabulary)).hexdigest()]
                    rows.append([*row, ids.tolist(), offsets.tolist()] if keep_tokens else row)
                yield pd.DataFrame(rows, columns=schema.names)

    return source.mapInPandas(run, schema)
