"""Best-fit packing of documents into sequences by swap-based local search.

Documents are tokenized and closed with an end id; longer ones are cut into pieces of ``capacity`` ids of
which only the first may be shorter. Pieces are dealt evenly to groups of about ``per_group`` pieces that are
packed side by side: each piece goes to the fullest sequence that still takes it, longest first; then every underfull
sequence in turn, the emptiest first, gives up pieces by moves and by exchanges of one piece for one or of two for one, each of
which raises the sum of squared fills, as long as there is such a step. The search ends with the first pass over all underfull
sequences that empties none. A group of that size leaves about one underfull sequence, so what is lost at the seams doesn't
grow with the data.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no pieces; other
columns of the documents are left out. Names of special tokens in a text get the token's id, as in the tokenizers library.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from staffloom.llm.bpe import merged, slices
from staffloom.llm.shared import written

CAPACITY = 2048
#: Texts that are longer, or hold a longer run of white space, are cut into pieces by the scan of op4 instead of a regular expression.
LONG_TEXT, LONG_RUN = 1 << 18, regex.compile(r"\s{2048}")


@lru_cache(1)
def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, others from 256 up."""
    plain = [b for b in range(256) if b in range(33, 127) or b in range(161, 256) and b != 173]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}


@lru_cache(1)
def encoder(path: str) -> Callable[[str], list[int]]:
    """The ids of a text by a tokenizers file of byte-level BPE.

    The file's merges are numbered as its ids are, so its vocabulary serves as ranks; that is checked. Nothing that has been
    encoded is kept, so a worker's memory doesn't grow.
    """
    with open(path, encoding="utf-8") as lines:
        tokenizer = json.load(lines)
    vocabulary, back = tokenizer["model"]["vocab"], {c: b for b, c in byte_alphabet().items()}
    special = {t["content"]: t["id"] for t in tokenizer["added_tokens"]}
    ranks = {bytes(back[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    results = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in tokenizer["model"]["merges"]]
    if results != sorted(results) or any(t[k] for t in tokenizer["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path} is no byte-level BPE whose merges are in the order of ids")
    library = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
    names = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def plain(text: str) -> list[int]:
        if len(text) <= LONG_TEXT and not LONG_RUN.search(text):
            return library.encode_ordinary(text)
        return [i for found, _ in slices([text]) for piece in found for i in merged(piece.encode("utf-8", "surrogatepass"), ranks)]

    def encode(text: str) -> list[int]:
        if names is None or not any(name in text for name in special):
            return plain(text)
        return [i for part in names.split(text) for i in ([special[part]] if part in special else plain(part))]

    return encode


def cut_points(length: int, capacity: int) -> list[int]:
    """Where the pieces of a document begin, and its end; only the first piece may be shorter than the capacity."""
    first = (length - 1) % capacity + 1
    return [0, *range(first, length + 1, capacity)]


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of every document: key, piece, start, length, ids_crc32."""
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), T.StructField("piece", T.IntegerType()), *[T.StructField(k, T.LongType()) for k in ("start", "length", "ids_crc32")]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, rows, encode = batch.iloc[at : at + 256], [], encoder(path)
                for k, text in zip(part["key"], part["text"], strict=True):
                    ids = encode(text or "")
                    raw = array("I", [*ids, end_id]).tobytes()
                    cuts = cut_points(len(ids) + 1, capacity)
                    rows += [(k, i, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield pd.DataFrame(rows, columns=schema.names)

    return source.mapInPandas(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins


class Reaches:
    """The pieces of underfull bins by reach, which is a piece's length and its bin's room: what could take the piece's place.

    Each bin has a piece of length 0 as well, whose place a moved piece takes. Bits tell which reaches, and which lengths at a
    reach, have pieces. A bin that changes gets a new version; entries of older ones are dropped when met.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.version = [0] * len(bins)
        self.reaches, self.lengths = 0, [0] * (capacity + 1)
        self.at: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for b in range(len(bins)):
            self.add(b)

    def add(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if room and self.bins[b]:
            for i in (-1, *self.bins[b]):
                size = self.sizes[i] if i >= 0 else 0
                self.at[room + size, size].append((b, i, self.version[b]))
                self.lengths[room + size] |= 1 << size
                self.reaches |= 1 << (room + size)

    def drop(self, b: int) -> None:
        self.version[b] += 1

    def find(self, give: int, room: int) -> tuple[int, int] | None:
        """(bin, piece) that ``give`` ids replace, leaving least room, in a bin with at most ``room`` left."""
        reach, bits = give, self.reaches >> give
        while bits:
            skip = (bits & -bits).bit_length() - 1
            reach, bits = reach + skip, bits >> skip
            least = max(0, reach - room)
            lengths = (self.lengths[reach] & ((1 << give) - 1)) >> least << least
            while lengths:
                size = (lengths & -lengths).bit_length() - 1
                entries = self.at[reach, size]
                while entries and self.version[entries[-1][0]] != entries[-1][2]:
                    entries.pop()
                if entries:
                    return entries[-1][:2]
                self.lengths[reach] &= ~(1 << size)
                if not self.lengths[reach]:
                    self.reaches &= ~(1 << reach)
                lengths &= lengths - 1
            reach, bits = reach + 1, bits >> 1
        return None


def gives(bin_: list[int], sizes: list[int]) -> Iterator[list[int]]:
    """What a bin can give: a piece of each length, the longest first, then two of each pair of lengths."""
    by_size: dict[int, list[int]] = {}
    for i in bin_:
        by_size.setdefault(sizes[i], []).append(i)
    order = sorted(by_size, reverse=True)
    yield from ([by_size[k][0]] for k in order)
    for n, k in enumerate(order):
        if len(by_size[k]) > 1:
            yield by_size[k][:2]
        yield from ([by_size[k][0], by_size[m][0]] for m in order[n + 1 :])


def improve(a: int, index: Reaches) -> bool:
    """One step that takes from bin a, which is not in the index, if there is one."""
    bins, sizes, fill = index.bins, index.sizes, index.fill
    for give in gives(bins[a], sizes):
        total = sum(sizes[i] for i in give)
        found = index.find(total, index.capacity - fill[a])
        if found is None:
            continue
        b, take = found
        index.drop(b)
        for i in give:
            bins[a].remove(i)
            bins[b].append(i)
        if take >= 0:
            bins[b].remove(take)
            bins[a].append(take)
            total -= sizes[take]
        fill[a] -= total
        fill[b] += total
        index.add(b)
        return True
    return False


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empties bins by moves and exchanges between underfull bins.

    A piece or two of a bin take the place of a shorter piece, or of none, in a bin that is at least as full. Each step makes the
    fuller bin fuller still, so the sum of squared fills rises and a bin's steps end.
    """
    index = Reaches(bins, lengths.tolist(), capacity)
    while True:
        emptied = 0
        for a in sorted((b for b, f in enumerate(index.fill) if 0 < f < capacity), key=index.fill.__getitem__):
            index.drop(a)
            while bins[a] and improve(a, index):
                pass
            emptied += not bins[a]
            index.add(a)
        if not emptied:
            return [b for b in bins if b]


def packed(cut: DataFrame, capacity: int = CAPACITY, per_group: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to pieces; every sequence holds at most ``capacity`` ids, without gaps."""
    groups = max(1, -(-cut.count() // per_group))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        base = TaskContext.get().partitionId() << 33
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for n, members in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
            sequence[members] = base + n
            offset[members] = np.concatenate([[0], np.cumsum(lengths[members])[:-1]])
        rows["sequence_id"], rows["offset"] = sequence, offset
        for at in range(0, len(rows), 10_000):
            yield rows.iloc[at : at + 10_000]

    return cut.repartition(groups).mapInPandas(pack, schema)


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, per_group: int = 50_000) -> DataFrame:
    """Tokenizes, cuts and packs; the pieces are written once between the two."""
    return packed(written(pieces(docs, path, key, text, capacity, end_id), "pieces"), capacity, per_group)
