"""Packing documents into sequences of several permitted lengths by variable-capacity best fit.

Pieces are placed from the longest on, each in the open sequence that it fills most; where none has room, a sequence is
opened. Its length is chosen there and then among all permitted ones: for each, the sequence is filled in thought with
the longest of the pieces still to come, cut down to the shortest length that holds them, and the length of least cost a
token is opened. At last every sequence is cut down to the shortest permitted length that holds its contents. The cost of
a sequence of n tokens is n + n * n / quadratic: what its tokens and its attention cost.

Documents longer than the longest length are cut into pieces of that length and a rest; no token is lost. Each task packs
the documents it has read, in blocks of bounded size: nothing is shuffled, and no block grows with the input.

Defined results: a null or empty text has one token, its end; repeated rows and ids are packed each; null ids are kept;
pieces of one length are placed in the order of the rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame

from pairloom.llm.common import give_back, pick, slices
from pairloom.llm.tokens import encoder

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces packed together.
BLOCK = 16_384


def contents(n: int, capacity: int, left: list[int], lengths: int) -> int:
    """What a sequence opened for n tokens will hold if the longest of the remaining pieces that fit follow each other.

    left: how many pieces of each length remain; lengths: a bit for each length that does.
    """
    room = capacity - n
    while room:
        fits = lengths & ((2 << room) - 1)
        if not fits:
            break
        k = fits.bit_length() - 1
        room -= k * min(left[k], room // k)
        lengths ^= lengths >> k << k  # shorter ones only from here on
    return capacity - room


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, quadratic: float = 16_384.0) -> tuple[list[int], list[int], list[int]]:
    """Each piece's bin and offset, and each bin's final capacity. Lengths are from 1 to the largest capacity."""
    sizes = sorted(capacities)
    cut = lambda n: sizes[bisect.bisect_left(sizes, n)]
    cost = {c: c + c * c / quadratic for c in sizes}
    left, remaining = [0] * (sizes[-1] + 1), 0
    for n in lengths:
        left[n] += 1
        remaining |= 1 << n
    room: dict[int, list[int]] = defaultdict(list)
    free = 0  # bit r: some bin has room r
    bins, offsets, filled = [0] * len(lengths), [0] * len(lengths), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        left[n] -= 1
        if not left[n]:
            remaining ^= 1 << n
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            b = len(filled)
            filled.append(0)
            held = {c: contents(n, c, left, remaining) for c in sizes if c >= n}
            r = min(held, key=lambda c: (cost[cut(held[c])] / held[c], c))
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        if r > n:
            room[r - n].append(b)
            free |= 1 << (r - n)
    return bins, offsets, [cut(n) for n in filled]


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, quadratic: float = 16_384.0, block: int = BLOCK, special_as_text: bool = True) -> DataFrame:
    """key, piece, start (its first token in the document), n_tokens, bin_id, bin_offset, capacity of every piece.

    A document's tokens are those of its text and one end token. bin_id: the task's number, then the bin's in the task.
    """
    longest = max(capacities)

    def packed(batches):
        from pyspark import TaskContext

        first, encode = TaskContext.get().partitionId() << 32, encoder(tokenizer, special_as_text, cached=150_000)
        held: list[tuple] = []
        kind = None

        def placed(some):
            nonlocal first
            bins, offsets, final = pack([r[3] for r in some], capacities, quadratic)
            ids, piece, start, n = zip(*some, strict=True)
            b = np.array(bins)
            columns = [pa.array(ids, kind), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array(b + first), pa.array(offsets, pa.int32()), pa.array(np.array(final, np.int32)[b])]
            first += len(final)
            return pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "n_tokens", "bin_id", "bin_offset", "capacity"])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            kind = ids.type
            for a, b in slices(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)), 4_000_000, 1 << 16):
                sizes = encode.lengths([x or "" for x in texts.slice(a, b - a).to_pylist()]) + 1
                for i, n in zip(ids.slice(a, b - a).to_pylist(), sizes.tolist(), strict=True):
                    held += [(i, k, s, min(longest, n - s)) for k, s in enumerate(range(0, n, longest))]
                    while len(held) >= block:
                        yield placed(held[:block])
                        held = held[block:]
        if held:
            yield placed(held)
        give_back()

    given = pick(docs, key=key, text=text)
    made = given.mapInArrow(packed, f"key {given.schema['key'].dataType.simpleString()}, piece int, start long, n_tokens int, bin_id long, bin_offset int, capacity int")
    return made.withColumnRenamed("key", key)
