"""Removal of repeated byte strings by sorting sampled suffixes.

Of all suffixes only those that start at an *anchor* are sorted. The anchor of a window of ``length`` bytes is the place in
it whose next LEAD bytes have the smallest hash (the leftmost of equal ones), so equal windows have their anchor at the same
distance from their start and meet wherever suffixes that lead with the same bytes meet. Consecutive windows mostly share
their anchor; an anchor with the bytes of all its windows is a *context*.

1. Contexts are found where the texts lie. Equal contexts (128 bits of digest) are one class: all but its first are removed
   whole, in every task before the shuffle, so a hot group sends a row per slice of text. A class without another class
   under the same leading bytes has nothing to be compared with.
2. The first contexts of the other classes are range-partitioned by the leading bytes of their suffix, with Spark's sampled
   splitters; ties continue by document, so a hot lead is divided over partitions.
3. A partition is sorted in chunks: every window of a context is a suffix with its eight-byte characters, and
   multikey quicksort puts equal windows side by side, the earliest first.
4. Leads at the edges of a chunk may go on in the next one: their distinct windows are compared across the boundaries.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lacuna.llm.texts import slices, with_place
from lacuna.scratch import cut

#: Leading bytes by which anchors are chosen and suffixes dealt.
LEAD = 24

#: Bytes of text looked at together in one task.
STEP = 1 << 20

#: Contexts sorted together in one task.
CHUNK = 4096

U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)  # an odd constant; any will do
    h ^= h >> U(29)
    return h


def _words(data: np.ndarray, kind: str) -> np.ndarray:
    """The eight-byte word that starts at every byte."""
    return np.ndarray((len(data) - 7,), kind, data, strides=(1,))


def lead_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the LEAD bytes from every byte on; ``data`` ends LEAD + 8 bytes behind the last one."""
    n, w = len(data) - LEAD - 8, _words(data, "<u8")
    h = _mix(w[:n] * U(0x9E3779B97F4A7C15))
    for skip in range(8, LEAD, 8):
        h = _mix((h + w[skip : skip + n]) * U(0xC2B2AE3D27D4EB4F))
    return h


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the place of the smallest, the leftmost of equal ones (32 bits of a hash decide)."""
    least, size = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U), 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    return (least & U(0xFFFFFFFF)).astype(np.int64)


def contexts(data: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Lead hash, class digest, anchor, first and last window of every context; ``windows`` are the places, ascending, where one starts."""
    h = lead_hashes(data)
    a = anchors(h, length - LEAD + 1)[windows]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (np.diff(windows) != 1))) if len(a) else np.zeros(0, np.int64)
    last = windows[np.append(new[1:], len(a)) - 1] if len(a) else windows
    first, a = windows[new], a[new]
    digest = _mix(((a - first) << 32 | (last - first)).astype(U) * U(0x9E3779B97F4A7C15))
    for skip in range(0, 2 * length, LEAD):  # a context is shorter than two windows
        digest = _mix((digest + h[np.minimum(first + skip, last + length - LEAD)]) * U(0xC2B2AE3D27D4EB4F))
    return h[a].astype(np.int64), digest.astype(np.int64), a, first, last


def pack(anchor, first, last, length):
    """A context in one number: place of its anchor, windows before it, windows in all."""
    return (anchor << 32) | ((anchor - first) << 16) | (last - first)


def span_of(at, length: int):
    """First byte of a context and the byte behind its last, from numbers or columns."""
    if isinstance(at, Column):
        start = F.shiftright(at, 32) - F.shiftright(at, 16).bitwiseAND(0xFFFF)
        return start, start + at.bitwiseAND(0xFFFF) + length
    start = (at >> 32) - ((at >> 16) & 0xFFFF)
    return start, start + (at & 0xFFFF) + length


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values together and the places where values start, with the end."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _found(length: int, schema: StructType):
    """Contexts of all texts; of equal ones in a slice of text only the earliest keeps its lead, the others are to be removed."""

    def run(batches):
        types = to_arrow_schema(schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = _binary(batch.column(3))
            order = pc.sort_indices(pa.table({"k": batch.column(2), "f": batch.column(0), "p": batch.column(1)}), null_placement="at_start",
                                    sort_keys=[("k", "ascending"), ("f", "ascending"), ("p", "ascending")]).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            for low in range(0, len(data), STEP):
                high = min(low + STEP, len(data))
                window = np.arange(low, high)
                text = np.searchsorted(offsets, window, side="right") - 1
                window = window[window + length <= offsets[text + 1]]
                if not len(window):
                    continue
                piece = np.zeros(high - low + length + LEAD + 8, np.uint8)
                held = data[low : high + length]
                piece[: len(held)] = held
                lead, digest, a, first, last = contexts(piece, window - low, length)
                # contexts end with their text
                text = np.searchsorted(offsets, first + low, side="right") - 1
                start = offsets[text] - low
                at = pack(a - start, first - start, last - start, length)
                by = np.lexsort((at, rank[text], digest, lead))
                lead, digest, text, at = lead[by], digest[by], text[by], at[by]
                repeat = np.append(False, (lead[1:] == lead[:-1]) & (digest[1:] == digest[:-1]))
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lead, mask=repeat), pa.array(digest, mask=repeat), *(batch.column(i).take(rows) for i in (2, 0, 1)), pa.array(at)], schema=types)

    return run


def _classes(schema: StructType):
    """Rows sorted by lead, digest and document: repeats of a class to be removed, and the first of each class that has another beside it."""

    def run(batches):
        types = to_arrow_schema(schema)
        seen = pending = before = None  # last lead and digest; the last first of a class, with its lead; the lead of the one before it

        def marked(rows, first):
            return pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, first)), *rows.columns[3:]], schema=types)

        for batch in batches:
            if not batch.num_rows:
                continue
            done = batch.column(0).is_null().to_numpy(zero_copy_only=False)  # found to be repeats before the shuffle
            lead, digest = (batch.column(i).fill_null(0).to_numpy() for i in (0, 1))
            same = np.append(False, (lead[1:] == lead[:-1]) & (digest[1:] == digest[:-1]) & ~done[:-1])
            same[0] = seen == (lead[0], digest[0])
            seen = None if done[-1] else (lead[-1], digest[-1])
            yield marked(batch.filter(pa.array(same | done)), False)
            firsts = batch.filter(pa.array(~(same | done)))
            if not firsts.num_rows:
                continue
            if pending is not None:
                firsts = pa.concat_batches([pending, firsts])
            leads = firsts.column(0).to_numpy()
            alike = leads[1:] == leads[:-1]
            wanted = np.append(before is not None and before == leads[0], alike[:-1]) | alike if len(alike) else np.zeros(0, bool)
            if wanted.any():
                yield marked(firsts.slice(0, len(wanted)).filter(pa.array(wanted)), True)
            before = leads[-2] if len(leads) > 1 else before
            pending = firsts.slice(len(leads) - 1)
        if pending is not None and before is not None and before == pending.column(0)[0].as_py():
            yield marked(pending, True)

    return run


def refine(words: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the strings of ``length`` bytes from ``starts``: (order, whether each equals the one before it).

    A character is eight bytes; the last one may overlap the one before. The strings are parted by a character, and
    only where some agree in it are they parted by the next. All parts of one depth are done together. Equal strings stay in
    the order given.
    """
    skips = [*range(0, length - 8, 8), length - 8]
    order = np.argsort(words[starts + skips[0]], kind="stable")
    c = words[starts[order] + skips[0]]
    same = np.append(False, c[1:] == c[:-1])  # ties with the one before
    for skip in skips[1:]:
        tied = np.flatnonzero(same | np.append(same[1:], False))
        if not len(tied):
            break
        part = np.cumsum(~same[tied])
        mine = order[tied]
        c = words[starts[mine] + skip]
        alike = np.append(False, (c[1:] == c[:-1]) & (part[1:] == part[:-1]))
        # parts that agree in this character need no sorting
        mixed = np.zeros(part[-1] + 1, bool)
        mixed[part[same[tied] & ~alike]] = True
        some = np.flatnonzero(mixed[part])
        if len(some):
            by = some[np.lexsort((c[some], part[some]))]
            mine[some], c[some] = mine[by], c[by]
            order[tied] = mine
            alike = np.append(False, (c[1:] == c[:-1]) & (part[1:] == part[:-1]))
        same[tied] = alike
    return order, same


def _sorted_chunk(rows: list[tuple], length: int):
    """Spans of repeats and windows to compare across boundaries, from contexts sorted by lead and document.

    A row is (suffix, before, key, file, place, at). The windows of the first and the last lead are compared across boundaries.
    """
    whole = [before + suffix for suffix, before, *_ in rows]
    sizes = np.array([len(b) for b in whole])
    data = np.frombuffer(b"".join(whole) + b"\0" * 8, np.uint8)
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(rows)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (np.cumsum(sizes) - sizes)[owner] + inside
    order, same = refine(_words(data, ">u8").astype(U), starts, length)
    repeat = np.zeros(len(owner), bool)
    repeat[order[same]] = True
    edge = [rows[0][0][:LEAD], rows[-1][0][:LEAD]]
    first = np.cumsum(counts) - counts
    for r, (suffix, _, key, file, place, at) in enumerate(rows):
        begin, _ = span_of(at, length)
        mine = repeat[first[r] : first[r] + counts[r]]
        if mine.any():
            turns = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
            for x, y in turns.reshape(-1, 2).tolist():
                yield file, place, begin + x, begin + y - 1 + length, None, key
        if suffix[:LEAD] in edge:
            for x in np.flatnonzero(~mine).tolist():
                yield file, place, begin + x, begin + x + length, blake2b(whole[r][x : x + length], digest_size=16).digest(), key


def _compared(length: int, schema: StructType):
    def run(batches):
        types, rows = to_arrow_schema(schema), []

        def flush():
            found = list(_sorted_chunk(rows, length))
            rows.clear()
            for i in range(0, len(found), 1 << 16):
                columns = zip(*found[i : i + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                rows.append(row)
                if len(rows) >= CHUNK:
                    yield from flush()
        if rows:
            yield from flush()

    return run


def _cut_out(schema: StructType):
    """Bytes that remain of every text, and the maximal removed runs."""

    def run(batches):
        types = to_arrow_schema(schema)
        for batch in (part for whole in batches for part in slices(whole, pc.binary_length(whole.column(1)))):
            kept, runs = [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                joined: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in spans or ()):
                    if joined and s[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s[1])
                    else:
                        joined.append([*s])
                at, parts = 0, []
                for x, y in joined:
                    parts.append(text[at:x])
                    at = y
                kept.append(b"".join([*parts, text[at:]]) if joined else text)
                runs.append([{"start": x, "end": y} for x, y in joined])
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(kept, types[2].type), pa.array(runs, types[3].type)], schema=types)

    return run


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """``key``, ``n_bytes``, ``kept`` (the remaining UTF-8 bytes), ``removed`` (array of start, end) of every row.

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a row of a smaller key, or in the same
    text before. A null text is empty. A null key comes before all others; rows of equal keys are ordered by their place in the
    input. Strings are compared as they were in the input and never across texts; texts shorter than ``length`` stay
    whole. Repeated rows are rows of their own, so all but the first are removed if long enough. Other columns are left
    out, so none can clash; an empty table gives no rows.
    """
    if not 2 * LEAD <= length <= 1 << 15:
        raise ValueError(f"length must be from {2 * LEAD} to {1 << 15}")
    placed = with_place(df.select(key, text), "texts")
    docs = placed.select("__file", "__place", F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    context = StructType.fromDDL(f"lead bigint, digest bigint, key {kind}, file bigint, place bigint, at bigint")
    found = docs.mapInArrow(_found(length, context), context)
    # what is surely a repeat is dealt by its place
    met = found.repartition(F.coalesce("lead", F.xxhash64("file", "place", "at"))).sortWithinPartitions("lead", "digest", "key", "file", "place", "at")
    kept = StructType.fromDDL("first boolean, file bigint, place bigint, at bigint")
    classes = cut(met.mapInArrow(_classes(kept), kept), "contexts")

    wanted = classes.where("first").groupBy("file", "place").agg(F.collect_list("at").alias("at"))  # of one text
    named = docs.join(wanted, (docs["__file"] == wanted["file"]) & (docs["__place"] == wanted["place"]), "left")
    context = StructType.fromDDL(f"suffix binary, before binary, key {kind}, file bigint, place bigint, at bigint")

    def suffixes(batches):
        types = to_arrow_schema(context)
        for batch in batches:
            rows = []
            for file, place, k, t, places in zip(*(batch.column(i) for i in range(5))):
                if not places.is_valid:
                    continue
                t, k, file, place = t.as_py(), k.as_py(), file.as_py(), place.as_py()
                for at in places.as_py():
                    start, end = span_of(at, length)
                    rows.append((t[at >> 32 : end], t[start : at >> 32], k, file, place, at))
            for i in range(0, len(rows), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + (1 << 14)]), types)], schema=types)

    cut_up = named.select("__file", "__place", "key", "text", "at").mapInArrow(suffixes, context)
    order = [F.substring("suffix", 1, LEAD), *map(F.col, ("key", "file", "place", "at"))]
    compared = StructType.fromDDL(f"file bigint, place bigint, start bigint, end bigint, digest binary, key {kind}")
    ranged = cut_up.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compared(length, compared), compared)
    # windows at the edges of chunks: equal ones meet by digest, spans already known pass alone
    alone = F.when(F.col("digest").isNull(), F.xxhash64("file", "place", "start"))
    across = W.partitionBy("digest", alone).orderBy("key", "file", "place", "start")
    more = ranged.withColumn("n", F.row_number().over(across)).where("n > 1 OR digest IS NULL").select("file", "place", "start", "end")

    start, end = span_of(F.col("at"), length)
    spans = classes.where("NOT first").select("file", "place", start.alias("start"), end.alias("end")).unionByName(more)
    listed = spans.groupBy("file", "place").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # of one text
    whole = docs.join(listed, (docs["__file"] == listed["file"]) & (docs["__place"] == listed["place"]), "left")
    out = StructType.fromDDL(f"`{key}` {kind}, n_bytes bigint, kept binary, removed array<struct<start:bigint,end:bigint>>")
    return whole.select("key", "text", "spans").mapInArrow(_cut_out(out), out)
