"""Suffix-array dedup: removal of every byte covered by a string of `LENGTH` bytes that also starts earlier.

Suffixes are sorted by linear grouping construction. Suffixes are first put into groups by their first symbol. Groups
are taken in descending order; for each member the nearest smaller suffix group before it is found by previous-smaller
pointers, and those predecessors move into new groups right above what is left of theirs, ordered by how often they
were hit. When all groups are done they stand for the Lyndon prefixes of the suffixes. A second pass from the least
suffix on emits the order inside the groups along the same pointers; nothing is renamed or sorted recursively.

To sort only what matters, every window of LENGTH bytes chooses an anchor inside itself: the least hash of its substrings
of `GRAM` bytes. Equal windows choose equal anchors at equal places. The windows that chose one anchor make one
context, a stretch of text around it. Contexts that equal an earlier one whole are removed whole. Where an anchor has
several different contexts, the first of each goes into a suffix array with the others of that anchor (the anchor
being one symbol), and equal windows are runs of neighbours in it. An anchor with more than `PART` contexts is
dealt over several arrays, and the first window of each run is compared once more across them, so no array and no
task depends on how often a passage is repeated.

Null text counts as empty; texts shorter than LENGTH lose nothing. Positions are those of the input, not of what is
left. Rows of null id come after all others. Rows of one id are taken as one document in which only starts count. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, common

LENGTH = 100
GRAM = 48
#: Contexts in one suffix array at most, for an anchor with more.
PART = 48
BUCKET_BYTES = 12 << 20
NULL_ID = np.iinfo(np.int64).max


# ---------------------------------------------------------------- suffix arrays


def suffix_arrays(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffix arrays of many strings at once: out[begin[k]:end[k]] lists the positions of string k in order.

    Each string ends with a symbol that is smaller than all its others. All strings take their next group together."""
    n = len(text)
    which = np.repeat(np.arange(len(begin)), end - begin)
    order = np.argsort(which.astype(np.int64) << 20 | text, kind="stable")
    member = order.copy()  # positions by slot; a group is a range of slots
    slot = np.empty(n, dtype=np.int64)
    slot[order] = np.arange(n)
    symbol = text[order]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (symbol[1:] != symbol[:-1]) | (which[1:] != which[:-1])
    heads = np.flatnonzero(fresh)
    group = np.empty(n, dtype=np.int64)  # first slot of the group of each position
    group[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    stop = np.zeros(n + 1, dtype=np.int64)  # past the last slot, by first slot
    stop[heads] = np.append(heads[1:], n)
    smaller = np.full(n, -1, dtype=np.int64)  # previous-smaller pointers
    low = begin[which]
    # groups in descending order
    at = end.copy()
    active = np.flatnonzero(at > begin)
    while len(active):
        first = group[member[at[active] - 1]]
        size = at[active] - first
        total = np.cumsum(size)
        owner = np.repeat(first, size)
        i = member[np.arange(total[-1]) + np.repeat(first - (total - size), size)]
        j = i - 1
        floor = low[i]
        search = np.flatnonzero(j >= floor)
        search = search[group[j[search]] >= owner[search]]
        while len(search):
            js = j[search]
            js = np.where(group[js] > owner[search], smaller[js], js - 1)
            j[search] = js
            search = search[js >= floor[search]]
            search = search[group[j[search]] >= owner[search]]
        j = np.where(j >= floor, j, -1)
        smaller[i] = j
        hit = np.sort(j[j >= 0])
        if len(hit):
            new = np.ones(len(hit), dtype=bool)
            new[1:] = hit[1:] != hit[:-1]
            place = np.flatnonzero(new)
            target = hit[place]
            times = np.diff(np.append(place, len(hit)))
            old = group[target]
            by = np.lexsort((times, old))
            target, times, old = target[by], times[by], old[by]
            run = np.ones(len(target), dtype=bool)
            run[1:] = old[1:] != old[:-1]
            starts = np.flatnonzero(run)
            moved = np.diff(np.append(starts, len(target)))
            q = old[starts]
            tail = stop[q] - moved  # the moved take the last slots of their group
            goal = np.repeat(tail - starts, moved) + np.arange(len(target))
            # whoever stays but stands there takes the places of the moved ones further down
            there = member[goal]
            staying = np.ones(len(there), dtype=bool)
            mark = np.repeat(tail, moved)
            in_tail = slot[target] >= mark
            is_moved = np.zeros(len(there), dtype=bool)
            is_moved[slot[target[in_tail]] - mark[in_tail] + np.repeat(starts, moved)[in_tail]] = True
            staying &= ~is_moved
            free = slot[target[~in_tail]]
            member[free] = there[staying]
            slot[there[staying]] = free
            member[goal] = target
            slot[target] = goal
            cut = run.copy()
            cut[1:] |= times[1:] != times[:-1]
            heads = np.flatnonzero(cut)
            sizes = np.diff(np.append(heads, len(target)))
            stop[q] = tail
            stop[goal[heads]] = goal[heads] + sizes
            group[target] = np.repeat(goal[heads], sizes)
        at[active] = first
        active = active[first > begin[active]]
    # the order inside groups, from the least suffix on
    out = np.full(n, -1, dtype=np.int64)
    out[begin] = end - 1
    front = np.arange(n)
    final = np.zeros(n, dtype=bool)
    final[end - 1] = True
    step, active = 0, np.flatnonzero(end > begin)
    lengths = end - begin
    by_length = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[by_length]
    active_count = len(by_length)
    while True:
        active_count = int(np.searchsorted(-sorted_lengths[:active_count], -step, side="left"))
        if not active_count:
            return out
        live = by_length[:active_count]
        j = out[begin[live] + step] - 1
        floor = begin[live]
        ok = j >= floor
        j, floor = j[ok], floor[ok]
        ok = ~final[j]
        j, floor = j[ok], floor[ok]
        while len(j):
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            final[j] = True
            j = smaller[j]
            ok = j >= 0
            j = j[ok]
            j = j[~final[j]]
        step += 1


# ---------------------------------------------------------------- anchors and contexts


def anchors(data: np.ndarray, off: np.ndarray):
    """For texts of LENGTH bytes or more: (row, anchor, first window, last window, anchor hash, context hash).

    Positions are in the block. Windows of one anchor are neighbours."""
    n = len(data)
    width = LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hasher = common.ByteHasher(data)
    at = np.arange(n - GRAM + 1)
    h = (hasher.prefix[GRAM:] - hasher.prefix[: n - GRAM + 1]) * hasher.inverse[: n - GRAM + 1]
    h = common.mix64(h)
    bits = max(20, int(n).bit_length())
    packed = (h >> np.uint64(bits)) << np.uint64(bits) | at.astype(np.uint64)
    least, have = packed, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    chosen = (least & np.uint64((1 << bits) - 1)).astype(np.int64)  # by first byte of the window
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(chosen)]
    inside = np.arange(len(chosen)) + LENGTH <= off[1:][row]
    start = np.flatnonzero(inside)
    pick, r = chosen[start], row[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (pick[1:] != pick[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, a = start[first], start[last], pick[first]
    context = hasher.ranges(lo, hi + LENGTH) ^ common.mix64((a - lo).astype(np.uint64))
    return r[first], a, lo, hi, h[a], context


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(batch.column(0).cast(pa.int64()), int(NULL_ID)).to_numpy(zero_copy_only=False)


def _merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals [lo, hi) of rows, sorted, with those that touch or overlap joined."""
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    if not len(row):
        return row, lo, hi
    # the greatest end so far in the same row
    base = row.astype(np.int64) << 40
    reach = np.maximum.accumulate(hi + base)
    new = np.ones(len(row), dtype=bool)
    new[1:] = (lo[1:] + base[1:] > reach[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], lo[first], reach[last] - base[last]


_ANCHOR = np.dtype([("h", "<u8"), ("c", "<u8"), ("id", "<i8"), ("row", "<u4"), ("a", "<u4"), ("lo", "u1"), ("hi", "u1")])
_CONTEXT = np.dtype([("h", "<u8"), ("id", "<i8"), ("key", "<i8"), ("row", "<u4"), ("a", "<u4"), ("lo", "u1"), ("hi", "u1"), ("parts", "<u4")])
_SPAN = np.dtype([("row", "<u4"), ("lo", "<u4"), ("hi", "<u4")])
_WINDOW = np.dtype([("w", "<u8"), ("v", "<u8"), ("id", "<i8"), ("key", "<i8"), ("a", "<u4"), ("row", "<u4"), ("lo", "<u4")])


def _columns(x: np.ndarray) -> bytes:
    """Fields one after another: alike values stand together, which compresses well in the shuffle."""
    return b"".join(np.ascontiguousarray(x[f]).tobytes() for f in x.dtype.names)


def _records(raw, kind: np.dtype) -> np.ndarray:
    raw = np.frombuffer(raw.as_buffer() if hasattr(raw, "as_buffer") else raw, dtype=np.uint8)
    n = len(raw) // kind.itemsize
    out = np.empty(n, dtype=kind)
    at = 0
    for f in kind.names:
        size = kind[f].itemsize * n
        out[f] = raw[at : at + size].view(kind[f])
        at += size
    return out


def _spans(key: int, row, lo, hi, bucket: int = -1) -> pa.RecordBatch:
    x = np.empty(len(row), dtype=_SPAN)
    x["row"], x["lo"], x["hi"] = row, lo, hi
    return _out(key, 0, bucket, _columns(x), None)


#: Rows between the steps. kind 0: spans to remove, 1: anchors, 2: contexts to look up, 3: windows to compare again.
_OUT = "key long, kind int, bucket int, x binary, y binary"


def _out(key, kind, bucket, x, y) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "kind": pa.array([kind], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "x": pa.array([x], pa.binary()), "y": pa.array([y], pa.binary())})


def _empty() -> pa.RecordBatch:
    return _out(0, 0, 0, b"", b"").slice(0, 0)


def _by_bucket(hashes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    b = ((hashes >> np.uint64(24)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    b = b[order]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, np.int64)
    for lo, hi in zip(cut[:-1], cut[1:]):
        yield int(b[lo]), order[lo:hi]


def _anchor_rows(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in chunks.chunks(batches):
            parts, base = [], 0
            for batch in held:
                ids = _ids(batch)
                for lo, hi, data, off in common.text_blocks(batch, "text"):
                    r, a, first, last, h, c = anchors(data, off)
                    x = np.empty(len(r), dtype=_ANCHOR)
                    x["h"], x["c"], x["id"], x["row"] = h, c, ids[lo:hi][r], r + lo + base
                    x["a"], x["lo"], x["hi"] = a - off[r], a - first, last - (a - (LENGTH - GRAM))
                    parts.append(x)
                base += batch.num_rows
            x = np.concatenate(parts) if parts else np.zeros(0, _ANCHOR)
            # of equal contexts of a chunk only the first goes on; the others go whole
            x = x[np.lexsort((x["a"], x["id"], x["c"], x["h"]))]
            same = np.zeros(len(x), dtype=bool)
            same[1:] = (x["h"][1:] == x["h"][:-1]) & (x["c"][1:] == x["c"][:-1])
            lead = np.maximum.accumulate(np.where(~same, np.arange(len(x)), 0)) if len(x) else np.zeros(0, np.int64)
            later = same & ((x["id"] != x["id"][lead]) | (x["a"] != x["a"][lead]))
            gone = x[later]
            if len(gone):
                yield _spans(key, *_merged(gone["row"], *_reach(gone)), bucket=key % n_buckets)
            first = x[~later]
            for b, at in _by_bucket(first["h"], n_buckets):
                yield _out(key, 1, b, _columns(first[at]), None)

    return run


def _reach(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[first byte, past last byte) of the contexts of anchors."""
    a = x["a"].astype(np.int64)
    return a - x["lo"], a - (LENGTH - GRAM) + x["hi"] + LENGTH


def _resolve(table: pa.Table) -> pa.Table:
    """Anchors of one bucket: spans of contexts that occur earlier, and contexts to look up in suffix arrays.

    Spans that chunks found by themselves only pass through."""
    out = [_empty()]
    kind = table.column("kind").to_numpy()
    out += table.filter(pa.array(kind == 0)).combine_chunks().to_batches()
    table = table.filter(pa.array(kind == 1))
    if not table.num_rows:
        return pa.Table.from_batches(out)
    keys = table.column("key").to_pylist()
    parts = [_records(x, _ANCHOR) for x in table.column("x").combine_chunks()]
    src = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    x = np.concatenate(parts)
    order = np.argsort(x["h"], kind="stable")
    h = x["h"][order]
    alike = np.zeros(len(h) + 1, dtype=bool)
    alike[1:-1] = h[1:] == h[:-1]
    several = order[alike[1:] | alike[:-1]]
    x, src = x[several], src[several]
    order = np.lexsort((x["a"], x["id"], x["c"], x["h"]))
    x, src = x[order], src[order]
    if len(x):
        new_h = np.ones(len(x), dtype=bool)
        new_h[1:] = x["h"][1:] != x["h"][:-1]
        new_c = new_h.copy()
        new_c[1:] |= x["c"][1:] != x["c"][:-1]
        lead = np.maximum.accumulate(np.where(new_c, np.arange(len(x)), 0))
        later = (x["id"] != x["id"][lead]) | (x["a"] != x["a"][lead])
        of_h = np.cumsum(new_h) - 1
        kinds = np.bincount(of_h, weights=new_c).astype(np.int64)
        ask = new_c & (kinds[of_h] > 1)
        for s in np.unique(src[later]):
            at = later & (src == s)
            out.append(_spans(keys[s], *_merged(x["row"][at], *_reach(x[at]))))
        for s in np.unique(src[ask]):
            at = np.flatnonzero(ask & (src == s))
            c = np.empty(len(at), dtype=_CONTEXT)
            for f in ("h", "id", "row", "a", "lo", "hi"):
                c[f] = x[f][at]
            c["key"], c["parts"] = keys[s], -(-kinds[of_h[at]] // PART)
            out.append(_out(keys[s], 2, -1, _columns(c), None))
    return pa.Table.from_batches(out)


def _context_rows(n_buckets: int):
    """Texts of a chunk and what its contexts need: contexts with their bytes, dealt by anchor and part."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_empty()]
        if left.num_rows and right.num_rows:
            c = np.concatenate([_records(x, _CONTEXT) for x in right.column("x").combine_chunks()])
            text = left.column("text").combine_chunks()
            data, off = common.bytes_of(text)
            lo, hi = _reach(c)
            if len(c) and (off[:-1][c["row"]] + hi > off[1:][c["row"]]).any():
                raise ValueError("the input's partitions changed between reads; write it to files first")
            part = common.mix64(c["id"].astype(np.uint64) * np.uint64(3) + c["a"]) % c["parts"].astype(np.uint64)
            place = common.mix64(c["h"] + part * np.uint64(0x9E3779B97F4A7C15))
            for b, at in _by_bucket(place, n_buckets):
                raw = data[common.ragged(off[:-1][c["row"][at]] + lo[at], (hi - lo)[at])]
                out.append(_out(int(key[0].as_py()), 2, b, _columns(c[at]), raw.tobytes()))
        return pa.Table.from_batches(out)

    return run


def _lookup(n_windows: int, batch_symbols: int = 1 << 20):
    """Contexts of a bucket: suffix arrays of each anchor's (or part's) contexts, spans of windows that occur earlier."""
    inner = LENGTH - GRAM + 1  # symbols of a window, the anchor being one

    def solve(c: np.ndarray, data: np.ndarray, off: np.ndarray, group: np.ndarray):
        """c sorted by group; returns (first, last removed window of each context or -1, windows that lead runs)."""
        size = np.diff(off)
        length = size - GRAM + 1
        symbols = np.empty(int(length.sum() + len(c) + (group[-1] + 1)), dtype=np.int64)
        ends = np.flatnonzero(np.append(group[1:] != group[:-1], True))
        tail = np.zeros(len(c), dtype=np.int64)
        tail[ends] = 1
        slots = length + 1 + tail
        at = np.cumsum(slots) - slots
        symbols[at + length] = 1
        symbols[(at + length + 1)[ends]] = 0
        left = c["lo"].astype(np.int64)
        right = length - left - 1
        symbols[common.ragged(at, left)] = data[common.ragged(off[:-1], left)].astype(np.int64) + 2
        symbols[at + left] = 258
        symbols[common.ragged(at + left + 1, right)] = data[common.ragged(off[:-1] + left + GRAM, right)].astype(np.int64) + 2
        begin = at[np.append(0, ends[:-1] + 1)]
        sa = suffix_arrays(symbols, begin, np.append(begin[1:], len(symbols)))
        context = np.repeat(np.arange(len(c)), slots)
        shift = np.arange(len(symbols)) - np.repeat(at, slots)
        windows = length - inner + 1
        sa = sa[shift[sa] < windows[context[sa]]]
        of = context[sa]
        equal = np.zeros(len(sa), dtype=bool)
        equal[1:] = group[of[1:]] == group[of[:-1]]
        near = np.flatnonzero(equal)
        for k in (0, 26, 13, 39, *range(inner)):
            near = near[symbols[sa[near] + k] == symbols[sa[near - 1] + k]] if len(near) else near
        equal[:] = False
        equal[near] = True
        run = np.cumsum(~equal) - 1
        rank = np.empty(len(c), dtype=np.int64)
        by = np.lexsort((c["a"], c["id"]))
        tie = np.ones(len(c), dtype=bool)
        tie[1:] = (c["id"][by][1:] != c["id"][by][:-1]) | (c["a"][by][1:] != c["a"][by][:-1])
        rank[by] = np.cumsum(tie)
        heads = np.flatnonzero(~equal)
        least = np.minimum.reduceat(rank[of], heads)[run] if len(heads) else np.zeros(0, np.int64)
        later = rank[of] > least
        first = np.full(len(c), 1 << 30, dtype=np.int64)
        last = np.full(len(c), -1, dtype=np.int64)
        np.minimum.at(first, of[later], shift[sa[later]])
        np.maximum.at(last, of[later], shift[sa[later]])
        split = np.flatnonzero(~later & (c["parts"][of] > 1))
        return first, last, of[split], shift[sa[split]]

    def run(table: pa.Table) -> pa.Table:
        parts = [_records(x, _CONTEXT) for x in table.column("x").combine_chunks()]
        c = np.concatenate(parts)
        data = np.concatenate([np.frombuffer(y.as_buffer(), np.uint8) for y in table.column("y").combine_chunks()])
        lo, hi = _reach(c)
        size = hi - lo
        off = np.cumsum(size) - size
        part = common.mix64(c["id"].astype(np.uint64) * np.uint64(3) + c["a"]) % c["parts"].astype(np.uint64)
        order = np.lexsort((part, c["h"]))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (c["h"][order][1:] == c["h"][order][:-1]) & (part[order][1:] == part[order][:-1])
        group = np.cumsum(~same) - 1
        # arrays of alike length together, in batches
        weight = np.bincount(group, weights=size[order] - GRAM + 2)
        turn = np.argsort(weight, kind="stable")
        position = np.empty(len(turn), dtype=np.int64)
        position[turn] = np.arange(len(turn))
        again = np.argsort(position[group], kind="stable")
        order, group = order[again], position[group][again]
        bounds = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        total = np.cumsum(np.sort(weight))
        out = [_empty()]
        spans, windows = [], []
        g0 = 0
        while g0 < len(bounds):
            base = total[g0 - 1] if g0 else 0
            g1 = max(g0 + 1, int(np.searchsorted(total, base + batch_symbols, side="right")))
            i0, i1 = bounds[g0], bounds[g1] if g1 < len(bounds) else len(order)
            at = order[i0:i1]
            cc = c[at]
            o = np.append(0, np.cumsum(size[at]))
            first, last, ctx, shift = solve(cc, data[common.ragged(off[at], size[at])], o, group[i0:i1] - group[i0])
            hit = np.flatnonzero(last >= 0)
            start = lo[at]
            spans.append((cc["key"][hit], cc["row"][hit], start[hit] + first[hit], start[hit] + last[hit] + LENGTH))
            if len(ctx):
                hasher = common.ByteHasher(data[common.ragged(off[at], size[at])])
                w = np.empty(len(ctx), dtype=_WINDOW)
                b = o[ctx] + shift
                w["w"] = hasher.ranges(b, b + LENGTH)
                w["v"] = common.mix64(w["w"] + cc["h"][ctx] + (cc["lo"][ctx] - shift).astype(np.uint64))
                w["id"], w["key"], w["a"], w["row"], w["lo"] = cc["id"][ctx], cc["key"][ctx], cc["a"][ctx], cc["row"][ctx], start[ctx] + shift
                windows.append(w)
            g0 = g1
        key, row, first, last = (np.concatenate([s[k] for s in spans]) for k in range(4)) if spans else (np.zeros(0, np.int64),) * 4
        for k in np.unique(key):
            at = key == k
            out.append(_spans(int(k), *_merged(row[at], first[at], last[at])))
        if windows:
            w = np.concatenate(windows)
            for b, at in _by_bucket(w["v"], n_windows):
                out.append(_out(-1, 3, b, _columns(w[at]), None))
        return pa.Table.from_batches(out)

    return run


def _compare(table: pa.Table) -> pa.Table:
    """First windows of runs of several arrays of one anchor: all but the earliest of equal ones go."""
    w = np.concatenate([_records(x, _WINDOW) for x in table.column("x").combine_chunks()])
    w = w[np.lexsort((w["a"], w["id"], w["w"], w["v"]))]
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w["v"][1:] != w["v"][:-1]) | (w["w"][1:] != w["w"][:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
    later = w[(w["id"] != w["id"][lead]) | (w["a"] != w["a"][lead])]
    out = [_empty()]
    for k in np.unique(later["key"]):
        x = later[later["key"] == k]
        lo = x["lo"].astype(np.int64)
        out.append(_spans(int(k), *_merged(x["row"], lo, lo + LENGTH)))
    return pa.Table.from_batches(out)


def _kept_rows(with_text: bool):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        spans = [_records(x, _SPAN) for x in right.column("x").combine_chunks()] if right.num_rows else []
        s = np.concatenate(spans) if spans else np.zeros(0, _SPAN)
        row, lo, hi = _merged(s["row"].astype(np.int64), s["lo"].astype(np.int64), s["hi"].astype(np.int64))
        data, off = common.bytes_of(left.column("text").combine_chunks())
        if len(row) and (row.max() >= n or (off[:-1][row] + hi > off[1:][row]).any()):
            raise ValueError("the input's partitions changed between reads; write it to files first")
        edge = np.zeros(len(data) + 1, dtype=np.int8)
        np.add.at(edge, off[:-1][row] + lo, 1)
        np.add.at(edge, off[:-1][row] + hi, -1)
        keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
        kept = np.concatenate([[0], np.cumsum(keep)])
        size = np.diff(off)
        left_over = kept[off[1:]] - kept[off[:-1]]
        raw = data[keep].tobytes()
        at = np.concatenate([[0], np.cumsum(left_over)])
        rest = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        cols = {"doc_id": left.column("doc_id"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(size - left_over, pa.int64()), "n_spans": pa.array(np.bincount(row, minlength=n), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in rest], pa.string())}
        if with_text:
            cols["kept"] = pa.array(rest, pa.binary())
        return pa.table(cols)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), with `with_text` also `kept`, the bytes left; one row per row.

    docs must give the same rows in the same partitions each time it is read, as files do; otherwise it fails."""
    spark = docs.sparkSession
    path = path or common.scratch(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(4, -(-size // BUCKET_BYTES))
    # anchors of all texts; contexts that repeat inside a chunk are decided there
    first = common.map_batches(rows, _anchor_rows(n_buckets), _OUT)
    step1 = common.stored(first.groupBy("bucket").applyInArrow(_resolve, _OUT), path, "resolved")
    common.release(spark)
    # contexts with their bytes, and the suffix arrays
    id_type = docs.schema[id_col].dataType.simpleString()
    keyed = common.map_batches(rows, chunks.tagged, f"key long, doc_id {id_type}, text string")
    wanted = step1.where("kind = 2")
    contexts = keyed.groupBy("key").cogroup(wanted.groupBy("key")).applyInArrow(_context_rows(n_buckets), _OUT)
    step2 = common.stored(contexts.groupBy("bucket").applyInArrow(_lookup(n_buckets), _OUT), path, "looked_up")
    common.release(spark)
    # windows of anchors with many contexts, across arrays
    step3 = common.stored(step2.where("kind = 3").groupBy("bucket").applyInArrow(_compare, _OUT), path, "compared")
    spans = step1.where("kind = 0").unionByName(step2.where("kind = 0")).unionByName(step3.where("kind = 0")).select("key", "x")
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return keyed.groupBy("key").cogroup(spans.groupBy("key")).applyInArrow(_kept_rows(with_text), schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.read_table(spark, sf_dir, "documents"))
