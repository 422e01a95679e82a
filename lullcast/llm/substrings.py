"""Removal of byte strings that repeat in the corpus, by prefix-free parsing.

A rolling hash over ``GRAM`` bytes triggers phrase boundaries: a boundary lies
where the hash is the smallest of a window, so every string of ``length`` bytes
holds at least one boundary, and equal strings hold the same ones at the same
places.  A corpus position is then known by a suffix of a phrase (from the position to
the boundary) and by what follows the boundary: its place in the corpus order is that of
the phrase suffix, then that of what follows.  Neighbours in this order that agree over
``length`` bytes repeat.

No order of the whole corpus is needed: strings can be equal only if they hold the same
trigger, so the contexts of one trigger (``length`` bytes each way at most) are ordered
together.  They are dealt to tasks by trigger, and a task orders the suffixes of the
phrases before the triggers (the dictionary) and what follows them (the parse), and
combines both (``corpus_order``), block by block.

Steps: (1) boundaries whose trigger occurs once take part in no repeat; (2) boundaries
whose whole context occurs again are covered by it, by 128-bit fingerprints; (3) the other
boundaries whose trigger is in several contexts are ordered as above; (4) a trigger with
more than ``LIMIT`` different contexts is too much for a task: for it, the windows that hold
the boundary are judged in ranges (a range whose whole span occurs in another context is
covered, one whose shared bytes occur in no other context is out), and the windows of the
ranges left are matched by 128-bit fingerprints, whose counts add up over tasks.

Cases: null and empty texts keep nothing and lose nothing; a text of fewer than
``length`` bytes loses nothing; repeated rows lose all their strings of ``length``
bytes; strings of one repeated byte make a boundary of each position, still in
linear time; rows with a null id, or that share one, are read and answered like any other.
Tables may be empty and may have other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .work import Work

LENGTH = 200
GRAM = 40
RANGES = 8
_LOW = np.uint64((1 << 32) - 1)
#: Rows at most of a list of documents that is broadcast (two integers each); longer lists are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of one key from which on it is joined apart, by broadcast.
HOT = 20_000
#: Contexts of one trigger that a task orders; contexts in a block, about.
LIMIT, BLOCK = 4_096, 16_384


def owners(buf: np.ndarray, offs: np.ndarray, prefix: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all strings of ``length`` bytes that lie in one text, and for each the boundary that it holds: its leftmost smallest gram."""
    n, span = len(buf) - gram + 1, length - gram + 1
    m = n - span + 1
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n)
    full = np.full(-(-n // span) * span, (1 << 64) - 1, np.uint64)
    full[:n] = tv.span_hash(prefix, at, at + gram) & ~_LOW | at.astype(np.uint64)
    grid = full.reshape(-1, span)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(right[:m], left[span - 1 : span - 1 + m])
    starts = np.flatnonzero(at[:m] + length <= np.repeat(offs[1:], np.diff(offs))[:m])
    return starts, (least[starts] & _LOW).astype(np.int64)


def _ranges(length: int, gram: int) -> list[tuple[int, int]]:
    """The distances of a window's start before its boundary, in ``RANGES`` ranges."""
    cuts = np.linspace(0, length - gram + 1, RANGES + 1).astype(int)
    return [(int(a), int(b) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row for each boundary: its gram, and the fingerprint of its whole context with the boundary's place in it."""
    back = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = tv.utf8(b.column(2))
            for i, j in tv.chunks(offs):
                part, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                one, two = tv.prefix_hash(part), tv.prefix_hash(part, 1)
                p = np.unique(owners(part, at, one, length, gram)[1])
                doc = np.searchsorted(at, p, "right") - 1
                lo, hi = at[doc], at[doc + 1]
                a, z = np.maximum(lo, p - back), np.minimum(hi, p + length)
                side = (p - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                keys = (tv.span_hash(one, p, p + gram), tv.mix(tv.span_hash(one, a, z) + side), tv.mix(tv.span_hash(two, a, z) + side))
                rows = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array((p - lo).astype(np.int32)), pa.array((hi - lo).astype(np.int32)), *(pa.array(x.view(np.int64)) for x in keys)], names=["u1", "u2", "p", "size", "g", "b1", "b2"])

    return docs.mapInArrow(run, "u1 bigint, u2 int, p int, size int, g bigint, b1 bigint, b2 bigint")


def _bytes_around(tasks: DataFrame, length: int, gram: int) -> DataFrame:
    """The listed boundaries' contexts, each with its boundary's place in it."""
    names = ["g", "u1", "u2", "p", "single", "at", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.asarray(b.column(3).offsets)
            p, single, g = (np.asarray(b.column(3).values.field(x)) for x in range(3))
            text, offs = tv.utf8(b.column(2))
            at = np.minimum(p, length - gram).astype(np.int32)
            around: list[bytes] = []
            for i in range(b.num_rows):
                own, data = slice(ends[i], ends[i + 1]), text[offs[i] : offs[i + 1]].tobytes()
                around += [data[x - y : x + length] for x, y in zip(p[own].tolist(), at[own].tolist(), strict=True)]
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            first = slice(ends[0], ends[-1])
            yield pa.RecordBatch.from_arrays([pa.array(g[first]), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(p[first]), pa.array(single[first] > 0), pa.array(at[first]), pa.array(around, pa.binary())], names=names)

    return tasks.mapInArrow(run, "g bigint, u1 bigint, u2 int, p int, single boolean, at int, bytes binary")


def _sorted_strings(group: np.ndarray, cells: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte strings (rows of ``cells``) within their groups, and how many bytes each shares with the one before it, -1 at a group's first."""
    n, width = cells.shape
    key = np.concatenate([group.astype(">u4").view(np.uint8).reshape(n, 4), cells, size.astype(">u2").view(np.uint8).reshape(n, 2)], 1)
    order = np.argsort(key.view(f"S{width + 6}").ravel(), kind="stable")
    cells, size, group = cells[order], size[order], group[order]
    same = cells[1:] == cells[:-1]
    common = np.minimum(np.where(same.all(1), width, same.argmin(1)), np.minimum(size[1:], size[:-1]))
    return order, np.concatenate([[-1], np.where(group[1:] == group[:-1], common, -1)])


def corpus_order(group: np.ndarray, before: np.ndarray, n_before: np.ndarray, after: np.ndarray, n_after: np.ndarray, length: int) -> np.ndarray:
    """Which strings of ``length`` bytes occur in two contexts of a group: a row for each context, a column for each start before the boundary.

    ``before`` has the bytes before the boundaries, last one first, ``after`` those from them on.
    """
    n, back = len(group), before.shape[1]
    out = np.zeros((n, back + 1), bool)
    parse, shared = _sorted_strings(group, after, n_after)
    rank = np.empty(n, np.int64)
    rank[parse] = np.arange(n)
    least = [shared.astype(np.int16)]  # of 1, 2, 4, .. neighbours in the parse's order
    while 1 << len(least) < n:
        half = 1 << len(least) - 1
        least.append(np.minimum(least[-1], np.append(least[-1][half:], np.full(half, -1, np.int16))))
    table = np.stack(least)
    power = np.zeros(n + 1, np.int64)
    for k in range(1, len(least)):
        power[1 << k :] = k
    dictionary, common = _sorted_strings(group, before, n_before)
    for d in range(back + 1):
        # classes of equal phrase suffixes of d bytes, each in the parse's order
        new = common < d
        at = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(at):
            break
        owner, kind = dictionary[at], np.cumsum(new)[at]
        order = np.argsort(kind * n + rank[owner])
        owner, kind = owner[order], kind[order]
        pair = np.flatnonzero(kind[1:] == kind[:-1])
        lo, hi = rank[owner[pair]] + 1, rank[owner[pair + 1]]
        k = power[hi - lo + 1]
        good = pair[np.minimum(table[k, lo], table[k, hi - (1 << k) + 1]) >= length - d]
        out[owner[good], d] = out[owner[good + 1], d] = True
    return out


def _ordered(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans ``a, z`` of the repeated strings in contexts that occur once, from contexts that are dealt and sorted by trigger."""
    back, block = length - gram, BLOCK

    def spans(table: pa.Table) -> pa.RecordBatch:
        g, u1, u2, p, single, at = (table.column(c).to_numpy() for c in ("g", "u1", "u2", "p", "single", "at"))
        buf, offs = tv.utf8(table.column("bytes"))
        at = at.astype(np.int64)
        group = np.cumsum(np.append(True, g[1:] != g[:-1]))
        left, right = np.arange(back), np.arange(length)
        n_after = np.diff(offs) - at
        take = lambda x, ok: np.where(ok, buf[np.where(ok, x, 0)], 0).astype(np.uint8)
        before = take((offs[:-1] + at)[:, None] - 1 - left, left < at[:, None])
        after = take((offs[:-1] + at)[:, None] + right, right < n_after[:, None])
        hit = corpus_order(group, before, at, after, n_after, length) & single[:, None]
        edge = np.diff(hit, axis=1, prepend=False, append=False)
        row, d = np.nonzero(edge)
        # edges come in pairs: the first and one past the last of each run of starts
        row, first, last = row[::2], d[::2], d[1::2] - 1
        return pa.RecordBatch.from_arrays([pa.array(u1[row]), pa.array(u2[row]), pa.array((p[row] - last).astype(np.int32)), pa.array((p[row] - first + length).astype(np.int32))], names=["u1", "u2", "a", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= block:
                table = pa.Table.from_batches(held).combine_chunks()
                # the last trigger's contexts may go on
                g = table.column("g").to_numpy()
                cut = len(g) - int(np.argmin(g[::-1] == g[-1])) if g[0] != g[-1] else 0
                if cut:
                    yield spans(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), table.num_rows - cut
        if n:
            yield spans(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(run, "u1 bigint, u2 int, a int, z int")


def _range_keys(tasks: DataFrame, length: int, gram: int) -> DataFrame:
    """For each listed boundary and each range that has windows: fingerprints of the range's whole span and of what all its windows share."""
    d0, d1 = np.array(_ranges(length, gram)).T
    names = ["u1", "u2", "p", "single", "q", "a", "z", "w1", "w2", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int32, np.int32, np.bool_, np.int32, np.int32, np.int32, np.int64, np.int64, np.int64)
        for b in batches:
            u1, u2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            tasks_at = np.asarray(b.column(3).offsets)
            places, singles = (np.asarray(b.column(3).values.field(x)).astype(np.int64) for x in (0, 1))
            text, offs = tv.utf8(b.column(2))
            parts: list[tuple] = []
            for i in range(b.num_rows):
                buf = text[offs[i] : offs[i + 1]]
                p, single, n = places[tasks_at[i] : tasks_at[i + 1]], singles[tasks_at[i] : tasks_at[i + 1]], len(buf)
                one, two = tv.prefix_hash(buf), tv.prefix_hash(buf, 1)
                # one row for each boundary and range
                near, far = np.maximum(d0[None, :], p[:, None] + length - n), np.minimum(d1[None, :], p[:, None])
                row, q = np.nonzero(near <= far)
                x, near, far = p[row], near[row, q], far[row, q]
                side = (far.astype(np.uint64) + (q.astype(np.uint64) << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
                w1, w2 = (tv.mix(tv.span_hash(h, x - far, x - near + length) + side) for h in (one, two))
                core = tv.span_hash(one, x - d0[q], x - d1[q] + length) + q.astype(np.uint64) + np.uint64(1)
                parts.append((np.full(len(x), u1[i]), np.full(len(x), u2[i]), x, single[row] > 0, q, x - far, x - near + length, w1.view(np.int64), w2.view(np.int64), core.view(np.int64)))
            cols = zip(*parts, strict=True) if parts else [[np.zeros(0)]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(cols, kinds, strict=True)], names=names)

    return tasks.mapInArrow(run, "u1 bigint, u2 int, p int, single boolean, q int, a int, z int, w1 bigint, w2 bigint, c bigint")


def _windows(tasks: DataFrame, length: int, gram: int) -> DataFrame:
    """Fingerprints of the windows that hold the given boundaries, in the given ranges."""
    first = [d for d, _ in _ranges(length, gram)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.bool_)
        for b in batches:
            u1, u2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            tasks_at = np.asarray(b.column(3).offsets)
            place, rng, flag = (np.asarray(b.column(3).values.field(x)).astype(np.int64) for x in (0, 1, 2))
            text, offs = tv.utf8(b.column(2))
            parts: list[tuple] = []
            for i in range(b.num_rows):
                buf, own_tasks = text[offs[i] : offs[i + 1]], slice(tasks_at[i], tasks_at[i + 1])
                one, two = tv.prefix_hash(buf), tv.prefix_hash(buf, 1)
                starts, own = owners(buf, np.array([0, len(buf)]), one, length, gram)
                q = np.searchsorted(first, own - starts, "right") - 1
                code, asked = own * RANGES + q, place[own_tasks] * RANGES + rng[own_tasks]
                order = np.argsort(asked)
                at = np.minimum(np.searchsorted(asked[order], code), len(asked) - 1)
                take = asked[order][at] == code
                s = starts[take]
                parts.append((tv.span_hash(one, s, s + length).view(np.int64), tv.span_hash(two, s, s + length).view(np.int64), np.full(len(s), u1[i]), np.full(len(s), u2[i]), s, flag[own_tasks][order][at][take] > 0))
            cols = zip(*parts, strict=True) if parts else [[np.zeros(0)]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(cols, kinds, strict=True)], names=["h1", "h2", "u1", "u2", "s", "ask"])

    return tasks.mapInArrow(run, "h1 bigint, h2 bigint, u1 bigint, u2 int, s int, ask boolean")


def _kept(found: DataFrame) -> DataFrame:
    """The bytes left of each text once its spans are cut out."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                data = np.frombuffer((b.column(1)[i].as_py() or "").encode(), np.uint8)
                spans = b.column(2)[i].values
                step = np.zeros(len(data) + 1, np.int64)
                np.add.at(step, np.asarray(spans.field(0)), 1)
                np.add.at(step, np.asarray(spans.field(1)), -1)
                gone = np.cumsum(step)[:-1] > 0
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((b.column(0)[i].as_py(), len(data), int(gone.sum()), runs, data[~gone].tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=names)

    return found.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def _held_by(rows: DataFrame, keys: DataFrame, on: list[str], work: Work) -> DataFrame:
    """``rows`` whose key is in ``keys``, with the key's number of rows ``m``; keys with many rows are joined by broadcast, so that none of them fills a task."""
    keys = work.save(keys)
    hot = keys.filter(F.col("m") > HOT)
    if not 0 < hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(keys, on)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys.filter(F.col("m") <= HOT), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def _by_windows(open_: DataFrame, with_text, work: Work, length: int, gram: int) -> DataFrame:
    """Spans ``a, z`` of the repeated strings in contexts that occur once, by fingerprints of ranges and then of windows."""
    doc = ["u1", "u2"]
    keys = work.save(_range_keys(with_text(open_, "p", "single"), length, gram))
    full = keys.groupBy("w1", "w2").agg(F.count("*").alias("m"), F.max("single").alias("any")).filter("m > 1 and any").select("w1", "w2", F.lit(True).alias("full"))
    judged = work.save(keys.join(full, ["w1", "w2"], "left").select(*doc, "p", "q", "a", "z", "c", "single", F.coalesce("full", F.lit(False)).alias("full")))
    ranged = judged.filter("single and full").select(*doc, "a", "z")

    ask = F.col("single") & ~F.col("full")
    open_c = judged.groupBy("c").agg(F.count("*").alias("m"), F.max(ask).alias("any")).filter("m > 1 and any").select("c")
    tries = judged.join(open_c, "c", "left_semi").select(*doc, "p", "q", ask.cast("int").alias("ask"))
    windows = work.save(_windows(with_text(tries, "p", "q", "ask"), length, gram))
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("m"), F.max("ask").alias("any")).filter("m > 1 and any").select("h1", "h2")
    single = windows.filter("ask").join(twice, ["h1", "h2"], "left_semi").select(*doc, F.col("s").alias("a"), (F.col("s") + length).alias("z"))
    return ranged.unionByName(single)


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) for every row of ``df``."""
    work = Work(df.sparkSession)
    value = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("u1"), F.hash(F.col(text), F.col(doc_id)).alias("u2"), F.col(doc_id).cast("long").alias("doc_id"), value.alias("text"))
    doc = ["u1", "u2"]

    def with_text(rows: DataFrame, *columns: str) -> DataFrame:
        """``u1, u2, text, todo``: the rows of each document beside its text."""
        todo = work.save(rows.groupBy(*doc).agg(F.collect_list(F.struct(*columns)).alias("todo")))
        return _only(docs, todo.select(*doc), "left_semi").join(todo, doc).select("u1", "u2", "text", "todo")

    anchors = work.save(_anchors(docs.select("u1", "u2", "text"), length, gram))
    often = anchors.groupBy("g").count().filter("count > 1").withColumnRenamed("count", "m")
    shared = work.save(_held_by(anchors, often, ["g"], work).drop("m"))
    work.drop(anchors)
    contexts = work.save(shared.groupBy("b1", "b2").agg(F.count("*").alias("n"), F.min(F.struct("u1", "u2", "p", "g")).alias("r")).select("b1", "b2", "n", (F.col("n") == 1).alias("single"), "r.*"))
    again = contexts.filter("not single").select("b1", "b2", F.col("n").alias("m"))
    covered = work.save(_held_by(shared, again, ["b1", "b2"], work).select(*doc, F.greatest(F.lit(0), F.col("p") - (length - gram)).alias("a"), F.least(F.col("size"), F.col("p") + length).alias("z")))
    work.drop(shared)

    # a repeat of a context that occurs once has its boundary's gram in another context
    open_g = contexts.groupBy("g").agg(F.count("*").alias("m"), F.max("single").alias("any")).filter("m > 1 and any").select("g", "m")
    open_ = work.save(_held_by(contexts, open_g, ["g"], work).select(*doc, "p", F.col("single").cast("int").alias("single"), "g", "m"))
    few, many = open_.filter(F.col("m") <= LIMIT), open_.filter(F.col("m") > LIMIT)
    around = _bytes_around(with_text(few, "p", "single", "g"), length, gram)
    more = _ordered(around.repartition("g").sortWithinPartitions("g"), length, gram)
    if not many.isEmpty():
        more = more.unionByName(_by_windows(many, with_text, work, length, gram))

    spans = work.save(covered.unionByName(more).distinct().groupBy(*doc).agg(F.collect_list(F.struct("a", "z")).alias("spans")))
    work.drop(contexts, covered, open_)
    touched = spans.select(*doc)
    cut = _kept(_only(docs, touched, "left_semi").join(spans, doc).select("doc_id", "text", "spans"))
    size = F.octet_length("text").cast("long")
    rest = _only(docs, touched, "left_anti").select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return cut.unionByName(rest)


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` with or without the listed ones; the list is broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if small else ids, ["u1", "u2"], how)


def suffix_array(items: list) -> list[int]:
    """Suffix array of any sequence of comparable items, by prefix doubling."""
    names = {x: r for r, x in enumerate(sorted(set(items)))}
    rank, n, step = [names[x] for x in items], len(items), 1
    order = sorted(range(n), key=rank.__getitem__)
    while step < n:
        pair = [(rank[i], rank[i + step] if i + step < n else -1) for i in range(n)]
        order = sorted(range(n), key=pair.__getitem__)
        new = [0] * n
        for a, b in zip(order, order[1:], strict=False):
            new[b] = new[a] + (pair[a] != pair[b])
        rank = new
        if n and rank[order[-1]] == n - 1:
            break
        step *= 2
    return order


def repeats_by_order(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, every: int = 8) -> list[set[int]]:
    """For texts of one machine, the bytes to remove, from the corpus order of all positions.

    The dictionary's suffixes are sorted, the parse has a suffix array, and a
    position's rank is that of its phrase suffix, then that of the parse after it.
    Neighbours in this order that agree over ``length`` bytes repeat.
    """
    buf = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    n = len(buf) - gram + 1
    at = np.arange(max(n, 0))
    cuts = np.flatnonzero(tv.span_hash(tv.prefix_hash(buf), at, at + gram) % np.uint64(every) == 0).tolist() if n > 0 else []
    data, parse, where = buf.tobytes(), [], []
    for lo, hi in zip(offs.tolist(), offs[1:].tolist(), strict=False):
        edges = [lo, *(c for c in cuts if lo < c <= hi - gram)]
        for a, b in zip(edges, [*edges[1:], hi], strict=False):
            # a phrase ends with the trigger that starts the next one; a text's last phrase ends with the text
            parse.append(data[a : min(hi, b + gram)])
            where.append((a, b, hi))
    names = {x: r for r, x in enumerate(sorted(set(parse)))}
    tokens: list[int] = []
    follow: dict[int, int] = {}
    for k, x in enumerate(parse):
        follow[k] = len(tokens)
        tokens.append(names[x] + 1)
        if where[k][1] == where[k][2]:
            tokens.append(0)
    place = {at: r for r, at in enumerate(suffix_array(tokens))}
    keyed = []
    for k, (a, b, hi) in enumerate(where):
        after = place[follow[k] + 1]
        keyed += [(parse[k][i - a :], after, i, hi) for i in range(a, b)]
    keyed.sort(key=lambda x: x[:3])
    gone: set[int] = set()
    for (_, _, i, end), (_, _, j, stop) in zip(keyed, keyed[1:], strict=False):
        if i + length <= end and j + length <= stop and data[i : i + length] == data[j : j + length]:
            gone.update(range(i, i + length))
            gone.update(range(j, j + length))
    return [{i - lo for i in gone if lo <= i < hi} for lo, hi in zip(offs.tolist(), offs[1:].tolist(), strict=False)]
