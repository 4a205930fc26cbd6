"""Exact removal of repeated byte strings, by hash-compared suffix sorting of anchored blocks.

A byte goes if it lies in a length-byte string that starts anywhere else too, in the same text or
another; overlaps count, and strings are judged on the input. Null text counts as empty; texts
shorter than length keep everything; repeated rows are copies and lose everything from length bytes
on. Other columns pass by unchanged, whatever their names and types, null ids too. Ties of a hash go
to the leftmost gram; which of several equal strings is looked at makes no difference to the result.

Plan. Every window of length bytes picks an anchor: the leftmost gram of least hash in it. Equal
windows pick equal grams at equal offsets, and the windows of one anchor start in one run, so a
text is described by one row per anchor: gram hash, place and offsets, and a 128-bit digest
(BLAKE2b) of all bytes its windows span with the offsets. Texts are named by row numbers, which meet
the rows again by SHA-256. So nothing is removed on a short hash: bytes are equal by a cryptographic
digest or by comparison.
1. Counts by gram hash (summed before they are dealt out) leave the grams seen twice or more.
2. Anchors whose whole span is seen again are repeats as they stand, however many copies there are.
3. For the others, one block per gram of the distinct spans is suffix-sorted: a mergesort whose
   comparisons find the common extension of two suffixes by binary search over prefix polynomial
   hashes. Neighbours in the order are verified byte by byte. Windows at offset o are equal when
   both extensions reach their ends, so classes by common extension to the right and to the left
   give all repeats without comparing pairs.
4. Blocks of more than block_rows distinct spans are cut by a second anchor: the windows of a band
   of offsets share the bytes in the middle, so a span becomes one span per band, named by the
   gram, the band and the digest of those bytes, and goes through 2 and 3 again; bands of one window
   end it, since all spans of a block are then equal. Only digests seen twice go on.
Nothing is capped; what a task holds is bounded by block_rows and by single texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import dropped, map_batches, map_tasks, mix64, staged, text_of

GRAM = 32
BANDS = (16, 1)
_POS = 24
_BASE = 0x9E3779B97F4A7C55
_CHUNK = 500_000
_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, and powers of the base and of its inverse modulo 2**64; usual sizes are kept."""
    usual = _CHUNK + 8192
    if "byte" not in _cache or n > usual:
        out = {"byte": mix64(np.arange(1, 257, dtype=np.uint64), 11)}
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, usual), base, dtype=np.uint64)
            steps[0] = 1
            out[name] = np.multiply.accumulate(steps, out=steps)
        if n > usual:
            return out["byte"], out["pow"][:n], out["inv"][:n]
        _cache.update(out)
    return _cache["byte"], _cache["pow"][:n], _cache["inv"][:n]


class PrefixHash:
    """Polynomial hashes of all substrings of a byte array from one table of prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        byte, power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        tail = self.sums[1:]
        np.take(byte, data, out=tail)
        tail *= power[: len(data)]
        np.cumsum(tail, out=tail)

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.inverse[start]


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width values."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors_of(docs: list[bytes], length: int) -> pd.DataFrame:
    """doc, p, a, b, g, c1, c2: anchor p of document doc owns the windows that start in [a, b]."""
    whole = b"".join(docs)
    data = np.frombuffer(whole, dtype=np.uint8)
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    if len(data) < length:
        return pd.DataFrame({k: np.zeros(0, np.int64) for k in ("doc", "p", "a", "b", "g", "c1", "c2")})
    hashes = PrefixHash(data)
    grams = mix64(hashes.of(np.arange(len(data) - GRAM + 1), GRAM))
    low = np.uint64((1 << _POS) - 1)
    tagged = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    pick = (_window_min(tagged, length - GRAM + 1) & low).astype(np.int64)
    doc_of = np.repeat(np.arange(len(docs)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    starts = np.flatnonzero(doc_of[: len(pick)] == doc_of[length - 1 :])
    pick = pick[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (pick[1:] != pick[:-1]) | (doc_of[starts[1:]] != doc_of[starts[:-1]])
    at = np.flatnonzero(new)
    a, b = starts[at], starts[np.concatenate([at[1:], [len(starts)]]) - 1] if len(at) else starts[:0]
    p, doc = pick[at], doc_of[a]
    names = digests([whole[x:y] for x, y in zip(a.tolist(), (b + length).tolist(), strict=True)], p - a, b - a)
    f = first[doc]
    return pd.DataFrame({"doc": doc, "p": p - f, "a": a - f, "b": b - f, "g": grams[p].view(np.int64), "c1": names[:, 0], "c2": names[:, 1]})


def digests(spans: list[bytes], *marks: np.ndarray) -> np.ndarray:
    """Two longs for each span: a 128-bit BLAKE2b of its bytes, parted by marks, which are below 2**16."""
    salt = np.zeros((len(spans), 8), dtype="<u2")
    for i, m in enumerate(marks):
        salt[:, i] = m
    salts, make = salt.tobytes(), hashlib.blake2b
    got = b"".join([make(x, digest_size=16, salt=salts[16 * i : 16 * i + 16]).digest() for i, x in enumerate(spans)])
    return np.frombuffer(got, "<i8").reshape(-1, 2)


def _pieces(texts, length: int):
    """Batches of (row, offset, bytes) of about _CHUNK bytes; longer texts overlap by length-1."""
    held, size = [], 0
    for row, text in enumerate(texts):
        data = text_of(text).encode()
        for at in range(0, max(len(data) - length + 1, 0), _CHUNK):
            piece = data[at : at + _CHUNK + length - 1]
            if size and size + len(piece) > _CHUNK:
                yield held
                held, size = [], 0
            held.append((row, at, piece))
            size += len(piece)
    if held:
        yield held


def placed(p, back, more):
    """One long for an anchor's place, how far its first window starts before it, and its last after that."""
    return p * 65536 + back * 256 + more


def _anchor_rows(texts, rows: np.ndarray, length: int) -> pd.DataFrame:
    """g, c1, c2, row, at of the anchors of texts; rows are their numbers."""
    out = []
    for held in _pieces(texts, length):
        got = anchors_of([x[2] for x in held], length)
        row, at = np.array([x[0] for x in held]), np.array([x[1] for x in held])
        doc = got.pop("doc").to_numpy()
        got["at"] = placed(got.p + at[doc], got.p - got.a, got.b - got.a)
        got["row"] = rows[row[doc]]
        out.append(got[["g", "c1", "c2", "row", "at"]])
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({k: np.zeros(0, np.int64) for k in ("g", "c1", "c2", "row", "at")})


def common_extension(hashes: PrefixHash, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at i and j, up to most, by binary search."""
    lo, hi = np.zeros(len(i), dtype=np.int64), most.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi + 1) >> 1
        same = hashes.of(i, mid) == hashes.of(j, mid)
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)


def suffix_order(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes sorted within their group, and common prefixes of neighbours.

    A bottom-up mergesort: on each level every element finds its rank in the sibling run by binary
    search, and each probe compares two suffixes through their common extension, so one comparison
    costs a logarithm of the suffix length. group must be sorted. lcp[k] belongs to order[k-1] and
    order[k] and is -1 where a group begins.
    """
    n, hashes = len(start), PrefixHash(data)
    order = np.arange(n)
    begin = np.searchsorted(group, group, "left")
    end = np.searchsorted(group, group, "right")

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """x sorts before y; equal suffixes follow ties."""
        most = np.minimum(size[x], size[y])
        ext = common_extension(hashes, start[x], start[y], most)
        full = ext == most
        cx = data[np.minimum(start[x] + ext, len(data) - 1)]
        cy = data[np.minimum(start[y] + ext, len(data) - 1)]
        return np.where(full, np.where(size[x] == size[y], ties, size[x] < size[y]), cx < cy)

    width, widest = 1, int((end - begin).max(initial=0))
    while width < widest:
        k = np.arange(n)
        run = (k - begin) // width
        own = begin + run * width
        left = run % 2 == 0
        lo = np.where(left, np.minimum(own + width, end), own - width)
        hi = np.where(left, np.minimum(own + 2 * width, end), own)
        low, high = lo.copy(), hi.copy()
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            mid = (low[todo] + high[todo]) >> 1
            goes = before(order[mid], order[todo], ~left[todo])
            low[todo] = np.where(goes, mid + 1, low[todo])
            high[todo] = np.where(goes, high[todo], mid)
        base = np.where(left, own, own - width)
        merged = np.empty_like(order)
        merged[base + (k - own) + (low - lo)] = order
        order = merged
        width *= 2
    lcp = np.full(n, -1, dtype=np.int64)
    inner = np.flatnonzero(group[1:] == group[:-1]) + 1
    x, y = order[inner - 1], order[inner]
    most = np.minimum(size[x], size[y])
    lcp[inner] = common_extension(hashes, start[x], start[y], most)
    if not _verified(data, start, size, x, y, lcp[inner]):
        return _by_bytes(data, start, size, group)
    return order, lcp


def _verified(data, start, size, x, y, lcp) -> bool:
    """Bytes of neighbours agree up to their lcp, differ after it, and are in order."""
    for at in range(0, int(lcp.max(initial=0)) + 1):
        on = np.flatnonzero(lcp >= at)
        cx = np.where(at < size[x[on]], data[np.minimum(start[x[on]] + at, len(data) - 1)].astype(np.int16), -1)
        cy = np.where(at < size[y[on]], data[np.minimum(start[y[on]] + at, len(data) - 1)].astype(np.int16), -1)
        inside = lcp[on] > at
        if (cx[inside] != cy[inside]).any() or (cx[~inside] > cy[~inside]).any() or ((cx[~inside] == cy[~inside]) & (cx[~inside] >= 0)).any():
            return False
    return True


def _by_bytes(data, start, size, group) -> tuple[np.ndarray, np.ndarray]:
    """The same by plain comparison of bytes, for the case that two hashes collide."""
    text = [data[s : s + z].tobytes() for s, z in zip(start, size, strict=True)]
    order = np.array(sorted(range(len(text)), key=lambda i: (group[i], text[i], i)), dtype=np.int64)
    lcp = np.full(len(text), -1, dtype=np.int64)
    for k in range(1, len(text)):
        i, j = order[k - 1], order[k]
        if group[i] == group[j]:
            a, b = text[i], text[j]
            lcp[k] = next((m for m in range(min(len(a), len(b))) if a[m] != b[m]), min(len(a), len(b)))
    return order, lcp


def block_repeats(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """Runs (row, a, b) of repeated window starts among single spans of frame, whole blocks of g.

    frame: g, c1, c2, n (times the span occurs), row, at, span (the bytes from its first window on).
    """
    frame = frame.drop_duplicates(["g", "c1", "c2"]).sort_values(["g", "c1", "c2"], kind="stable", ignore_index=True)
    group = pd.factorize(frame["g"])[0].astype(np.int64)
    p, a, b = _unplaced(frame["at"].to_numpy(np.int64))
    spans = frame["span"].tolist()
    n = len(frame)
    cut, total = p - a, b - a + length
    sides = {}
    for name, texts in (("right", [s[c:] for s, c in zip(spans, cut, strict=True)]), ("left", [s[:c][::-1] for s, c in zip(spans, cut, strict=True)])):
        size = np.array([len(t) for t in texts], dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        data = np.frombuffer(b"".join(texts) + b"\0", dtype=np.uint8)
        sides[name] = suffix_order(data, start, size, group)
    assert (total == [len(s) for s in spans]).all(), "spans must hold the bytes of their windows"
    weight = frame["n"].to_numpy(np.int64)
    hit = np.zeros((n, length - GRAM + 1), dtype=bool)
    lowest, highest = p - b, p - a

    def classes(side: str, depth: int) -> np.ndarray:
        order, lcp = sides[side]
        out = np.empty(n, dtype=np.int64)
        out[order] = np.cumsum(lcp < depth)
        return out

    for o in range(int(lowest.min(initial=0)), int(highest.max(initial=-1)) + 1):
        on = np.flatnonzero((lowest <= o) & (o <= highest))
        key = classes("right", length - o)[on] * (n + 1) + classes("left", o)[on]
        code, uniques = pd.factorize(key)
        hit[on, o] = np.bincount(code, weight[on], len(uniques))[code] >= 2
    hit[weight > 1] = False
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    return pd.DataFrame({"row": frame["row"].to_numpy()[row], "a": p[row] - (after - 1), "b": p[row] - first})


def _unplaced(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p, a, b of placed()."""
    p = at >> 16
    a = p - (at >> 8 & 255)
    return p, a, a + (at & 255)


def _blocks(frames, length: int, rows: int = 5_000):
    """block_repeats over frames sorted by g, some whole blocks at a time."""
    held = None
    for frame in frames:
        held = frame if held is None or not len(held) else pd.concat([held, frame], ignore_index=True)
        if len(held) >= rows:
            last = held["g"] == held["g"].iloc[-1]
            if not last.all():
                yield block_repeats(held[~last], length)
                held = held[last].reset_index(drop=True)
    if held is not None and len(held):
        yield block_repeats(held, length)


def banded(frame: pd.DataFrame, length: int, width: int) -> pd.DataFrame:
    """One span per band of width offsets of each span, its block named by the bytes that the band's windows share."""
    out = []
    p, a, b = _unplaced(frame["at"].to_numpy(np.int64))
    for i, (g, n, row, span) in enumerate(zip(frame["g"], frame["n"], frame["row"], frame["span"], strict=True)):
        for band in range((p[i] - b[i]) // width, (p[i] - a[i]) // width + 1):
            lo, hi = max(a[i], p[i] - (band + 1) * width + 1), min(b[i], p[i] - band * width)
            middle = span[p[i] - band * width - a[i] : p[i] - (band + 1) * width + 1 + length - a[i]]
            out.append((g, band, middle, n, row, placed(p[i], p[i] - lo, hi - lo), span[lo - a[i] : hi + length - a[i]], p[i] - lo, hi - lo))
    got = pd.DataFrame(out, columns=["g", "band", "middle", "n", "row", "at", "span", "back", "more"])
    core = digests(got.pop("middle").tolist(), got["band"].to_numpy(np.int64)) if out else np.zeros((0, 2), np.int64)
    own = digests(got["span"].tolist(), got.pop("back").to_numpy(np.int64), got.pop("more").to_numpy(np.int64)) if out else core
    got["g"] = mix64(got["g"].to_numpy(np.int64).view(np.uint64) ^ core[:, 0].view(np.uint64), width).view(np.int64) if out else got["g"]
    got["c1"], got["c2"] = own[:, 0], own[:, 1]
    return got[["g", "c1", "c2", "n", "row", "at", "span"]]


NAME = ["g", "c1", "c2"]


def _first() -> Column:
    return F.struct("row", "at")


def settled(held: DataFrame, length: int, block_rows: int, bands: tuple[int, ...]) -> DataFrame:
    """(row, a, b): repeats among the spans of held (g, c1, c2, n, m, row, at, span), m per block."""
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = (
        held.where(F.col("m") <= block_rows)
        .drop("m")
        .repartition(parts, "g")
        .sortWithinPartitions("g")
        .mapInPandas(lambda frames: _blocks(frames, length), "row long, a long, b long")
    )
    hot = held.where(F.col("m") > block_rows)
    if not bands or hot.isEmpty():  # spans of one window each are all equal in their block, so none is left
        return out
    shape = "g long, c1 long, c2 long, n long, row long, at long, span binary"
    cut = staged(map_batches(hot.dropDuplicates(NAME).drop("m"), lambda f: banded(f, length, bands[0]), shape), "bands")
    spans = staged(cut.groupBy(*NAME).agg(F.sum("n").alias("n"), F.min(_first()).alias("one")), "band-spans")
    copied = cut.where("n = 1").join(spans.where("n > 1").select(*NAME), NAME, "left_semi").select("row", *_run(F.col("at")))
    sizes = staged(spans.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("least = 1 and m > 1").select("g", "m"), "band-sizes")
    wanted = spans.join(sizes, "g").select(*NAME, F.col("n").alias("t"), "m", "one.row", "one.at")
    rest = cut.join(wanted, [*NAME, "row", "at"]).select(*NAME, F.col("t").alias("n"), "m", "row", "at", "span")
    return out.unionAll(copied).unionAll(settled(staged(rest, "band-blocks"), length, block_rows, bands[1:]))


def _run(at: Column) -> list[Column]:
    """First and last window start of placed()."""
    a = F.shiftright(at, 16) - F.shiftright(at, 8).bitwiseAND(F.lit(255))
    return [a.alias("a"), (a + at.bitwiseAND(F.lit(255))).alias("b")]


def _named(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def repeats(df: DataFrame, text_col: str = "text", length: int = 200, block_rows: int = 2048) -> DataFrame:
    """(name, runs array<struct<a,b>>): runs of repeated window starts by text, name = SHA-256 of the text."""
    if not GRAM <= length <= 256:
        raise ValueError(f"length must be from {GRAM} to 256")
    text = F.coalesce(df[text_col], F.lit(""))

    def start():
        part, at = TaskContext.get().partitionId(), 0

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            nonlocal at
            numbers = (part << 33) + at + np.arange(len(frame))
            at += len(frame)
            got = _anchor_rows(frame["t"], numbers, length)
            own = np.flatnonzero(np.isin(numbers, got["row"].unique()))
            names = pd.DataFrame({k: np.zeros(len(own), np.int64) for k in ("g", "c1", "c2", "at")} | {"row": numbers[own]})
            names["name"] = [hashlib.sha256(frame["t"].iloc[i].encode()).digest() for i in own]
            return pd.concat([got.assign(name=None), names], ignore_index=True)

        return run

    shape = "g long, c1 long, c2 long, row long, at long, name binary"
    both = staged(map_tasks(df.select(text.alias("t")), start, shape), "anchors")
    rows = both.where("name is null").drop("name")
    texts = both.where("name is not null").select("row", "name")
    again = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}_{c}") for c in ("c1", "c2") for k, f in (("lo", F.min), ("hi", F.max)))).where("n > 1")
    # tables between a count and the join it serves: Spark splits a hot key only in a join by itself
    again = staged(again.select("g", F.expr("lo_c1 = hi_c1 and lo_c2 = hi_c2").alias("alike"), F.ceil(F.col("n") / 4096).cast("int").alias("salts")), "grams")
    seen = staged(rows.join(again, "g"), "again")
    alike = seen.where("alike").select("row", *_run(F.col("at")))
    mixed = seen.where("not alike").drop("alike")
    spans = staged(mixed.groupBy(*NAME).agg(F.count(F.lit(1)).alias("n"), F.min(_first()).alias("one"), F.first("salts").alias("salts")), "spans")
    # a gram that stands everywhere is dealt by salt too: one for every 4096 anchors that have it
    known = spans.where("n > 1").select(*NAME, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = mixed.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.col("salts")).cast("int"))
    copied = salted.join(known, [*NAME, "salt"], "left_semi").select("row", *_run(F.col("at")))
    sizes = spans.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("least = 1 and m > 1").select("g", "m")
    sizes = staged(sizes, "sizes")
    wanted = spans.join(sizes, "g").select(*NAME, "n", "m", "one.row", "one.at")
    # one row stands for all texts of a name; the copies of a text read its spans but once
    chosen = texts.groupBy("name").agg(F.min("row").alias("row"))
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct(*NAME, "n", "m", "at")).alias("w")).join(texts, "row")
    wanted = staged(wanted.groupBy("name").agg(F.flatten(F.collect_list(F.transform("w", lambda x: F.struct(*(x[c].alias(c) for c in (*NAME, "n", "m", "at")), F.col("row").alias("row"))))).alias("w")), "wanted")

    def fetched():
        done: set[bytes] = set()

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            out = []
            for name, t, w in zip(frame["name"], frame["t"], frame["w"], strict=True):
                if name not in done:
                    done.add(name)
                    data = t.encode()
                    _, a, b = _unplaced(np.array([x["at"] for x in w], dtype=np.int64))
                    out += [(*(x[c] for c in (*NAME, "n", "m", "row", "at")), data[i : j + length]) for x, i, j in zip(w, a.tolist(), b.tolist(), strict=True)]
            return pd.DataFrame(out, columns=[*NAME, "n", "m", "row", "at", "span"])

        return run

    keyed = df.select(_named(text).alias("name"), text.alias("t"))
    shape = "g long, c1 long, c2 long, n long, m long, row long, at long, span binary"
    held = staged(map_tasks(keyed.join(wanted, "name"), fetched, shape), "blocks")
    every = alike.unionAll(copied).unionAll(settled(held, length, block_rows, BANDS))
    ends = every.groupBy("row", "a").agg(F.max("b").alias("b"))
    runs = ends.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    runs = runs.join(texts, "row").join(chosen.select("row"), "row", "left_semi")
    out = staged(runs.select("name", "runs"), "runs")
    dropped(both, again, seen, spans, sizes, wanted, held)
    return out


def kept_bytes(data: bytes, runs, length: int) -> tuple[bytes, int]:
    """(what stays of data, number of maximal removed runs)."""
    kept, at, count = [], 0, 0
    for a, b in sorted((int(r["a"]), int(r["b"]) + length) for r in runs):
        if a > at or not count:
            kept.append(data[at:a])
            count += 1
        at = max(at, b)
    kept.append(data[at:])
    return b"".join(kept), count


def dedup(df: DataFrame, apply, schema: str, text_col: str = "text", length: int = 200) -> DataFrame:
    """df with the columns of schema, as apply(text, data, kept, spans) gives them for each row, in place of the text."""
    found = repeats(df, text_col, length)
    names = [c.split()[0] for c in schema.split(", ")]
    others = [c for c in df.columns if c != text_col]
    given = df.select(*(df[c].alias(f"k{i}") for i, c in enumerate(others)), df[text_col].alias("t"))
    joined = given.join(found, _named(F.coalesce(given["t"], F.lit(""))) == found["name"], "left").drop("name")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for text, runs in zip(frame["t"], frame["runs"], strict=True):
            data = text_of(text).encode()
            kept, spans = kept_bytes(data, runs, length) if runs is not None else (data, 0)
            rows.append(apply(text, data, kept, spans))
        return pd.DataFrame(rows, columns=[f"o{i}" for i in range(len(names))])

    made = ", ".join(f"o{i} {c.split()[1]}" for i, c in enumerate(schema.split(", ")))
    out = map_batches(joined, run, made, carry=[f"k{i}" for i in range(len(others))])
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(others)), *(F.col(f"o{i}").alias(n) for i, n in enumerate(names)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: what stays of every whole text of documents without its repeated 200-byte strings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def row(text, data: bytes, kept: bytes, spans: int):
        return len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()

    return dedup(docs, row, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: docs without repeated 200-byte strings, n_chars renewed.

    A character cut in half by a boundary goes whole; null texts stay null; every row stays, and of
    repeated rows each loses what repeats.
    """
    got = dedup(docs, lambda text, data, kept, spans: (text if not spans else kept.decode("utf-8", "ignore"),), "text string")
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return got.select(docs.columns)
