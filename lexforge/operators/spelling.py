"""Spelling: candidates within two edits, exact close matches, ranked suggestions, corrected texts.

Candidates come from a deletion neighbourhood: a vocabulary word and a token at most two edits apart
(insert, delete, replace, swap of neighbours) share a string that each reaches by at most two
deletions, so an equi-join on hashed deletions finds every pair whatever its first letter or length.
Words of over LONG letters are met by a fifth of their letters instead, since two edits leave one
fifth whole within two places, so a token of a million letters costs 125 hashes. Close matches
share letters: a pair that may be close shares one of the rarest letters of both, and only pairs
with enough letters in common are compared.

Nulls and empty words match nothing; repeated words count once; a null text stays out of the result,
an empty one comes back empty. White space is space and tab to carriage return.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.functions.normalize import bound
from lexforge.session import cut, text_runs, written

LONG, MOST, FIFTHS = 24, 2, 5
TOKEN = "[^ \t\n\x0b\f\r]+"
_WHITE = " \t\n\x0b\f\r"
_IS_WHITE = np.isin(np.arange(256), [ord(c) for c in _WHITE])
_ALONE = r"^[^a-zA-Z؀-ۿ]+$|[_-]|^[a-z]+[A-Z]|^[A-Z][a-z]+[A-Z]|\.[\p{L}\p{N}_]{1,4}$|^.$"
# Reserved words of Python, never corrected.
KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()


# --- candidates within two edits


def _mixed(h: np.ndarray, *marks: int) -> np.ndarray:
    """Hashes of equal value for equal strings of equal marks, spread over 64 bits."""
    with np.errstate(over="ignore"):
        for m in marks:
            h = h * _BASE + np.uint64(m)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def near_hashes(words: list[str], vocabulary: bool, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word in words, hash): what a word and another at most two edits away have in common.

    Words of up to LONG letters give the hashes of all strings with up to two letters less, longer
    ones of a vocabulary those of their fifths, with number and length; tokens of like length give
    what may stand in the place of such a fifth. Hashes are sums over letters, so all of a word's
    come from the sums of its beginnings, for all words of one length at once. With most 1, words give
    the strings with up to one letter less, and no fifths.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    owners, hashes = [], []
    with np.errstate(over="ignore"):
        for n in np.unique(sizes):
            n = int(n)
            of = np.flatnonzero(sizes == n)
            powers = np.cumprod(np.array([1] + [_BASE] * (n + MOST), dtype=np.uint64))
            for some in np.array_split(of, len(of) * (n + 1) * 8 // 4_000_000 + 1):
                letters = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(some), n).astype(np.uint64) + np.uint64(1)
                begin = np.zeros((len(some), n + 1), dtype=np.uint64)  # begin[:, k] is the hash of the first k letters
                for k in range(n):
                    begin[:, k + 1] = begin[:, k] * _BASE + letters[:, k]
                part = lambda i, j: begin[:, j] - begin[:, i] * powers[j - i]  # noqa: E731  letters i to j
                found = []
                if n <= LONG + (0 if vocabulary else MOST):
                    i = np.arange(n)
                    found += [_mixed(begin[:, n:], n), _mixed(begin[:, i] * powers[n - 1 - i] + part(i + 1, np.full(n, n)), n - 1)]
                    i, j = np.triu_indices(n, 1) if most > 1 else (np.zeros(0, dtype=np.int64),) * 2
                    found.append(_mixed(begin[:, i] * powers[n - 2 - i] + part(i + 1, j) * powers[n - 1 - j] + part(j + 1, np.full(len(j), n)), n - 2) if n > 1 else np.zeros((len(some), 0), dtype=np.uint64))
                for other in [0] if vocabulary else range(-MOST, MOST + 1):
                    long_ = n + other
                    edges = [long_ * e // FIFTHS for e in range(FIFTHS + 1)]
                    for e in range(FIFTHS if long_ > LONG and most > 1 else 0):
                        for s in [0] if vocabulary else range(-MOST, MOST + 1):
                            at, to = edges[e] + s, edges[e + 1] + s
                            if 0 <= at and to <= n:
                                found.append(_mixed(part(np.array([at]), np.array([to])), e, long_))
                flat = np.concatenate(found, axis=1) if found else np.zeros((len(some), 0), dtype=np.uint64)
                owners.append(np.repeat(some, flat.shape[1]))
                hashes.append(flat.ravel())
    return (np.concatenate(owners), np.concatenate(hashes)) if owners else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))


_BASE = np.uint64(0x5851F42D4C957F2D)


def _hashed(words: DataFrame, vocabulary: bool, bits: tuple[int, np.ndarray] | None = None) -> DataFrame:
    """word, h of every word; with a filter, only hashes that it lets through."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 4096):
                some = frame["word"].iloc[at : at + 4096].tolist()
                owner, h = near_hashes(some, vocabulary)
                if bits is not None:
                    place = h >> np.uint64(64 - bits[0])
                    on = (bits[1][(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    owner, h = owner[on], h[on]
                yield pd.DataFrame({"word": np.array(some, dtype=object)[owner], "h": h.view(np.int64)}).drop_duplicates()

    return words.mapInPandas(run, "word string, h long")


def _filter(index: DataFrame, most_bits: int = 27) -> tuple[int, np.ndarray]:
    """(number of leading bits, a bit for each beginning that a hash of index has): sixteen bits a hash, 16 MB at most."""
    n = max(15, min(most_bits, (16 * index.count()).bit_length()))
    place = F.shiftrightunsigned("h", 64 - n)

    def drawn(frame: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(4096, dtype=np.uint8)
        at = frame["p"].to_numpy() & 0x7FFF
        np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pd.DataFrame({"g": [frame["p"].iloc[0] >> 15], "b": [own.tobytes()]})

    out = np.zeros(1 << (n - 3), dtype=np.uint8)
    rows = index.select(place.alias("p")).distinct().groupBy(F.shiftright("p", 15)).applyInPandas(drawn, "g long, b binary")
    for r in rows.toLocalIterator():
        out[r["g"] * 4096 : (r["g"] + 1) * 4096] = np.frombuffer(r["b"], dtype=np.uint8)
    return n, out


def within_two(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distance with swaps of neighbours of each pair, 3 where it is more than two."""
    size = lambda words: np.array([len(w) for w in words], dtype=np.int64)
    return _distances(a, np.arange(len(a)), size(a), b, np.arange(len(b)), size(b))


def _distances(a: list[str], of: np.ndarray, n: np.ndarray, b: list[str], to: np.ndarray, m: np.ndarray) -> np.ndarray:
    """within_two of the words at places of in a and to in b, of lengths n and m.

    Five diagonals of every pair's table are filled at once, row by row, for pairs of like length; a
    word's letters are laid out once for all its pairs of a run.
    """
    out = np.full(len(n), MOST + 1)
    order = np.flatnonzero(np.abs(n - m) <= MOST)
    order = order[np.argsort(n[order], kind="stable")]
    runs, start = [], 0
    while start < len(order):  # a run's longest word is at most about twice its shortest, and its letters are bounded
        most = 2 * int(n[order[start]]) + 8
        end = min(int(np.searchsorted(n[order], most, "right")), start + max(1, 1_200_000 // most))
        runs.append(order[start:end])
        start = end
    for some in runs:
        longest = int(max(n[some].max(), m[some].max()))
        pad = 4

        def letters(words: list[str], at: np.ndarray, end: int, width: int = longest + 2 * pad) -> np.ndarray:
            used, place = np.unique(at, return_inverse=True)
            padded = "".join([f"{chr(end) * pad}{words[k]}".ljust(width, chr(end)) for k in used.tolist()])
            return np.ascontiguousarray(np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(used), width).T[:, place])

        x, y = letters(a, of[some], 1), letters(b, to[some], 2)
        far, band = 9, range(2 * MOST + 1)
        row = np.full((2 * MOST + 3, len(some)), far, dtype=np.int8)  # line o + 1 holds place j = i + o - MOST
        row[MOST + 1 : 2 * MOST + 2] = np.arange(MOST + 1)[:, None]
        rows = [row, np.full_like(row, far), np.full_like(row, far)]
        goal = np.clip(m[some] - n[some] + MOST + 1, 1, 2 * MOST + 1)
        best = np.where(n[some] == 0, row[goal, np.arange(len(some))], MOST + 1)
        for i in range(1, int(n[some].max()) + 1):
            now = np.full_like(row, far)
            at = lambda w, k: w[pad + k - 1]  # noqa: E731  the k-th letter, from 1
            for o in band:
                j = i + o - MOST
                if j < 0:
                    continue
                if j == 0:
                    now[o + 1] = i
                    continue
                value = np.minimum(rows[0][o + 1] + (at(x, i) != at(y, j)).view(np.int8), np.minimum(rows[0][o + 2], now[o]) + 1)
                if i > 1 and j > 1:
                    value = np.where((at(x, i) == at(y, j - 1)) & (at(x, i - 1) == at(y, j)), np.minimum(value, rows[1][o + 1] + 1), value)
                if i > 1 and j > 2:
                    value = np.where((at(x, i - 1) == at(y, j)) & (at(x, i) == at(y, j - 2)), np.minimum(value, rows[1][o] + 2), value)
                if i > 2 and j > 1:
                    value = np.where((at(x, i - 2) == at(y, j)) & (at(x, i) == at(y, j - 1)), np.minimum(value, rows[2][o + 2] + 2), value)
                now[o + 1] = value
            ends = np.flatnonzero(n[some] == i)
            best[ends] = now[goal[ends], ends]
            rows = [now, rows[0], rows[1]]
        out[some] = np.minimum(best, MOST + 1)
    return out


@F.pandas_udf(T.IntegerType())
def swaps_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """within_two of two word columns; no built-in counts a swap as one edit."""
    return pd.Series(within_two(a.tolist(), b.tolist()).astype("int32"))


def edit_candidates(tokens: DataFrame, vocabulary: DataFrame, most_shared: int = 100_000, most_slices: int = 8) -> DataFrame:
    """word, candidate, distance: every pair of tokens(word) and vocabulary(word) at most two edits apart.

    Both sides are made distinct. A vocabulary of up to most_slices times most_shared words is hashed
    in slices whose sorted hashes go to every task, so only the tokens are shuffled. A larger one is
    written as an index of hashes, tokens give up the hashes that the index's filter lets through,
    and the two are joined; a pair that shares several is kept once, before its letters are compared.
    """
    words = lambda df: df.select("word").where(F.col("word") != "").distinct()
    known = cut(words(vocabulary))
    count = known.count()
    if count <= most_shared * most_slices:
        listed, asked = sorted(r["word"] for r in known.collect()), written(words(tokens))
        slices = [listed[at : at + most_shared] for at in range(0, max(1, count), max(1, most_shared))]
        return reduce(DataFrame.unionAll, [_looked_up(asked, s) for s in slices])
    index = written(_hashed(known, True))
    left = _hashed(words(tokens), False, _filter(index))
    fits = F.abs(F.char_length("word") - F.char_length("candidate")) <= MOST
    pairs = left.join(index.withColumnRenamed("word", "candidate"), "h").where(fits).select("word", "candidate").distinct()
    plain = F.levenshtein("word", "candidate", 2 * MOST)  # a swap is two plain edits
    near = pairs.withColumn("plain", plain).where("plain >= 0")
    sure = near.where("plain < 2").select("word", "candidate", F.col("plain").alias("distance"))
    rest = near.where("plain >= 2").select("word", "candidate", swaps_distance("word", "candidate").alias("distance"))
    return sure.unionAll(rest.where(F.col("distance") <= MOST))


class _Index(NamedTuple):
    """The hashes of words, sorted: a bucket is named by a hash's first bits, an entry holds the next ones and the word's place in own bits."""

    words: list[str]
    bits: int
    own: int
    starts: np.ndarray  # the first entry of each bucket, and the end
    entries: np.ndarray
    met: np.ndarray  # a bit for each beginning of bits + 5 bits that a hash has: most hashes of a token stop here


def _near_index(words: list[str], most: int = MOST) -> _Index:
    """Four bytes a hash, about 200 a word of nine letters with most 2."""
    own = max(1, (len(words) - 1).bit_length())
    low = np.uint64((1 << own) - 1)
    keys = [np.zeros(0, dtype=np.uint64)]
    for at in range(0, len(words), 65_536):
        owner, h = near_hashes(words[at : at + 65_536], True, most)
        keys.append((h & ~low) | (owner + at).astype(np.uint64))
    keys = np.concatenate(keys)
    keys.sort()
    bits = min(28, max(8, len(keys).bit_length() - 3))
    starts = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys)).astype(np.uint32)
    entries, on = np.empty(len(keys), dtype=np.uint32), np.zeros(1 << (bits + 5), dtype=bool)
    for at in range(0, len(keys), 4_000_000):
        some = keys[at : at + 4_000_000]
        entries[at : at + 4_000_000] = (_marked(some, bits, own) << np.uint32(own)) | (some & low).astype(np.uint32)
        on[(some >> np.uint64(59 - bits)).astype(np.int64)] = True
    return _Index(words, bits, own, starts, entries, np.packbits(on, bitorder="little"))


def _marked(h: np.ndarray, bits: int, own: int) -> np.ndarray:
    """The bits of hashes that an entry holds."""
    return ((h << np.uint64(bits)) >> np.uint64(32 + own)).astype(np.uint32)


def _near_pairs(index: _Index, lengths: np.ndarray, some: list[str], most: int = MOST, at_once: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in some, place in the index's words, distance) of all pairs at most most edits apart, each once.

    Entries are compared at_once at a time, since many short words may share a hash.
    """
    place, h = near_hashes(some, False, most)
    begin = (h >> np.uint64(59 - index.bits)).astype(np.int64)
    on = ((index.met[begin >> 3] >> (begin & 7).astype(np.uint8)) & 1).view(bool)
    place, h, bucket = place[on], h[on], begin[on] >> 5
    first = index.starts[bucket].astype(np.int64)
    many = index.starts[bucket + 1] - first
    mark, ends = _marked(h, index.bits, index.own), np.cumsum(many)
    sizes, found, at = np.array([len(w) for w in some], dtype=np.int64), [], 0
    while at < len(place):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, "right")))
        n = many[at:to]
        hit = np.repeat(first[at:to] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        entry, of = index.entries[hit], np.repeat(np.arange(at, to), n)
        same = (entry >> np.uint32(index.own)) == mark[of]
        token, candidate = place[of[same]], (entry[same] & np.uint32((1 << index.own) - 1)).astype(np.int64)
        fits = np.abs(sizes[token] - lengths[candidate]) <= most
        met = np.sort(token[fits] * len(lengths) + candidate[fits])
        token, candidate = np.divmod(met[np.diff(met, prepend=-1) > 0], max(1, len(lengths)))
        distance = _distances(some, token, sizes[token], index.words, candidate, lengths[candidate])
        near = distance <= most
        found.append((token[near], candidate[near], distance[near]))
        at = to
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    token, candidate, distance = (np.concatenate(x) for x in zip(*found))
    if len(found) > 1:
        once = np.unique(token * len(lengths) + candidate, return_index=True)[1]
        token, candidate, distance = token[once], candidate[once], distance[once]
    return token, candidate, distance


def _looked_up(tokens: DataFrame, known: list[str]) -> DataFrame:
    """edit_candidates of distinct tokens among a vocabulary that every task may hold."""
    shared = tokens.sparkSession.sparkContext.broadcast(_near_index(known))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        lengths = np.array([len(w) for w in index.words], dtype=np.int64)
        for frame in frames:
            for at in range(0, len(frame), 2048):
                some = frame["word"].iloc[at : at + 2048].tolist()
                token, candidate, distance = _near_pairs(index, lengths, some)
                if len(token):  # a frame of empty lists has no strings' type, which Arrow refuses
                    yield pd.DataFrame({"word": [some[i] for i in token], "candidate": [index.words[i] for i in candidate], "distance": distance})

    return tokens.mapInPandas(run, "word string, candidate string, distance int")


# --- close matches


def close_pairs(queries: DataFrame, vocabulary: DataFrame, share: float, need: Column) -> DataFrame:
    """query, word: pairs that have need (of columns x and y, their lengths) letters in common.

    share is the least part of a query's or a word's own letters that every such pair has in common:
    that many less one are left out, the commonest ones, and what remains must meet. A pair joins at
    the first letter of its order that both kept, so it comes once.
    """
    q = queries.select(F.col("word").alias("query")).where(F.col("query") != "").distinct()
    v = vocabulary.select("word").where(F.col("word") != "").distinct()
    letters = q.select(F.lit(0).alias("side"), F.col("query").alias("w")).unionAll(v.select(F.lit(1).alias("side"), F.col("word").alias("w"))).select("side", "w", F.explode(F.split("w", "")).alias("c"))
    counted = letters.where("c <> ''").groupBy("side", "w", "c").agg(F.count(F.lit(1)).cast("int").alias("n"))
    flat = written(counted.select("side", "w", F.explode(F.transform(F.sequence(F.lit(1), "n"), lambda i: F.concat("c", i.cast("string")))).alias("t")))  # a letter and which of its kind it is
    often = flat.where("side = 1").groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    flat = flat.join(often, "t", "left")
    ranked = flat.groupBy("side", "w").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("r"))  # one entry per letter of a word
    size = F.size("r")
    kept = written(ranked.select("side", "w", size.alias("n"), F.transform("r", lambda r: r.t).alias("b"), F.slice("r", F.lit(1), (size - F.ceil(size * share - 1e-9) + 1).cast("int")).alias("p")))
    side = lambda k, w, n: kept.where(F.col("side") == k).select(F.col("w").alias(w), F.col("n").alias(n), F.col("b").alias(f"b{k}"), F.col("p").alias(f"p{k}"), F.explode("p").alias("e")).withColumn("t", F.col("e.t"))
    both = side(0, "query", "x").drop("e").join(side(1, "word", "y").drop("e"), "t")
    first = F.array_min(F.array_intersect("p0", "p1"))
    enough = F.size(F.array_intersect("b0", "b1")) >= need
    return both.where((need <= F.least("x", "y")) & (F.col("t") == first["t"]) & enough).select("query", "word")


def _closest(scored: DataFrame, n: int, last: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), last))
    return scored.withColumn("r", rank).where(F.col("r") <= n).select("query", "word", "similarity")


def close_words(queries: DataFrame, vocabulary: DataFrame, n: int = 5, least: float = 0.45) -> DataFrame:
    """query, word, similarity: the n words of greatest 1 - edits / longer length, at least least; ties by word.

    All words of the vocabulary take part: least edits leave least of the longer word's letters in common.
    """
    pairs = close_pairs(queries, vocabulary, least, F.ceil(F.greatest("x", "y") * least - 1e-9))
    longer = F.greatest(F.char_length("query"), F.char_length("word"))
    scored = pairs.withColumn("similarity", 1 - F.levenshtein("query", "word") / longer).where(F.col("similarity") >= least)
    return _closest(scored, n, F.asc("word"))


@F.pandas_udf(T.DoubleType())
def matched_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in matching blocks over both lengths; the second word is indexed once per run of rows."""
    out, matcher, seen = [], difflib.SequenceMatcher(), None
    for x, y in zip(a, b, strict=True):
        if y != seen:
            matcher.set_seq2(y)
            seen = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def matching_words(queries: DataFrame, vocabulary: DataFrame, n: int = 5, cutoff: float = 0.45) -> DataFrame:
    """query, word, similarity: the n words of greatest matched share, at least cutoff; ties by falling word."""
    pairs = close_pairs(queries, vocabulary, cutoff / (2 - cutoff), F.ceil((F.col("x") + F.col("y")) * cutoff / 2 - 1e-9))
    scored = pairs.sortWithinPartitions("query").withColumn("similarity", matched_share("word", "query")).where(F.col("similarity") >= cutoff)
    return _closest(scored, n, F.desc("word"))


# --- suggestions


def _at_hand(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, marked for a broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= most else df


def voted(votes: DataFrame, least: int = 1) -> DataFrame:
    """word, correction, n: the most voted correction of each lower-cased word, ties to the smallest, that differs from it."""
    counts = votes.select(F.lower(F.trim("original")).alias("word"), F.trim("corrected").alias("correction")).where("word <> correction").groupBy("word", "correction").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("n"), "correction")).alias("b"))
    return best.select("word", "b.correction", (-F.col("b.n")).alias("n")).where(F.col("n") >= least)


def suggestions(words: DataFrame, vocabulary: DataFrame, fixes: DataFrame, votes: DataFrame, protected: list[str], n: int = 5, pool: int = 300, cutoff: float = 0.45, last_cutoff: float = 0.72) -> DataFrame:
    """word, rank, suggestion, origin: up to n unlike suggestions, best first.

    In order: the most voted correction, the fixed one of fixes(word, correction), close matches
    among the pool most frequent words of vocabulary(word, count), candidates within two edits if the
    word is unknown (nearest, then most frequent), and, where all of these give nothing, close
    matches among the words that have fixes. Protected words get none.
    """
    closed = F.lower("word").isin([p.lower() for p in protected])
    asked = cut(words.select("word").where((F.trim("word") != "") & ~closed).distinct())
    counts = vocabulary.groupBy("word").agg(F.max("count").alias("count"))
    top = counts.orderBy(F.desc("count"), "word").limit(pool)
    out = lambda df, order, origin, inner: df.select("word", F.col("suggestion"), F.lit(order).alias("o"), inner.cast("double").alias("i"), F.lit(origin).alias("origin"))
    by_vote = asked.withColumn("k", F.lower(F.trim("word"))).join(voted(votes).select(F.col("word").alias("k"), F.col("correction").alias("suggestion")), "k")
    by_fix = asked.join(fixes.groupBy("word").agg(F.min("correction").alias("suggestion")), "word")
    close = matching_words(asked, top, n, cutoff)
    unknown = asked.withColumn("k", F.lower("word")).join(counts.select(F.col("word").alias("k")), "k", "left_anti").select("word")
    edits = edit_candidates(unknown, counts).join(counts.withColumnRenamed("word", "candidate"), "candidate")
    by_edit = edits.withColumn("i", F.row_number().over(Window.partitionBy("word").orderBy("distance", F.desc("count"), "candidate"))).where(F.col("i") <= n)
    named = close.select(F.col("query").alias("word"), F.col("word").alias("suggestion"), (1 - F.col("similarity")).alias("i"))
    first = out(by_vote, 0, "vote", F.lit(0)).unionAll(out(by_fix, 1, "fix", F.lit(0))).unionAll(out(named, 2, "close", F.col("i"))).unionAll(out(by_edit.withColumnRenamed("candidate", "suggestion"), 3, "edit", F.col("i")))
    first = cut(first.where("suggestion <> word"))
    left = asked.join(first.select("word").distinct(), "word", "left_anti")
    final = matching_words(left, fixes.select("word"), n, last_cutoff).select(F.col("query").alias("word"), F.col("word").alias("suggestion"), (1 - F.col("similarity")).alias("i"))
    all_ = first.unionAll(out(final.where("suggestion <> word"), 4, "fixed word", F.col("i")))
    once = all_.groupBy("word", "suggestion").agg(F.min(F.struct("o", "i", "origin")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("b.o", "b.i", F.desc("suggestion")))
    return once.withColumn("rank", rank).where(F.col("rank") <= n).select("word", "rank", "suggestion", F.col("b.origin").alias("origin"))


# --- texts


def left_alone(w: Column, protected: list[str]) -> Column:
    """Words that are never corrected: numbers and signs, reserved and protected words, code, file names, single letters.

    Also words of which neither Latin nor Arabic letters make up more than half.
    """
    kept = [*KEYWORDS, *protected]
    half = lambda p: 2 * F.regexp_count(w, F.lit(p)) > F.char_length(w)
    script = w.rlike("^[a-zA-Z]+$") | half("[a-zA-Z]") | half("[؀-ۿ]")
    return w.isin(kept) | F.lower(w).isin(kept) | w.rlike(_ALONE) | ~script


def corrections(tokens: DataFrame, vocabulary: DataFrame, votes: DataFrame, protected: list[str], min_votes: int = 2) -> DataFrame:
    """word, correction of the distinct tokens(word) that change: the voted one, else the best candidate.

    A voted correction needs min_votes. Words of up to two letters and known words (lower-cased, in
    vocabulary(word, count)) get no candidate; others get the nearest, of these the most frequent,
    of these the smallest.
    """
    open_ = tokens.select("word").distinct().where(~left_alone(F.col("word"), protected)).withColumn("k", F.lower("word"))
    learned = _at_hand(cut(voted(votes, min_votes).select(F.col("word").alias("k"), F.col("correction").alias("voted"))))
    counts = _at_hand(cut(vocabulary.groupBy(F.col("word").alias("candidate")).agg(F.max("count").alias("count"))))
    state = written(open_.join(learned, "k", "left").join(counts.select(F.col("candidate").alias("k"), F.lit(True).alias("known")), "k", "left"))
    lost = state.where("voted is null and known is null and char_length(word) > 2")
    near = edit_candidates(lost.select(F.col("k").alias("word")), counts.select(F.col("candidate").alias("word"))).join(counts, "candidate")
    best = near.groupBy(F.col("word").alias("k")).agg(F.min(F.struct("distance", (-F.col("count")).alias("c"), "candidate"))["candidate"].alias("correction"))
    by_edit = lost.join(best, "k").select("word", "correction")
    by_vote = state.where("voted is not null").select("word", F.col("voted").alias("correction"))
    return by_vote.unionAll(by_edit).where("word <> correction")


def corrected_texts(df: DataFrame, key: str, text: str, vocabulary: DataFrame, votes: DataFrame, protected: list[str], min_votes: int = 2, most_broadcast: int = 1_000_000, most_known: int = 1_000_000) -> DataFrame:
    """key, corrected, changes array<struct<original, corrected, position>>, n_changes, a row per row with a text.

    White space after a word stays as it is, white space before the first word goes. A position
    counts code points of the corrected text. A vocabulary and votes of up to most_known words (and
    most_broadcast) go to every task, which corrects its own texts, so nothing else travels; a
    word takes about 400 bytes there. Beyond that texts are written in runs of some megabytes and
    only a run's distinct words travel. Up to most_broadcast words that change go to every task,
    more are brought to their runs by a join.
    """
    vocabulary, learned = cut(vocabulary), cut(voted(votes, min_votes))
    shape = T.StructType().add("key", df.schema[key].dataType).add("corrected", "string").add("changes", _CHANGES).add("n_changes", "long")
    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("t"))
    if vocabulary.count() + learned.count() <= min(most_known, most_broadcast):
        return _corrected_in_place(texts, shape, vocabulary, learned, protected).withColumnRenamed("key", key)
    runs = written(texts.mapInArrow(_numbered, T.StructType().add("run", "long").add("key", df.schema[key].dataType).add("t", "string")))  # numbers hold once they are written
    words = written(runs.select("run", "t").mapInArrow(lambda batches: _words_of_runs(batches, protected), "run long, word string"))
    fixed = written(corrections(words.select("word"), vocabulary, votes, protected, min_votes))
    if fixed.count() <= most_broadcast:
        shared = df.sparkSession.sparkContext.broadcast({r["word"]: r["correction"] for r in fixed.collect()})
        got = runs.select("key", "t").mapInArrow(lambda batches: (_rebuilt(run, shared.value) for batch in batches for run in text_runs(batch, "t", 8_000_000)), shape)
    else:
        hits = words.join(fixed, "word")  # at most a run's own words

        def put_in(run: pa.Table, hits: pa.Table) -> pa.Table:
            new = dict(zip(hits["word"].to_pylist(), hits["correction"].to_pylist()))
            return pa.Table.from_batches([_rebuilt(batch, new) for batch in run.select(["key", "t"]).to_batches()])

        got = runs.groupBy("run").cogroup(hits.groupBy("run")).applyInArrow(put_in, shape)
    return got.withColumnRenamed("key", key)


_CHANGES = T.ArrayType(T.StructType().add("original", "string").add("corrected", "string").add("position", "integer"))


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in runs of about four megabytes, each with a number of its own."""
    run, held = TaskContext.get().partitionId() << 33, 0
    for batch in batches:
        for some in text_runs(batch, "t", 1_000_000):
            if held > 3_000_000:
                run, held = run + 1, 0
            held += some.column("t").nbytes
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.num_rows, run)), some.column("key"), some.column("t")], ["run", "key", "t"])


def _words_of_runs(batches: Iterable[pa.RecordBatch], protected: list[str]) -> Iterator[pa.RecordBatch]:
    """run, word of the distinct words that are not left alone; a run that two batches share may give one twice."""
    for batch in batches:
        run = batch.column("run").to_numpy()
        edges = np.flatnonzero(np.diff(run, prepend=-1, append=-1))
        for at, to in zip(edges[:-1].tolist(), edges[1:].tolist()):
            for some in text_runs(batch.slice(at, to - at), "t", 8_000_000):
                open_ = _not_left_alone([w for w in _pieces(some.column("t"))[0].to_pylist() if w[0] not in _WHITE], protected)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(open_), run[at])), pa.array(open_, pa.string())], ["run", "word"])


def _corrected_in_place(texts: DataFrame, shape: T.StructType, vocabulary: DataFrame, learned: DataFrame, protected: list[str]) -> DataFrame:
    """corrected_texts of texts(key, t) with corrections() worked out per run of texts, for their distinct words at once."""
    counts = vocabulary.where("word <> ''").groupBy("word").agg(F.max("count").alias("count")).toArrow().sort_by("word")
    told = learned.select("word", "correction").toArrow()
    told = dict(zip(told["word"].to_pylist(), told["correction"].to_pylist()))
    listed, often = counts["word"].to_pylist(), counts["count"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast((_near_index(listed, 1), _near_index(listed), often, told))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, often, told = shared.value
        words, lengths = one.words, np.array([len(w) for w in one.words], dtype=np.int64)
        known, best = set(words), {}

        def nearest(asked: list[str], index: _Index, most: int) -> None:
            """Puts the best candidate within most edits of each word in best."""
            for at in range(0, len(asked), 4096):
                some = asked[at : at + 4096]
                token, candidate, distance = _near_pairs(index, lengths, some, most)
                order = np.lexsort((candidate, -often[candidate], distance, token))
                first = order[np.flatnonzero(np.diff(token[order], prepend=-1))]
                best.update((some[t], words[c]) for t, c in zip(token[first].tolist(), candidate[first].tolist()))

        def fixed(found: set[str]) -> dict[str, str]:
            """What becomes of the words that change; see corrections()."""
            lowered = {w: w.lower() for w in found}
            open_ = _not_left_alone([w for w, k in lowered.items() if k in told or (len(w) > 2 and k not in known)], protected)
            if len(best) > 400_000:  # what was looked up for the texts before is kept up to there
                best.clear()
            asked = {k for w in open_ if (k := lowered[w]) not in told and k not in best}
            # a candidate one edit away goes before all others, and words under LONG letters meet all of these in one
            nearest(sorted(k for k in asked if len(k) < LONG), one, 1)
            nearest(sorted(k for k in asked if k not in best), two, MOST)
            best.update((k, None) for k in asked if k not in best)
            new = {w: told[k] if (k := lowered[w]) in told else best[k] for w in open_}
            return {w: c for w, c in new.items() if c is not None and c != w}

        for batch in batches:
            for some in text_runs(batch, "t", 8_000_000):
                yield _rebuilt(some, fixed)

    return texts.mapInArrow(run, shape)


def _not_left_alone(words: list[str], protected: list[str]) -> list[str]:
    """Those of words that are not left_alone()."""
    if not words:
        return []
    kept, w = {*KEYWORDS, *protected}, pa.array(words, pa.string())
    ends, data = np.frombuffer(w.buffers()[1], dtype=np.int32)[: len(w) + 1], np.frombuffer(w.buffers()[2] or b"", dtype=np.uint8)
    many = lambda on: np.diff(np.concatenate([[0], np.cumsum(on)])[ends])  # noqa: E731  bytes of each word
    low = data | 32
    latin, arabic, size = many((low >= 97) & (low <= 122)), many((data >= 0xD8) & (data <= 0xDB)), many((data & 0xC0) != 0x80)  # these four bytes begin the letters of U+0600 to U+06FF
    open_ = ((2 * latin > size) | (2 * arabic > size)) & ~pc.match_substring_regex(w, _ALONE).to_numpy(zero_copy_only=False)
    return [x for i in np.flatnonzero(open_).tolist() if (x := words[i]) not in kept and x.lower() not in kept]


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words and runs of white space of texts without nulls: the distinct ones, the number of each in turn, the first piece of each text and the end."""
    texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    white = _IS_WHITE[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[1:-1] = white[1:] != white[:-1]
    begins[ends - ends[0]] = True
    starts = np.flatnonzero(begins[:-1])
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data))
    coded = pieces.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(starts, ends - ends[0])


def _put_in(distinct: pa.Array, codes: np.ndarray, firsts: np.ndarray, found: list[str], new: dict[str, str]) -> list[pa.Array]:
    """corrected, changes, n_changes of texts given as _pieces(), found being the distinct ones."""
    hit = np.array([i for i, w in enumerate(found) if w in new], dtype=np.int64)
    every = pa.concat_arrays([distinct, pa.array([new[found[i]] for i in hit.tolist()], pa.string()), pa.array([""], pa.string())])
    becomes = np.arange(len(distinct))
    becomes[hit] = len(distinct) + np.arange(len(hit))
    now = becomes[codes]
    blank = np.array([w[0] in _WHITE for w in found], dtype=bool)
    lead = firsts[:-1][firsts[:-1] < firsts[1:]]
    now[lead[blank[codes[lead]]]] = len(every) - 1  # white space before the first word goes
    made = every.take(pa.array(now))
    ends = np.frombuffer(made.buffers()[1], dtype=np.int32)[firsts] if len(made) else np.zeros(len(firsts), dtype=np.int32)
    texts = pa.StringArray.from_buffers(len(firsts) - 1, pa.py_buffer(ends), made.buffers()[2] or pa.py_buffer(b""))
    at = np.concatenate([[0], np.cumsum(pc.utf8_length(every).to_numpy()[now], dtype=np.int64)])
    moved = np.flatnonzero((now >= len(distinct)) & (now < len(every) - 1))
    place = at[moved] - at[firsts[np.searchsorted(firsts, moved, "right") - 1]]
    changes = pa.StructArray.from_arrays([distinct.take(pa.array(codes[moved])), every.take(pa.array(now[moved])), pa.array(place.astype(np.int32))], ["original", "corrected", "position"])
    ends = np.searchsorted(moved, firsts)
    return [texts, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), changes), pa.array(np.diff(ends).astype(np.int64))]


def _rebuilt(run: pa.RecordBatch, new: dict[str, str] | Callable[[set[str]], dict[str, str]]) -> pa.RecordBatch:
    """key, corrected, changes, n_changes of key, t; new has the words that change, or finds them among all."""
    distinct, codes, firsts = _pieces(run.column("t"))
    found = distinct.to_pylist()
    new = new({w for w in found if w[0] not in _WHITE}) if callable(new) else new
    return pa.RecordBatch.from_arrays([run.column("key"), *_put_in(distinct, codes, firsts, found, new)], ["key", "corrected", "changes", "n_changes"])


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """word, count: lower-cased words of letters only, from all texts."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in text_runs(batch, "t", 16_000_000):
                distinct, codes, _ = _pieces(run.column("t"))
                on = pc.match_substring_regex(distinct, r"^\p{L}+$")
                yield pa.RecordBatch.from_arrays([distinct.filter(on), pa.array(np.bincount(codes, minlength=len(distinct))).filter(on)], ["w", "n"])

    words = df.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInArrow(counted, "w string, n long")
    return words.groupBy(F.lower("w").alias("word")).agg(F.sum("n").alias("count"))
