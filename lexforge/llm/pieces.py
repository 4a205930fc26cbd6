"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct runs (white space before a word, and the word) are concatenated and indexed by a
suffix array; every piece of the vocabulary is searched in it, all pieces at once; the occurrence
ranges become edges (start, end, piece), sorted by position. Relaxation then picks the path: for a
BPE model the pair whose edge ranks best is merged until no pair has an edge; for a unigram model
the best-scoring path is relaxed from left to right. Characters without a piece become byte pieces.

Null and empty texts have no ids. A text of any length is one sequence. Decoding gives the text
back, but for U+2581, the vocabulary's own space mark, which comes back as a space; lone surrogates
are replaced. Repeated rows repeat their ids; other columns are not read, and ids of any type, null
included, come back as they were. Equal ranks cannot meet but in one piece, which the leftmost takes.

A run is first cut where no piece reaches across, which no merge can undo. A pass merges every place
of a run's best rank at once, so a run of megabytes takes as many passes as it uses pieces, not as
many as it has symbols; where a merge would open a better rank, the pass takes one place only.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from lexforge.llm.common import map_tasks, text_of

SPACE = "▁"
_RUN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Start positions sorted by their first depth bytes at least, by prefix doubling."""
    n = len(data)
    rank = data.astype(np.int64) + 1
    span = 1
    while True:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(n - span, 0)] = rank[span:]
        key = rank * (n + 257) + ahead
        order = np.argsort(key, kind="stable")
        step = np.ones(n, dtype=np.int64)
        step[1:] = key[order][1:] != key[order][:-1]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.cumsum(step)
        rank, span = fresh, span * 2
        if span >= depth or (n and rank.max() == n):
            return order


def occurrence_ranges(data: np.ndarray, order: np.ndarray, table: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[lo, hi) of every piece in the suffix array; the ranges narrow by one byte per step."""
    n = len(order)
    padded = np.concatenate([data.astype(np.int16), np.full(table.shape[1] + 1, -1, dtype=np.int16)])
    lo, hi = np.zeros(len(table), dtype=np.int64), np.full(len(table), n, dtype=np.int64)
    for d in range(table.shape[1]):
        live = np.flatnonzero((size > d) & (lo < hi))
        if not len(live):
            break
        want = table[live, d].astype(np.int16)
        for side in (0, 1):
            a, b = lo[live], hi[live]
            while True:
                open_ = a < b
                if not open_.any():
                    break
                mid = (a + b) >> 1
                c = padded[order[np.minimum(mid, n - 1)] + d]
                right = (c < want) if side == 0 else (c <= want)
                a = np.where(open_ & right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            if side == 0:
                low = a
            else:
                lo[live], hi[live] = low, a
    return lo, hi


class PieceCodec:
    """encode(texts) -> arrays of ids; decode(ids) -> text."""

    def __init__(self, path: str | None = None, kind: str = "bpe", batch_bytes: int = 400_000, remember: int = 700_000) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.kind, self.batch_bytes, self.remember = kind, batch_bytes, remember
        self.bytes_of = [p.encode() for p in pieces]
        self.byte_id = np.zeros(256, dtype=np.int64)
        normal = []
        for i, p in enumerate(pieces):
            if model.is_byte(i):
                value = int(_BYTE.match(p)[1], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of[i] = b""
            elif p and not model.is_unused(i):
                normal.append(i)
        self.ids = np.array(normal, dtype=np.int64)
        self.score = np.array([model.get_score(i) for i in normal])
        rank = np.empty(len(normal), dtype=np.int64)
        rank[np.argsort(-self.score, kind="stable")] = np.arange(len(normal))
        self.rank = rank
        self.size = np.array([len(self.bytes_of[i]) for i in normal], dtype=np.int64)
        self.table = np.zeros((len(normal), int(self.size.max())), dtype=np.uint8)
        for row, i in enumerate(normal):
            self.table[row, : self.size[row]] = np.frombuffer(self.bytes_of[i], np.uint8)
        self.cut = not any(re.search(f"[^{SPACE}]{SPACE}", pieces[i]) for i in normal)
        self.known: dict[str, np.ndarray] = {}

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece row) of every occurrence, sorted by start and end."""
        order = suffix_array(data, self.table.shape[1])
        lo, hi = occurrence_ranges(data, order, self.table, self.size)
        count = hi - lo
        row = np.repeat(np.arange(len(count)), count)
        start = order[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))]
        end = start + self.size[row]
        o = np.argsort(start * (self.table.shape[1] + 1) + (end - start), kind="stable")
        return start[o], end[o], row[o]

    def _merge(self, data: np.ndarray, owner: np.ndarray, edges) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the symbols after all merges, by position; owner names the run of a byte."""
        wide = self.table.shape[1] + 1
        keys, ranks = edges[0] * wide + (edges[1] - edges[0]), self.rank[edges[2]]
        none = np.iinfo(np.int64).max

        def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            want = a * wide + (b - a)
            at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            return np.where((b - a < wide) & (keys[at] == want), ranks[at], none) if len(keys) else np.full(len(a), none)

        heads = np.flatnonzero((data & 0xC0) != 0x80)  # characters
        heads = heads[owner[heads] >= 0]
        over = np.zeros(len(data) + 1, dtype=np.int64)  # how many pieces reach across the place before a byte
        np.add.at(over, edges[0] + 1, 1)
        np.add.at(over, edges[1], -1)
        new = np.concatenate([[True], owner[heads][1:] != owner[heads][:-1]]) | (np.cumsum(over)[heads] == 0)
        start, word = heads, np.cumsum(new)
        length = np.where(data[heads] < 0x80, 1, np.where(data[heads] < 0xE0, 2, np.where(data[heads] < 0xF0, 3, 4)))
        end = heads + length
        out_s, out_e = [], []
        pair = np.full(len(start), none)
        same = np.flatnonzero(word[1:] == word[:-1])
        pair[same] = look(start[same], end[same + 1])
        while len(start):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(pair, first)
            size = np.diff(np.concatenate([first, [len(start)]]))
            done = np.repeat(best == none, size)
            if done.any():
                out_s.append(start[done])
                out_e.append(end[done])
                start, end, word, pair = start[~done], end[~done], word[~done], pair[~done]
                if not len(start):
                    break
                size, best = size[best != none], best[best != none]
            hits = np.flatnonzero(pair == np.repeat(best, size))
            left = self._apart(hits, start, end, word, pair, look)
            end[left] = end[left + 1]
            keep = np.ones(len(start), dtype=bool)
            keep[left + 1] = False
            moved = np.cumsum(keep) - 1
            start, end, word, pair = start[keep], end[keep], word[keep], pair[keep]
            near = np.zeros(len(start), dtype=bool)
            near[moved[left]] = near[np.maximum(moved[left] - 1, 0)] = True
            touched = np.flatnonzero(near)
            pair[touched] = none
            ok = touched[(touched + 1 < len(start))]
            ok = ok[word[ok] == word[ok + 1]]
            pair[ok] = look(start[ok], end[ok + 1])
        s, e = np.concatenate(out_s or [heads]), np.concatenate(out_e or [heads])
        o = np.argsort(s, kind="stable")
        return s[o], e[o]

    @staticmethod
    def _apart(hits: np.ndarray, start, end, word, pair, look) -> np.ndarray:
        """Of each run's places of its best rank those that one pass may merge, leftmost first.

        Places that share a symbol: every second one. All places of a run only if no symbol made by
        them has a better pair with a neighbour, made or not; else the leftmost alone.
        """
        chain = np.cumsum(np.concatenate([[True], (np.diff(hits) > 1) | (word[hits][1:] != word[hits][:-1])])) - 1
        begin = hits[np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))]
        left = hits[(hits - begin[chain]) % 2 == 0]
        own = word[left]  # in order
        new = np.concatenate([[True], own[1:] != own[:-1]])
        if new.all():
            return left
        worse = np.zeros(len(left), dtype=bool)
        n, made = len(start), np.zeros(len(start) + 1, dtype=bool)
        made[left] = True
        made_end = np.where(made[:n], end[np.minimum(np.arange(n) + 1, n - 1)], end)
        for stop in (end, made_end):  # the symbol to the right as it is, and as this pass makes it
            at = np.minimum(left + 2, n - 1)
            on = (left + 2 < n) & (word[at] == word[left])
            worse[on] |= look(start[left[on]], stop[at[on]]) < pair[left[on]]
        for back, need in ((1, None), (2, made)):  # the symbol to the left, or the one made of two
            at = np.maximum(left - back, 0)
            on = (left - back >= 0) & (word[at] == word[left])
            if need is not None:
                on &= need[at]
            worse[on] |= look(start[at[on]], end[left[on] + 1]) < pair[left[on]]
        run = np.cumsum(new) - 1
        bad = np.bincount(run, worse, run[-1] + 1)[run] > 0
        return left[~bad | new]

    def _best_path(self, data: np.ndarray, owner: np.ndarray, edges) -> tuple[np.ndarray, np.ndarray]:
        """Unigram relaxation: the best-scoring cover of every run, single characters as a last resort."""
        n = len(data)
        best, back = np.full(n + 1, -np.inf), np.full(n + 1, -1, dtype=np.int64)
        heads = np.flatnonzero(((data & 0xC0) != 0x80) & (owner >= 0))
        new_run = np.zeros(n + 1, dtype=bool)
        new_run[heads[np.concatenate([[True], owner[heads][1:] != owner[heads][:-1]])]] = True
        begin = np.searchsorted(edges[0], np.arange(n + 1))
        floor = float(self.score.min()) - 10
        for at in heads.tolist():
            if new_run[at]:
                best[at] = 0.0
            width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            if best[at] + floor > best[at + width]:
                best[at + width], back[at + width] = best[at] + floor, at
            for k in range(begin[at], begin[at + 1]):
                to, gain = edges[1][k], best[at] + self.score[edges[2][k]]
                if gain > best[to]:
                    best[to], back[to] = gain, at
        starts, ends = [], []
        for stop in np.flatnonzero((owner >= 0) & (np.concatenate([owner[1:], [-1]]) < 0)) + 1:
            at = stop
            while back[at] >= 0 and not (at != stop and new_run[at]):
                starts.append(back[at])
                ends.append(at)
                at = back[at]
        s, e = np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)
        o = np.argsort(s)
        return s[o], e[o]

    def _segment(self, runs: list[str]) -> None:
        """Ids of new runs, remembered. Runs are parted by a zero byte that no piece holds."""
        body = [r.encode("utf-8", "replace") for r in runs]
        sizes = np.array([len(b) + 1 for b in body], dtype=np.int64)
        data = np.frombuffer(b"\0".join(body) + b"\0", dtype=np.uint8)
        owner = np.repeat(np.arange(len(runs)), sizes)
        last = np.cumsum(sizes) - 1
        owner[last] = -1
        start, end, row = edges = self.edges(data)
        s, e = (self._merge if self.kind == "bpe" else self._best_path)(data, owner, edges)
        wide = self.table.shape[1] + 1
        keys, want = start * wide + (end - start), s * wide + (e - s)
        at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
        has = (keys[at] == want) & (e - s < wide) if len(keys) else np.zeros(len(s), dtype=bool)
        count = np.where(has, 1, e - s)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        flat = np.zeros(int(count.sum()), dtype=np.int64)
        if len(keys):
            flat[first[has]] = self.ids[row[at[has]]]
        for k in np.flatnonzero(~has):
            flat[first[k] : first[k] + count[k]] = self.byte_id[data[s[k] : e[k]]]
        per_run = np.bincount(owner[s], count, len(runs)).astype(np.int64)
        flat = flat.astype("<u4")
        stop = 0
        for run, z in zip(runs, per_run.tolist(), strict=True):
            self.known[run] = flat[stop : stop + z].tobytes()
            stop += z

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit bytes."""
        if len(self.known) > self.remember:
            self.known.clear()
        cut = [_RUN.findall(SPACE + t.replace(" ", SPACE)) if self.cut else [SPACE + t.replace(" ", SPACE)] if t else [] for t in texts]
        cut = [c if t else [] for c, t in zip(cut, texts, strict=True)]
        fresh = list(set().union(*cut).difference(self.known)) if cut else []
        held, size = [], 0
        for run in fresh:
            if size > self.batch_bytes:
                self._segment(held)
                held, size = [], 0
            held.append(run)
            size += len(run) + 1
        if held:
            self._segment(held)
        out = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        for run in fresh:
            if len(run) > 256:  # long runs hardly repeat and would fill the memory
                del self.known[run]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: bytes joined, space marks turned, the mark put in front taken off."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, kind: str = "bpe") -> DataFrame:
    """id, ids array<long> of every row's whole text."""

    def start():
        codec = PieceCodec(path, kind)
        return lambda frame: pd.DataFrame({"ids": [np.frombuffer(b, "<u4").astype(np.int64) for b in codec.encode([text_of(t) for t in frame["t"]])]})

    return map_tasks(df.select(df[id_col].alias("id"), df[text_col].alias("t")), start, "ids array<long>", carry=["id"]).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id, text of every row's ids; null ids decode to null."""

    def start():
        codec = PieceCodec(path)
        return lambda frame: pd.DataFrame({"text": [None if x is None else codec.decode(np.asarray(x, dtype="<u4").tobytes()) for x in frame["x"]]}, dtype=object)

    return map_tasks(df.select(df[id_col].alias("id"), df[ids_col].alias("x")), start, "text string", carry=["id"]).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: ids of every whole text of documents, digested, and whether they decode to the text.

    doc_id, n_tokens, ids_crc32 (unsigned, of little-endian unsigned 32-bit ids), n_chars (decoded
    code points), round_trip.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def start():
        codec = PieceCodec()

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            rows = []
            texts = [text_of(t) for t in frame["t"]]
            for text, ids in zip(texts, codec.encode(texts), strict=True):
                back = codec.decode(ids)
                rows.append((len(ids) // 4, zlib.crc32(ids), len(back), back == text.replace(SPACE, " ")))
            return pd.DataFrame(rows, columns=["n_tokens", "ids_crc32", "n_chars", "round_trip"])

        return run

    return map_tasks(docs.select("doc_id", docs["text"].alias("t")), start, "n_tokens long, ids_crc32 long, n_chars long, round_trip boolean", carry=["doc_id"])
