"""SentencePiece encoding as a max-plus scan, and decoding.

A text is segmented into vocabulary pieces of the greatest total score (a unigram
lattice); of equally good segmentations the one with the longest piece first, then second
and so on, is taken.  Scores are integers, so sums don't depend on their order.

* A place between two characters that are next to each other in no piece is a *cut*: no
  piece spans it, so the segments between cuts are solved on their own, once for all their
  occurrences in a batch, and all in step with numpy.
* A giant text (over GIANT characters) is split into chunks at any place.  The state at a
  chunk's boundary is how many characters the piece across it reaches into the next chunk.
  Each chunk gives a transfer matrix T[a, b], the best score from state a at its start to
  state b at its end; in max-plus algebra matrices combine associatively.  They are
  combined in a tree of FAN branches, level by level over all tasks; from the root back
  down, each node hands its branches the best score after each by state.  With that, each
  chunk is traced back independently, for each state it may be entered in; those maps
  compose associatively too, and a second tree gives the state of each boundary, and each
  chunk its pieces.

Model: a SentencePiece file (a parameter, read by the driver and broadcast).  A unigram
model's scores are taken as they are.  A BPE model's are ranks of merges and don't add up,
so its pieces get Zipf scores, -log(rank + 2): the vocabulary and the format (escaped
spaces, dummy prefix, byte fallback) are the model's, the segmentation is the unigram one
rather than the merge order's.  Nothing is trained.

Scale: a scan without a shuffle, but for giant texts, of which chunks are spread evenly
and at most FAN matrices of 2 KB meet in one group, whatever the length of a text.

Edge cases: a null text has null ids; an empty text has none; characters outside the
vocabulary become bytes; the model takes U+2581 for a space, so a text that holds one
comes back with a space in its place (the only case in which decoding differs); extra
columns are kept; repeated rows get equal ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relkit.llm._text import discard, gather, range_hashes, slices, stash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT = 1 << 16
CHUNK = 1 << 14
#: Branches of a node of the trees in which chunks are combined.
FAN = 16
SCALE = 10_000
#: As in SentencePiece: an unknown character costs so much more than the worst piece.
UNKNOWN_PENALTY = 10.0
_SPACE = "▁"
#: Bytes of text and rows of ids that a worker handles at once.
_BYTES, _ROWS = 1 << 20, 500
_LONG = 96  # bytes of a segment that is solved in step with others
_NEVER = -(1 << 60)
_SLOTS = 18
_BASE = 0x9E3779B97F4A7C13  # 3 mod 8: odd, hence invertible modulo 2**64
_POWERS: list[np.ndarray] = []
_MIXED = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def _wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """Pieces with integer scores, and tables to look them up by hash."""

    def __init__(self, pieces: list[tuple[str, float, int]], *, zipf: bool, dummy_prefix: bool = True):
        """pieces: (text, score, type) by id, types as in the model format: 1 normal, 2 unknown, 3 control, 4 user, 6 byte."""
        self.dummy_prefix = dummy_prefix
        usable = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind in (1, 4)]
        if zipf:
            usable = [(i, p, -float(np.log(r + 2))) for r, (i, p, _) in enumerate(sorted(usable, key=lambda x: -x[2]))]
        self.scores = {p: (round(s * SCALE), i) for i, p, s in usable}
        self.unknown_score = min((s for s, _ in self.scores.values()), default=0) - round(UNKNOWN_PENALTY * SCALE)
        self.unknown_id = next((i for i, x in enumerate(pieces) if x[2] == 2), 0)
        self.byte_ids = np.full(256, self.unknown_id, np.int32)
        self.said: list[bytes] = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(p[3:5], 16)] = i
                self.said.append(bytes([int(p[3:5], 16)]))
            else:
                self.said.append(b"" if kind in (2, 3) else p.replace(_SPACE, " ").encode())
        self.longest = max((len(p) for p in self.scores), default=1)
        raw = [(p.encode(), s, i) for p, (s, i) in self.scores.items()]
        self.longest_bytes = max((len(p) for p, _, _ in raw), default=1)
        #: adjoining bytes of different characters within a piece
        self.joined = np.zeros((256, 256), bool)
        for p in self.scores:
            for a, b in zip(p, p[1:]):
                self.joined[a.encode()[-1], b.encode()[0]] = True
        keys, at = [], []  # a table for the first piece of each slot, one for the second, ...
        flat = np.frombuffer(b"".join(p for p, _, _ in raw), np.uint8)
        ends = np.cumsum([len(p) for p, _, _ in raw])
        for x, key in enumerate(_keys(flat, ends - [len(p) for p, _, _ in raw], ends).tolist() if raw else []):
            slot, way = key >> (64 - _SLOTS), 0
            while way < len(at) and at[way][slot] >= 0:
                way += 1
            if way == len(at):
                keys.append(np.zeros(1 << _SLOTS, np.uint64))
                at.append(np.full(1 << _SLOTS, -1, np.int32))
            keys[way][slot], at[way][slot] = key, x
        self.keys, self.at = keys, at
        #: what a token adds to a text's score; of an unknown character's bytes, the first has it all
        self.worth = np.zeros(len(pieces), np.int64)
        self.worth[self.byte_ids[[b for b in range(256) if b & 0xC0 != 0x80]]] = self.unknown_score
        for p, (x, i) in self.scores.items():
            self.worth[i] = x
        self.score_of = np.array([s for _, s, _ in raw], np.int32)
        self.id_of = np.array([i for _, _, i in raw], np.int32)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        pieces, kind, dummy = [], 1, True
        for field, value in _wire(open(path, "rb").read()):
            if field == 1:
                own = dict(_wire(value))
                pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, 1)))
            elif field == 2:
                kind = dict(_wire(value)).get(3, 1)
            elif field == 3:
                own = dict(_wire(value))
                dummy = bool(own.get(3, 1))
                if own.get(2) or own.get(4, 1):
                    raise ValueError("only models that leave texts as they are (identity, no removal of white space) are read")
        return cls(pieces, zipf=kind != 1, dummy_prefix=dummy)

    def normal(self, text: str) -> str:
        return ((" " if self.dummy_prefix and text else "") + text).replace(" ", _SPACE)

    def decode(self, ids) -> str:
        out = b"".join([self.said[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if self.dummy_prefix and out.startswith(" ") else out

    # --- one text at a time, by characters: long segments and chunks -----------

    def edges(self, text: str, at: int) -> list[tuple[int, int, int]]:
        """(length, score, id) of the pieces that begin there, the longest first; id -1 for an unknown character."""
        get, out = self.scores.get, []
        for n in range(min(self.longest, len(text) - at), 0, -1):
            found = get(text[at : at + n])
            if found:
                out.append((n, *found))
        if not out or out[-1][0] > 1:
            out.append((1, self.unknown_score, -1))
        return out

    def spell(self, text: str, at: int, n: int, piece: int) -> list[int]:
        return [piece] if piece >= 0 else self.byte_ids[list(text[at : at + n].encode())].tolist()

    def best(self, text: str, core: int, after: np.ndarray) -> list[tuple[int, int]]:
        """The (length, id) to take at each of the first `core` places, if what follows place core + b is worth after[b]."""
        value = [0] * core + [int(x) for x in after[: len(text) - core + 1]]
        value += [_NEVER] * (len(text) + 1 - len(value))
        take: list[tuple[int, int]] = [(1, -1)] * core
        for p in range(core - 1, -1, -1):
            most = None
            for n, s, i in self.edges(text, p):
                if most is None or s + value[p + n] > most:
                    most, take[p] = s + value[p + n], (n, i)
            value[p] = max(most, _NEVER)
        return take

    def cuts(self, text: str) -> np.ndarray:
        """The places (from 1 on) that no piece spans."""
        data = np.frombuffer(text.encode(), np.uint8)
        lead = (data & 0xC0) != 0x80
        cut = np.flatnonzero(~self.joined[data[:-1], data[1:]] & lead[1:]) + 1
        return np.cumsum(lead)[cut] - 1

    def ends(self, text: str, core: int) -> tuple[int, int] | None:
        """The first and the last cut of a chunk, or None if some piece may span any place of it."""
        found = self.cuts(text)
        found = found[found <= core]
        return (int(found[0]), int(found[-1])) if len(found) else None

    def middle(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return encode_batch(self, np.array([0, len(data)]), data)[0]

    def transfer(self, text: str, core: int) -> np.ndarray:
        """T[a, b]: best score from place a to place core + b (max-plus; _NEVER where there is no way).

        Between two cuts there is one state, so T is the sum of the way to the first cut, of
        what lies between, and of the way from the last cut on.
        """
        ends = self.ends(text, core)
        if ends is None:
            return self._transfer(text, core)
        first, last = ends
        to = self._transfer(text[:first], first)[:, 0]
        on = self._transfer(text[last:], core - last)[0]
        out = to[:, None] + on[None, :] + int(self.worth[self.middle(text[first:last])].sum())
        out[(to < _NEVER // 2)[:, None] | (on < _NEVER // 2)[None, :]] = _NEVER
        return out

    def _transfer(self, text: str, core: int) -> np.ndarray:
        wide = self.longest
        value = np.full((core + wide, wide), _NEVER, np.int64)
        for a in range(min(wide, core + wide)):
            value[a, a] = 0
        for p in range(core):
            for n, s, _ in self.edges(text, p):
                np.maximum(value[p + n], value[p] + s, out=value[p + n])
        out = value[core : core + wide].T.copy()
        out[out < _NEVER // 2] = _NEVER
        return out

    def exit(self, text: str, core: int, after: np.ndarray) -> list[int]:
        """The state at a chunk's end for each state it is entered in."""
        ends = self.ends(text, core)
        if ends is not None:
            _, last = ends
            return [walk(self, text[last:], self.best(text[last:], core - last, after), 0)[1]] * self.longest
        take = self.best(text, core, after)
        return [walk(self, text, take, a)[1] if a < core else a - core for a in range(self.longest)]

    def trace(self, text: str, core: int, after: np.ndarray, state: int) -> list[int]:
        """The ids of a chunk that is entered in a state."""
        ends = self.ends(text, core)
        if ends is None:
            return walk(self, text, self.best(text, core, after), state)[0]
        first, last = ends
        done = np.zeros(1, np.int64)
        head = walk(self, text[:first], self.best(text[:first], first, done), state)[0]
        return head + self.middle(text[first:last]).tolist() + walk(self, text[last:], self.best(text[last:], core - last, after), 0)[0]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices; associative."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), _NEVER)


def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """Cheap 64-bit keys of byte ranges as short as a piece; the first bits are the best."""
    power, inverse = _powers(len(data) + 1)
    if total is None:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_MIXED[data] * power[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _solve(v: Vocabulary, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of adjoining segments (at most _LONG bytes each) and how many each has."""
    n = len(data)
    lead = (data & 0xC0) != 0x80
    left = (np.repeat(begin + size, size) - np.arange(n)).astype(np.int32)  # bytes up to the segment's end
    power, _ = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_MIXED[data] * power[:n], out=total[1:])
    width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
    at, length, score, ids = [], [], [], []
    alone = lead.copy()  # characters that are no piece themselves
    where = np.flatnonzero(lead)
    for k in range(1, v.longest_bytes + 1):
        where = where[left[where] >= k]
        if not len(where):
            break
        keys = _keys(data, where, where + k, total)
        slot = (keys >> np.uint64(64 - _SLOTS)).astype(np.int64)
        for way_keys, way_at in zip(v.keys, v.at):
            hit = np.flatnonzero((way_keys[slot] == keys) & (way_at[slot] >= 0))
            x = way_at[slot[hit]]
            at.append(where[hit].astype(np.int32))
            length.append(np.full(len(hit), k, np.int32))
            score.append(v.score_of[x])
            ids.append(v.id_of[x])
            single = where[hit][width[where[hit]] == k]
            alone[single] = False
    own = np.flatnonzero(alone)
    at.append(own.astype(np.int32))
    length.append(width[own].astype(np.int32))
    score.append(np.full(len(own), v.unknown_score, np.int32))
    ids.append(np.full(len(own), -1, np.int32))
    at, length, score, ids = map(np.concatenate, (at, length, score, ids))
    # from the segments' ends: all edges that begin so far from the end, by place, the longest first
    order = np.argsort((left[at].astype(np.int64) << 48) | (at.astype(np.int64) << 8) | (255 - length), kind="stable")
    at, length, score, ids = at[order], length[order], score[order], ids[order]
    bounds = np.searchsorted(left[at], np.arange(1, int(size.max(initial=0)) + 2))
    value, take = np.zeros(n + 1, np.int64), np.zeros(n, np.int32)
    ending = np.zeros(n + 1, bool)
    ending[begin + size] = True
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if a == b:
            continue
        to = at[a:b] + length[a:b]
        # a segment's end has the value 0, also where another one begins there
        worth = score[a:b] + np.where(ending[to], 0, value[to])
        head = np.flatnonzero(np.concatenate(([True], at[a + 1 : b] != at[a : b - 1])))
        most = np.maximum.reduceat(worth, head)
        group = np.cumsum(np.concatenate(([True], at[a + 1 : b] != at[a : b - 1]))) - 1
        first = np.minimum.reduceat(np.where(worth == most[group], np.arange(b - a), b), head)
        value[at[a:b][head]], take[at[a:b][head]] = most, a + first
    out = np.full(n, -1, np.int32)
    now = begin.copy()
    ends = begin + size
    while len(now):
        edge = take[now]
        known = ids[edge] >= 0
        out[now[known]] = ids[edge[known]]
        raw = gather(now[~known], length[edge[~known]])
        out[raw] = v.byte_ids[data[raw]]
        now = now + length[edge]
        going = now < ends
        now, ends = now[going], ends[going]
    token = out >= 0
    counts = np.add.reduceat(token.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    return out[token], counts


def _distinct(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of adjoining segments, and the kind of each; the bytes decide, hashes only find them."""
    _, one, same = np.unique(range_hashes(data, begin, begin + size), return_index=True, return_inverse=True)
    unlike = size != size[one[same]]
    if not unlike.any():
        # compared in parts, which bounds the arrays of places
        for lo in range(0, len(begin), 1 << 15):
            a, b = begin[lo : lo + (1 << 15)], size[lo : lo + (1 << 15)]
            differs = data[gather(begin[one[same[lo : lo + (1 << 15)]]], b)] != data[a[0] : a[0] + b.sum()]
            unlike[lo : lo + (1 << 15)] = np.logical_or.reduceat(differs, a - a[0])
    if unlike.any():
        kinds: dict[bytes, int] = {}
        same = np.array([kinds.setdefault(data[a : a + n].tobytes(), len(kinds)) for a, n in zip(begin.tolist(), size.tolist())])
        _, one = np.unique(same, return_index=True)
    return one, same


def encode_batch(v: Vocabulary, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of normal texts and how many each has."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    cut = np.zeros(len(data), bool)
    cut[1:] = ~v.joined[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin = np.flatnonzero(cut)
    size = np.diff(np.append(begin, len(data)))
    one, same = _distinct(data, begin, size)
    short = size[one] <= _LONG
    counts, starts, parts, done = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), [], 0
    own = np.flatnonzero(short)
    if len(own):
        b, s = begin[one[own]], size[one[own]]
        ids, n = _solve(v, data[gather(b, s)], np.concatenate(([0], np.cumsum(s)[:-1])), s)
        counts[own], starts[own] = n, np.cumsum(n) - n
        parts.append(ids)
        done = len(ids)
    for x in np.flatnonzero(~short).tolist():
        text = data[begin[one[x]] : begin[one[x]] + size[one[x]]].tobytes().decode()
        ids = np.array(walk(v, text, v.best(text, len(text), np.zeros(1, np.int64)), 0)[0], np.int32)
        counts[x], starts[x] = len(ids), done
        parts.append(ids)
        done += len(ids)
    flat = np.concatenate(parts)
    each = counts[same]
    text = np.searchsorted(offsets, begin, "right") - 1
    return flat[gather(starts[same], each)], np.bincount(text, each, len(offsets) - 1).astype(np.int64)


def walk(v: Vocabulary, text: str, take: list[tuple[int, int]], at: int) -> tuple[list[int], int]:
    """The ids from a place on, and how far the last piece goes beyond the core."""
    out: list[int] = []
    while at < len(take):
        n, i = take[at]
        out += v.spell(text, at, n, i)
        at += n
    return out, at - len(take)


def _encode(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = known.value
        for batch in batches:
            texts = batch.column("text")
            full = pc.replace_substring(texts.cast(pa.large_string()), " ", _SPACE)
            if v.dummy_prefix:
                lead, none = (pa.scalar(x, pa.large_string()) for x in (_SPACE, ""))
                full = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(texts), 0), none, lead), full, none)
            rest = batch.drop_columns(["text"])
            null = texts.is_null().to_numpy(zero_copy_only=False)
            for lo, hi, off, raw in slices(pa.RecordBatch.from_arrays([full], names=["text"]), "text", _BYTES):
                ids, n = encode_batch(v, off, raw)
                offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32(), mask=np.append(null[lo:hi], False))
                yield rest.slice(lo, hi - lo).append_column("ids", pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())))

    return run


def _scan(parts: DataFrame, combined, applied, start: bytes, *, backward: bool) -> DataFrame:
    """(row, chunk, at) of parts(row, chunk, part): what `start` becomes through all parts before a chunk, or after it.

    combined(x, y) joins two neighbouring parts, applied(x, at) takes a value through one.
    """

    def up(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        out, *rest = group["part"]
        for x in rest:
            out = combined(out, x)
        return pd.DataFrame({"row": group["row"].iloc[:1], "chunk": [int(group["up"].iloc[0])], "part": [out]})

    def down(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk", ascending=not backward)
        at, out = group["at"].iloc[0], []
        for x in group["part"]:
            out.append(at)
            at = applied(x, at)
        return pd.DataFrame({"row": group["row"], "chunk": group["chunk"], "at": out})

    nodes = lambda df: df.withColumn("up", F.floor(F.col("chunk") / FAN).cast("int"))
    levels = [parts]
    while levels[-1].agg(F.max("chunk")).first()[0]:
        levels.append(stash(nodes(levels[-1]).groupBy("row", "up").applyInPandas(up, "row bigint, chunk int, part binary"), "scan-up"))
    at = levels[-1].select("row", "chunk", F.lit(bytearray(start)).alias("at"))
    for level in levels[-2::-1]:
        above = at.select("row", F.col("chunk").alias("up"), "at")
        at = nodes(level).join(above, ["row", "up"]).groupBy("row", "up").applyInPandas(down, "row bigint, chunk int, at binary")
    at = stash(at, "scan")
    discard(*levels)
    return at


def _giant(rows: DataFrame, known) -> DataFrame:
    """(id, ids) of giant rows(id, text), by the chunked scan."""
    wide, chunk = known.value.longest, CHUNK

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["id"], batch["text"]):
                said = known.value.normal(text)
                for c, at in enumerate(range(0, len(said), chunk)):
                    yield pd.DataFrame({"row": [row], "chunk": [c], "core": [min(chunk, len(said) - at)], "said": [said[at : at + chunk + wide - 1]]})

    # chunks are few megabytes of much work: by number, or they would be put together by their size
    n = rows.agg(F.sum(F.ceil(F.length("text") / CHUNK))).first()[0]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 64))
    chunks = rows.mapInPandas(split, "row bigint, chunk int, core int, said string").repartition(parts, "row", "chunk")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "chunk": batch["chunk"], "part": [known.value.transfer(s, c).tobytes() for s, c in zip(batch["said"], batch["core"])]})

    def matrix(part: bytes) -> np.ndarray:
        return np.frombuffer(part, np.int64).reshape(wide, wide)

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = known.value
        for batch in batches:
            maps = [np.array(v.exit(said, core, np.frombuffer(after, np.int64)), np.int64).tobytes() for said, core, after in zip(batch["said"], batch["core"], batch["after"])]
            yield pd.DataFrame({"row": batch["row"], "chunk": batch["chunk"], "part": maps})

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = known.value
        for batch in batches:
            found = [v.trace(said, core, np.frombuffer(after, np.int64), state) for said, core, after, state in zip(batch["said"], batch["core"], batch["after"], (np.frombuffer(x, np.int64)[0] for x in batch["state"]))]
            yield pd.DataFrame({"row": batch["row"], "chunk": batch["chunk"], "ids": found})

    end = np.full(wide, _NEVER, np.int64)
    end[0] = 0  # the text ends where a piece ends
    found = stash(chunks.select("row", "chunk", "said", "core").mapInPandas(matrices, "row bigint, chunk int, part binary"), "matrices")
    after = _scan(found, lambda x, y: combine(matrix(x), matrix(y)).tobytes(), lambda x, at: combine(matrix(x), np.frombuffer(at, np.int64)[:, None])[:, 0].tobytes(), end.tobytes(), backward=True)
    ready = chunks.join(after.withColumnRenamed("at", "after"), ["row", "chunk"])
    maps = stash(ready.mapInPandas(exits, "row bigint, chunk int, part binary"), "exits")
    # a map takes the states in which a chunk is entered to those in which it is left
    follow = lambda x, at: np.frombuffer(x, np.int64)[np.frombuffer(at, np.int64)].tobytes()
    state = _scan(maps, lambda x, y: follow(y, x), follow, np.zeros(1, np.int64).tobytes(), backward=False)
    ids = ready.join(state.withColumnRenamed("at", "state"), ["row", "chunk"]).mapInPandas(trace, "row bigint, chunk int, ids array<int>")
    return ids.groupBy(F.col("row").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, *, text: str = "text", ids: str = "ids", model: str = MODEL, giant: int = GIANT) -> DataFrame:
    """docs and a column of token ids."""
    known = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(whole.alias("row"), F.col(text).alias("text"))
    plain = rows.where(F.coalesce(F.length("text") <= giant, F.lit(True)))
    out = plain.mapInArrow(_encode(known), T.StructType([T.StructField("row", docs.schema), T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    long = stash(rows.where(F.length("text") > giant).withColumn("id", F.monotonically_increasing_id()), "giants")
    if not long.isEmpty():
        found = _giant(long.select("id", "text"), known)
        out = out.union(long.join(found, "id").select("row", "ids"))
    return out.select("row.*", F.col("ids").alias(ids))


def decode(tokens: DataFrame, *, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """tokens and a column of the text that the ids stand for."""
    known = tokens.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                said = [v.decode(y.values.to_numpy(zero_copy_only=False).tolist()) if y.is_valid else None for y in part.column(ids)]
                yield part.append_column(text, pa.array(said, pa.string()))

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(text, T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = decode(encode(docs))
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
