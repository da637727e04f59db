"""SentencePiece encoding, decoding, and distinct sampled segmentations by Gumbel top-k over the lattice."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, repeat
from math import exp, expm1, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.store import tune
from docengine.llm.words import batches, mix

SPACE = "▁"
#: Log-probability of a piece is -ZIPF * log(rank + 2); a BPE model's scores are ranks.
ZIPF = 1.0
#: States of units that a worker keeps, at about 100 bytes each.
_KNOWN = 3_000_000
_ROUND, _PLACE, _STEP, _HEAD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, ends left out, that follow from 64-bit keys."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value, shift, at = value | (data[at] & 127) << shift, shift + 7, at + 1
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def is_unigram(model) -> bool:
    """Whether scores are log-probabilities: field 3 (1: unigram, also if absent) of the trainer's settings, field 2 of a model."""
    for number, value in _fields(model.serialized_model_proto()):
        if number == 2:
            return dict(_fields(value)).get(3, 1) == 1
    return True


class Lattice:
    """The lattice of a text is the chain of its units' lattices: no piece goes past a run of spaces and what follows it.

    States are places in units. Each has its pieces' conditional probabilities given that the unit ends,
    found once by a backward sum over the lattice, for many units at a time. Drawing a piece in each state is a walk down the tree of
    segmentations.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        unigram = is_unigram(self.model)
        self.byte = {}
        edge: dict[tuple[int, int], int] = {}
        piece, score = [-1], [0.0]
        for i in range(n):
            text = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.byte[int(text[1:-1], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i)):
                if SPACE in text.lstrip(SPACE):
                    raise ValueError("a piece has a space inside")
                node = 0
                for c in text:
                    node = edge.setdefault((node, ord(c)), len(piece))
                    if node == len(piece):
                        piece.append(-1)
                        score.append(0.0)
                # a BPE model has ranks
                s = self.model.get_score(i)
                piece[node], score[node] = i, s if unigram else -ZIPF * log(2 - s)
        # the tree of pieces: children by node and character
        self.keys, self.child = (np.array(x, dtype=np.int64) for x in zip(*sorted((a << 21 | c, b) for (a, c), b in edge.items())))
        self.node_piece, self.node_score = np.array(piece, dtype=np.int32), np.array(score)
        self.rare = -ZIPF * log(2 + n)
        self._forget()

    def _forget(self) -> None:
        self.units: dict[str, int] = {}
        self.edges, self.states = 0, 1  # state 0 is the end
        # edges of state s are first[s]:first[s + 1], likeliest first; piece is an id, or -1 - c for a character c without one
        self.first = np.zeros(1 << 16, dtype=np.int32)
        self.cum, self.logp = np.zeros(1 << 16), np.zeros(1 << 16)
        self.next, self.piece, self.degree = (np.zeros(1 << 16, dtype=np.int32) for _ in range(3))

    def _spelling(self, c: int) -> list[int]:
        return [self.byte[b] for b in chr(c).encode("utf-8", "surrogatepass")] if self.byte else [self.model.unk_id()]

    def _pieces_in(self, chars: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, width, score, piece) of all pieces that begin at a place and end at most `rest` characters on."""
        at, node, width = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64), 0
        found: list[tuple] = []
        alone = np.ones(len(chars), dtype=bool)
        while len(at):
            key = node << 21 | chars[at + width]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[i] == key
            at, node = at[ok], self.child[i[ok]]
            width += 1
            is_piece = self.node_piece[node] >= 0
            hit, which = at[is_piece], node[is_piece]
            found.append((hit, np.full(len(hit), width), self.node_score[which], self.node_piece[which]))
            if width == 1:
                alone[hit] = False
            more = rest[at] > width
            at, node = at[more], node[more]
        bare = np.flatnonzero(alone)
        c = chars[bare]
        size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000) if self.byte else np.ones(len(c))
        found.append((bare, np.ones(len(bare), dtype=np.int64), self.rare * size, (-1 - c).astype(np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _add(self, new: list[str]) -> None:
        """States of units not met before, all of one distance to their unit's end at a time."""
        size = np.array([len(u) for u in new])
        chars = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        n = len(chars)
        rest = np.repeat(np.cumsum(size), size) - np.arange(n)
        src, width, score, piece = self._pieces_in(chars, rest)
        # keys without ties, so that a unit's edges do not depend on what is found with it
        order = np.argsort((rest[src] * n + src) << 7 | np.minimum(width, 127))
        src, width, score, piece = src[order], width[order], score[order], piece[order]
        ends = rest[src] == width
        dst = np.where(ends, n, src + width)
        z = np.zeros(n + 1)
        head = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
        count = np.diff(np.r_[head, len(src)])
        steps = np.searchsorted(rest[src[head]], np.arange(1, int(size.max()) + 2))
        for g0, g1 in zip(steps[:-1].tolist(), steps[1:].tolist()):
            lo, hi = int(head[g0]), int(head[g1]) if g1 < len(head) else len(src)
            v, starts = score[lo:hi] + z[dst[lo:hi]], head[g0:g1] - lo
            top = np.maximum.reduceat(v, starts)
            total = np.add.reduceat(np.exp(v - np.repeat(top, count[g0:g1])), starts)
            z[src[head[g0:g1]]] = top + np.log(total)
        logp = score + z[dst] - z[src]
        # likeliest first, to a part in 65536
        rank = np.clip(logp * -65536.0, 0, 2.0**25 - 1).astype(np.int64)
        order = np.argsort(src << 32 | rank << 7 | np.minimum(width, 127))
        src, dst, logp, piece = src[order], dst[order], logp[order], piece[order]
        degree = np.bincount(src, minlength=n)
        begin = np.concatenate([[0], np.cumsum(degree)])
        cum = np.exp(logp)
        place, left = begin[:-1], degree
        while len(place):
            more = left > 1
            place, left = place[more] + 1, left[more] - 1
            cum[place] += cum[place - 1]
        cum[begin[1:] - 1] = 2.0
        at, end = self.edges, self.edges + len(src)
        for name in ("cum", "logp", "next", "piece", "degree"):
            self._room(name, end)
        self._room("first", self.states + n + 1)
        self.cum[at:end], self.logp[at:end], self.piece[at:end], self.degree[at:end] = cum, logp, piece, degree[src]
        self.next[at:end] = np.where(dst == n, 0, self.states + dst)
        self.first[self.states : self.states + n + 1] = at + begin
        self.units.update(zip(new, (self.states + np.cumsum(size) - size).tolist()))
        self.edges, self.states = end, self.states + n

    def _room(self, name: str, need: int) -> None:
        have = getattr(self, name)
        if need > len(have):
            setattr(self, name, np.concatenate([have, np.zeros(max(need - len(have), len(have) // 2), dtype=have.dtype)]))

    def starts(self, parts: list[str]) -> np.ndarray:
        """The states at which units begin; those not met before are found together."""
        if self.states > _KNOWN:
            self._forget()
        out = np.fromiter(map(self.units.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))
        new = np.flatnonzero(out < 0).tolist()
        if new:
            self._add(list(dict.fromkeys(parts[i] for i in new)))
            out[new] = [self.units[parts[i]] for i in new]
        return out

    def draw(self, state: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges, unit of each) of a segmentation drawn from the given states on, in order; `key` gives each unit's numbers."""
        size, unit = np.zeros(len(state), dtype=np.int64), np.arange(len(state))
        steps = []
        while len(state):
            # edges fall by probability, so that few draws go past the first; the last one's bound is out of reach
            u, e = _uniform(key), self.first[state]
            past = np.flatnonzero(u >= self.cum[e])
            while len(past):
                e[past] += 1
                past = past[u[past] >= self.cum[e[past]]]
            size[unit] += 1
            steps.append((unit, e))
            state = self.next[e]
            go = np.flatnonzero(state)
            state, unit, key = state[go], unit[go], key[go] + _STEP
        at = np.cumsum(size) - size
        edges = np.empty(int(size.sum()), dtype=np.int32)
        for i, (unit, e) in enumerate(steps):
            edges[at[unit] + i] = e
        return edges, np.repeat(np.arange(len(size), dtype=np.int32), size)

    def sample_all(self, texts: list[list[str]], k: int, seeds: np.ndarray) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
        """For each text, in units: up to k distinct segmentations (edges, log-probability, perturbed log-probability), best first,
        and the next one's bound. A text's draws follow from its seed alone.

        Top-down sampling: a queue holds sets of segmentations by the maximum of their perturbed log-probabilities. A
        set is a prefix of pieces and the pieces not to follow it. Taking one draws its best member, and what is left
        falls into one set for each place where another member parts from it; their maxima are Gumbels of
        their mass, cut off at the best. Only as many are kept as can still be taken, and one more for the bound. All
        texts take their n-th set together.
        """
        begin = self.starts(list(chain.from_iterable(texts)))
        units_ = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        seeds = mix(np.asarray(seeds, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        none = np.zeros(0, dtype=np.int32)
        roots = -np.log(-np.log(_uniform(seeds)))
        # (minus maximum, number, path, unit of each piece, length of the prefix, its log-probability, pieces not to follow)
        queues: list[list] = [[(-float(g), 0, none, none, 0, 0.0, ())] for g in roots]
        found: list[list] = [[] for _ in texts]
        live, turn, count = list(range(len(texts))), 0, 0
        while live and turn < k:
            taken = [heappop(queues[d]) for d in live]
            base = mix(seeds[live] + _ROUND * np.array([2 * turn + 1], dtype=np.uint64))
            state, key, unit, heads = [], [], [], np.full(len(live), -1, dtype=np.int64)
            first_number = _uniform(base ^ _HEAD)
            for j, (d, (_, _, path, owner, i, _, banned)) in enumerate(zip(live, taken)):
                lo, hi = int(units_[d]), int(units_[d + 1])
                at = 0
                if banned:
                    at = int(owner[i])
                    here = int(self.next[path[i - 1]]) if i and owner[i - 1] == at else int(begin[lo + at])
                    a, b = int(self.first[here]), int(self.first[here + 1])
                    p = np.exp(self.logp[a:b])
                    p[[x - a for x in banned]] = 0
                    total = np.cumsum(p)
                    e = min(a + int(np.searchsorted(total, first_number[j] * total[-1], side="right")), a + int(np.flatnonzero(p)[-1]))
                    heads[j] = e
                    if self.next[e]:
                        state.append(self.next[e : e + 1])
                        unit.append(np.array([at]))
                    at += 1
                state.append(begin[lo + at : hi])
                unit.append(np.arange(at, hi - lo))
                key.append(len(state))
            sizes = np.array([len(x) for x in state], dtype=np.int64)
            unit_of = np.concatenate(unit)
            cuts = np.concatenate([[0], np.cumsum(sizes)])[np.array(key)]  # where each text's states end
            edges, owner = self.draw(np.concatenate(state), np.repeat(base, np.diff(cuts, prepend=0)) + unit_of.astype(np.uint64) * _PLACE)
            ends = np.searchsorted(owner, cuts)
            owner = unit_of[owner].astype(np.int32)
            if turn:  # the pieces that part from a set's banned ones come first
                more = np.flatnonzero(heads >= 0)
                at = np.concatenate([[0], ends[:-1]])[more]
                edges = np.insert(edges, at, heads[more])
                owner = np.insert(owner, at, [taken[j][3][taken[j][4]] for j in more.tolist()])
                ends = ends + np.cumsum(heads >= 0)
            starts = np.concatenate([[0], ends[:-1]])
            lp, many = self.logp[edges], np.diff(ends, prepend=0)
            before, gone = np.empty(len(edges)), np.exp(lp)
            allowed = self.degree[edges].copy()
            paths = []
            for j, (d, (top, _, path, own, i, mass, banned), a, b) in enumerate(zip(live, taken, starts.tolist(), ends.tolist())):
                run = np.cumsum(lp[a:b])
                if a < b:
                    before[a], before[a + 1 : b] = mass, mass + run[:-1]
                if banned:
                    gone[a] += np.exp(self.logp[list(banned)]).sum()
                    allowed[a] -= len(banned)
                paths.append((np.concatenate([path[:i], edges[a:b]]) if i else edges[a:b], np.concatenate([own[:i], owner[a:b]]) if i else owner[a:b]))
                found[d].append((paths[-1][0], mass + float(run[-1]) if a < b else mass, -top))
            with np.errstate(divide="ignore", invalid="ignore"):
                left = np.where(allowed > 1, before + np.log1p(-np.minimum(gone, 1.0)), -np.inf)
            place = np.arange(len(edges)) - np.repeat(starts, many)
            numbers = _uniform(np.repeat(mix(seeds[live] + _ROUND * np.array([2 * turn + 2], dtype=np.uint64)), many) + place.astype(np.uint64) * _PLACE)
            cut = _truncate(left, np.repeat([-t[0] for t in taken], many), numbers)
            need = k - turn
            for (d, (_, _, _, _, i, _, banned)), (path, own), a, b in zip(zip(live, taken), paths, starts.tolist(), ends.tolist()):
                part = cut[a:b]
                best = [int(part.argmax())] if need == 1 and b > a else np.argpartition(-part, need)[:need].tolist() if b - a > need else range(b - a)
                for x in best:
                    if part[x] > -np.inf:
                        count += 1
                        stop = (*(banned if x == 0 else ()), int(edges[a + x]))
                        heappush(queues[d], (-float(part[x]), count, path, own, i + x, float(before[a + x]), stop))
            turn += 1
            live = [d for d in live if queues[d]]
        return [(f, -q[0][0] if q else -np.inf) for f, q in zip(found, queues)]

    def sample(self, text: str, k: int, seed: int) -> tuple[list[tuple[np.ndarray, float, float]], float]:
        """`sample_all` of one normalised text."""
        return self.sample_all([units(text)], k, np.array([seed]))[0]

    def ids(self, path: np.ndarray) -> np.ndarray:
        """Ids along a path; characters without a piece as their bytes."""
        return self.all_ids([path])[0]

    def all_ids(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """Ids along each path."""
        out = self.piece[np.concatenate([np.zeros(0, dtype=np.int32), *paths])]
        ends = np.cumsum([len(p) for p in paths])
        odd = np.flatnonzero(out < 0)
        if len(odd):
            spelled = [self._spelling(-1 - c) for c in out[odd].tolist()]
            many = np.ones(len(out), dtype=np.int64)
            many[odd] = [len(x) for x in spelled]
            odd_after = np.repeat(out < 0, many)
            ends = np.concatenate([[0], np.cumsum(many)])[ends]
            out = np.repeat(out, many)
            out[odd_after] = np.concatenate(spelled)
        return np.split(out, ends[:-1]) if paths else []

    def pieces(self, path: np.ndarray) -> list[int]:
        return self.ids(path).tolist()


def _truncate(mass: np.ndarray, most: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Gumbels of location `mass` cut off at `most`: -log(exp(-most) + exp(-mass) * Exp(1)) in stable form."""
    return -np.logaddexp(-most, -mass + np.log(-np.log(numbers)))


_UNIT = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def units(text: str) -> list[str]:
    """Line feeds, and runs of spaces with what follows them: no piece has a line feed or goes past a space that follows something else."""
    return _UNIT.findall(text)


_loaded: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _loaded:
        _loaded[path] = Lattice(path)
    return _loaded[path]


def _sample(path: str, k: int, seed: int, with_ids: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lat = lattice(path)
        for frame in frames:
            rows = []
            names, texts = [None if pd.isna(d) else int(d) for d in frame["doc_id"]], [t or "" for t in frame["text"]]
            for lo, hi in batches(texts):
                seeds = np.array([zlib.crc32(f"{seed}\x1f{d}".encode()) for d in names[lo:hi]], dtype=np.uint64)
                drawn = lat.sample_all([units(t) for t in lat.model.normalize(texts[lo:hi])], k, seeds)
                all_ids = iter(lat.all_ids([path for found, _ in drawn for path, _, _ in found]))
                for name, plain, (found, bound) in zip(names[lo:hi], texts[lo:hi], drawn):
                    same = False
                    for n, (_, logp, value) in enumerate(found):
                        ids = next(all_ids)
                        # every path spells the characters of the same units, so that decoding one tells for all
                        same = lat.model.decode(ids.tolist()) == plain if n == 0 else same
                        # a member is in the sample if its perturbed value is over the first one left out
                        over = min(logp - bound, 700.0)
                        inclusion = -expm1(-exp(over))
                        # far below zero both are the same, and the first one's exponential may be zero
                        log_inclusion = log(inclusion) if over > -30 else over
                        row = (name, n, len(ids), logp, value, inclusion, log_inclusion, zlib.crc32(ids.astype("<u4", copy=False)), same)
                        rows.append((*row, ids.tolist()) if with_ids else row)
            cols = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "log_inclusion", "ids_crc32", "restored"] + ["ids"] * with_ids
            yield pd.DataFrame(rows, columns=cols).astype({"doc_id": "Int64"})

    return run


def sample(docs: DataFrame, model: str, k: int = 3, seed: int = 0, ids: bool = False) -> DataFrame:
    """Up to k rows per document, distinct segmentations of its whole text drawn without replacement: doc_id, sample (from 0, by
    falling perturbed log-probability), n_pieces, log_prob, perturbed, inclusion, log_inclusion, ids_crc32, restored (whether decoding gives the text back), and ids if asked for.

    Exact Gumbel top-k over all segmentations of the lattice; the draw follows from `seed` and doc_id alone, so a
    lost task repeats it, and rows that repeat a doc_id with one text get the same. inclusion is the probability that a
    segmentation's perturbed value is over the best one left out; log_prob less log_inclusion weighs estimates; inclusion itself is 0 where a double cannot hold it. A text with fewer than k segmentations gives
    all of them, with inclusion 1; null and empty texts give the empty one. Null doc_ids share a seed. Other columns are ignored.
    """
    tune(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, log_inclusion double, ids_crc32 long, restored boolean"
    return source.mapInPandas(_sample(model, k, seed, ids), schema + ", ids array<int>" * ids)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids of the model's own segmentation of each whole text; null counts as empty."""
    tune(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        return pd.Series(lattice(model).model.encode([t or "" for t in text], num_threads=1))

    return docs.select("doc_id", ids(F.col("text").cast("string")).alias("ids"))


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of each row's ids; null ids give an empty text."""
    tune(rows.sparkSession)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series([lattice(model).model.decode([int(i) for i in x]) if x is not None else "" for x in ids])

    return rows.select("doc_id", text("ids").alias("text"))
