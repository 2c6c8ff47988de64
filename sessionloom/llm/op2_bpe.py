"""Byte-level BPE: merge replay over the distinct words of each block of the corpus.

Text is cut by the tokenizer's pattern into pieces, and every piece is merged by itself, so equal pieces always get equal
ids. Each Spark task therefore collects the distinct pieces of the texts it holds and replays the merges over all of them
at once: an inverted index leads from each merge to the positions where its pair stands, merges are applied in rank order,
and applying one looks only at the two neighbours of each position and files the new pairs into the index. Texts are then
a lookup. Nothing is shuffled: a task needs no word of another task.

Defined cases: null text encodes as the empty text (no ids). Repeated rows and ties encode alike. A null ``doc_id`` is kept.
Columns other than ``doc_id`` and ``text`` are ignored. Empty tables give empty results. Texts are never cut.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import list_array, mix, table, text_blocks, word_hashes

#: Distinct words a task keeps before it starts anew; bounds its memory and changes no result.
KEPT_WORDS = 250_000
#: Bytes of text whose distinct words are replayed together.
HELD_BYTES = 4 << 20
_vocabularies: dict[str, "Vocabulary"] = {}
_tokens: dict[str, tuple[np.ndarray, np.ndarray]] = {}


class Vocabulary:
    """Ranks of a vocabulary file, and the pairs of tokens that join to a token: by their result, left and right part.

    Ranks are taken as merge order, so that merging the bytes of a token leads to that token.
    """

    def __init__(self, lines: list[bytes]):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.top = max(self.ranks.values()) + 1
        self.byte_ids = np.asarray([self.ranks[bytes([b])] for b in range(256)], np.int32)
        get, found = self.ranks.get, []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    found.append((a, b, rank))
        pairs = np.asarray(found, np.int64)
        self.by = []
        for column in (2, 0, 1):
            order = np.argsort(pairs[:, column], kind="stable")
            self.by.append((pairs[order], np.searchsorted(pairs[order, column], np.arange(self.top + 1))))
        key = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(key)
        self.pair_keys, self.pair_ranks = key[order], pairs[order, 2]
        self.look = np.full(self.top + 2, -1, np.int32)  # its last two places answer for walls and merged-away tokens

    def pairs_of(self, way: int, token: int) -> np.ndarray:
        rows, at = self.by[way]
        return rows[at[token]:at[token + 1]]

    def joined(self, way: int, token: int, others: np.ndarray) -> np.ndarray:
        """Rank of ``token`` with each of ``others`` behind (way 1) or before it (way 2), or -1."""
        rows = self.pairs_of(way, token)
        if not len(rows):
            return np.full(len(others), -1, np.int32)
        side = rows[:, 1 if way == 1 else 0]
        self.look[side] = rows[:, 2]
        out = self.look[others]
        self.look[side] = -1
        return out


def vocabulary(path: str) -> Vocabulary:
    """One copy for each Python worker; the file is part of the installed tokenizer package on every machine."""
    if path not in _vocabularies:
        with open(path, "rb") as f:
            _vocabularies[path] = Vocabulary(f.read().splitlines())
    return _vocabularies[path]


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens one behind the other, and their sizes, by id: all that decoding needs."""
    if path not in _tokens:
        with open(path, "rb") as f:
            ranks = {int(b): base64.b64decode(a) for a, b in (x.split() for x in f.read().splitlines() if x.strip())}
        tokens = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
        _tokens[path] = np.frombuffer(b"".join(tokens), np.uint8), np.fromiter(map(len, tokens), np.int64, len(tokens))
    return _tokens[path]


def replay(data: np.ndarray, starts: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces that begin at ``starts`` in ``data``, in one array, and n + 1 offsets of the pieces.

    All pieces stand side by side; merges are applied in rank order through the inverted index.
    """
    walls = np.zeros(len(data), bool)
    walls[starts] = True
    place = np.arange(len(data)) + np.cumsum(walls)  # a wall of -1 stands before each piece and at the end
    tokens = np.full(len(data) + len(starts) + 1, -1, np.int32)
    tokens[place] = v.byte_ids[data]
    # the index: for each merge, the positions of its pair in ascending order
    at = np.flatnonzero((tokens[:-1] >= 0) & (tokens[1:] >= 0))
    grid = np.full((256, 256), -1, np.int64)
    rows = v.pair_ranks
    left, right = v.pair_keys >> 32, v.pair_keys & 0xFFFFFFFF
    back = np.full(v.top, -1, np.int64)
    back[v.byte_ids] = np.arange(256)
    both = (back[left] >= 0) & (back[right] >= 0)
    grid[back[left[both]], back[right[both]]] = rows[both]
    rank = grid[back[tokens[at]], back[tokens[at + 1]]]
    at, rank = at[rank >= 0], rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    at, rank = at[order], rank[order]
    cut = np.flatnonzero(np.diff(rank, prepend=-1))
    index = {int(rank[a]): [at[a:b]] for a, b in zip(cut, [*cut[1:], len(at)])}
    heap = list(index)
    heapq.heapify(heap)
    nxt = np.arange(1, len(tokens) + 1, dtype=np.int32)
    prv = np.arange(-1, len(tokens) - 1, dtype=np.int32)
    while heap:
        r = heapq.heappop(heap)
        waiting = index.pop(r)
        where = waiting[0] if len(waiting) == 1 else np.sort(np.concatenate(waiting))
        left, right = tokens[where], tokens[nxt[where]]
        good = np.zeros(len(where), bool)
        for a, b, _ in v.pairs_of(0, r).tolist():
            good |= (left == a) & (right == b)
        i = where[good]
        if not len(i):
            continue
        j = nxt[i]
        k = nxt[j]
        before, after = v.joined(2, r, tokens[prv[i]]), v.joined(1, r, tokens[k])
        early = ((before >= 0) & (before <= r)) | ((after >= 0) & (after <= r))
        early[1:] |= i[1:] == j[:-1]
        if early.any():  # what this merge makes may come before its next use, or uses overlap: go one by one from there
            stop = max(int(np.argmax(early)), 1)
            if stop < len(i):
                index[r] = [i[stop:]]
                heapq.heappush(heap, r)
            i, j, k, before, after = i[:stop], j[:stop], k[:stop], before[:stop], after[:stop]
        tokens[i] = r
        tokens[j] = -2
        nxt[i] = k
        prv[k] = i
        h = prv[i]
        if (k[:-1] == i[1:]).any():  # merged pairs side by side are neighbours of each other now
            before, after = v.joined(2, r, tokens[h]), v.joined(1, r, tokens[k])
        rank, position = np.concatenate([before, after]), np.concatenate([h, i])
        new = rank >= 0
        rank, position = rank[new], position[new]
        if len(rank):
            order = np.argsort(rank, kind="stable")
            rank, position = rank[order], position[order]
            cut = np.flatnonzero(np.diff(rank, prepend=-1)).tolist()
            for q, a, b in zip(rank[cut].tolist(), cut, [*cut[1:], len(rank)]):
                if q in index:
                    index[q].append(position[a:b])
                else:
                    index[q] = [np.sort(position[a:b])]
                    heapq.heappush(heap, q)
    kept = tokens[tokens != -2]
    walls = np.flatnonzero(kept == -1)
    return kept[kept >= 0].astype(np.int32), walls - np.arange(len(walls))


class Words:
    """Ids of the units met so far, as one flat array; a unit's number is its place in it."""

    def __init__(self, v: Vocabulary, pattern: str):
        self.v, self.split = v, regex.compile(pattern).findall
        self.ids, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def learn(self, data: np.ndarray, off: np.ndarray, more: list[str]) -> np.ndarray:
        """Numbers of units that are not known yet: those in ``data``, then ``more``."""
        first = _breaks(data, off)
        cut = [[p.encode() for p in self.split(u)] for u in more]
        flat = [p for c in cut for p in c]
        tail = len(data) + np.cumsum([0, *map(len, flat)])[:-1]
        starts = np.concatenate([np.flatnonzero(first), tail]).astype(np.int64)
        if not len(starts):
            return np.zeros(0, np.int64)
        everything = np.concatenate([data, np.frombuffer(b"".join(flat), np.uint8)])
        ids, edges = replay(everything, starts, self.v)
        pieces = np.concatenate([[0], np.cumsum(np.concatenate([np.add.reduceat(first, off[:-1]) if len(off) > 1 else [], [*map(len, cut)]]).astype(np.int64))])
        base = len(self.lengths)
        self.ids = np.concatenate([self.ids, ids])
        self.lengths = np.concatenate([self.lengths, np.diff(edges[pieces])])
        return np.arange(base, len(self.lengths))


_classes: list[np.ndarray] = []


def _class(code: np.ndarray) -> np.ndarray:
    """1 letter, 2 number, 3 other, by code point; white space is 4."""
    if not _classes:
        every = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))
        table = np.full(0x110000, 3, np.uint8)
        for kind, name in ((1, r"\p{L}+"), (2, r"\p{N}+"), (4, r"\s+")):
            for m in regex.finditer(name, every):
                table[m.start():m.end()] = kind
        _classes.append(table)
    return _classes[0][code]


def _breaks(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pattern's pieces begin in units of a word and at most one white space before it, without apostrophes."""
    first = np.zeros(len(data), np.int64)
    if not len(data):
        return first
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = _class(code)
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    new = np.ones(len(code), bool)
    # a run of one class is a piece, with the space before it; a line end is a piece of its own
    new[1:] = (kind[1:] != kind[:-1]) & (code[:-1] != 0x20)
    first[begin] = new
    first[off[:-1]] = 1
    return first


def _ragged(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``flat[begin:begin + size]`` behind one another, and where each ends."""
    ends = np.cumsum(size)
    return flat[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


def _prefixes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The first eight bytes of each unit as a number."""
    out = np.zeros(len(off) - 1, np.uint64)
    for i in range(8):
        at = off[:-1] + i
        byte = np.where(at < off[1:], data[np.minimum(at, len(data) - 1)], 0) if len(data) else out
        out = out << np.uint64(8) | byte.astype(np.uint64)
    return out


#: White space is a space or a line end for the quick way; U+0085, U+00A0 and the like, tabs and returns are not.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x0A]] = True
_ODD = np.zeros(256, bool)
_ODD[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SAME = np.arange(256, dtype=np.uint8)
_careful = regex.compile(r"(?<=\S)(?=[ \n]\S)").split


def loose(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Documents in which white space meets white space, stands at an end, or is other than a space or line end.

    There the pattern looks further than one word and the white space before it.
    """
    space = SPACE[data]
    bad = _ODD[data]
    if len(data) > 1:
        bad[1:] |= space[1:] & space[:-1]
        lead = np.flatnonzero(_LEAD[data[:-1]])
        one, two = data[lead], data[lead + 1]
        three = data[np.minimum(lead + 2, len(data) - 1)]
        bad[lead[(one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE1) & (two == 0x9A) & (three == 0x80)
                 | (one == 0xE2) & ((two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)) | (two == 0x81) & (three == 0x9F))
                 | (one == 0xE3) & (two == 0x80) & (three == 0x80)]] = True
    full = np.flatnonzero(off[:-1] < off[1:])
    bad[off[full]] |= space[off[full]]
    bad[off[full + 1] - 1] |= space[off[full + 1] - 1]
    count = np.concatenate([[0], np.cumsum(bad)])
    return count[off[1:]] > count[off[:-1]]


class Block:
    """Units of the texts of a block: their hashes by document, and the text of each distinct one."""

    def __init__(self, batch, data: np.ndarray, off: np.ndarray):
        self.batch, self.data = batch, data
        self.hash, self.edges, s, e = word_hashes(data, off, SPACE, _SAME)
        kind = np.where(SPACE[data[s - 1]] & ~np.isin(s, off), np.where(data[s - 1] == 0x0A, 2, 1), 0) if len(s) else s
        self.hash = self.hash ^ mix(kind.astype(np.uint64) + np.uint64(1))
        self.slow = np.flatnonzero(loose(data, off))
        keep = np.ones(len(s), bool)
        quote = np.concatenate([[0], np.cumsum(data == 0x27)])
        self.slow = np.union1d(self.slow, np.flatnonzero(quote[off[1:]] > quote[off[:-1]]))  # contractions are for the pattern
        raw = data.tobytes()
        self.cut = []
        for d in self.slow.tolist():
            keep[self.edges[d]:self.edges[d + 1]] = False
            self.cut.append(_careful(raw[off[d]:off[d + 1]].decode()))
        self.distinct, first = np.unique(self.hash[keep], return_index=True)
        at = np.flatnonzero(keep)[first]
        self.span = s[at], e[at] + 1, kind[at]

    def texts(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of distinct units, each with the space or line end before it, and their sizes."""
        start, end, kind = (x[wanted] for x in self.span)
        start = start - (kind > 0)
        return _ragged(self.data, start, end - start)[0], end - start


def encode(docs: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)``: token ids of every whole text, as the vocabulary's library gives them without special tokens."""

    def run(batches):
        held: list[Block] = []
        words, known, number, odd = Words(vocabulary(vocab_path), pattern), np.zeros(0, np.uint64), np.zeros(0, np.int64), {}

        def done():
            nonlocal words, known, number, odd
            if len(words.lengths) > KEPT_WORDS:
                words, known, number, odd = Words(words.v, pattern), known[:0], number[:0], {}
            every = np.concatenate([np.zeros(0, np.uint64), *(b.distinct for b in held)])
            fresh, at = np.unique(every, return_index=True)
            if len(known):
                new = known[np.minimum(np.searchsorted(known, fresh), len(known) - 1)] != fresh
                fresh, at = fresh[new], at[new]
            order = np.argsort(at)  # as they stand in their blocks
            fresh, at = fresh[order], at[order]
            bounds = np.cumsum([0, *(len(b.distinct) for b in held)])
            got = [b.texts(at[(at >= lo) & (at < hi)] - lo) for b, lo, hi in zip(held, bounds, bounds[1:])]
            data = np.concatenate([np.zeros(0, np.uint8), *(x for x, _ in got)])
            off = np.concatenate([[0], *(n for _, n in got)]).cumsum().astype(np.int64)
            more = list({u for b in held for c in b.cut for u in c if u not in odd})
            order = np.argsort(_prefixes(data, off))  # words that begin alike stand together
            data, off = _ragged(data, off[order], np.diff(off)[order])[0], np.concatenate([[0], np.cumsum(np.diff(off)[order])])
            fresh = fresh[order]
            got = words.learn(data, off, more)
            odd |= zip(more, got[len(fresh):].tolist())
            known, number = np.concatenate([known, fresh]), np.concatenate([number, got[:len(fresh)]])
            order = np.argsort(known)
            known, number = known[order], number[order]
            begin = np.cumsum(words.lengths) - words.lengths
            for b in held:
                place = np.searchsorted(known, b.hash)
                which = number[np.minimum(place, max(len(number) - 1, 0))] if len(number) else np.zeros(len(b.hash), np.int64)
                if len(b.slow):
                    rows = np.split(which, b.edges[1:-1])
                    for d, c in zip(b.slow.tolist(), b.cut):
                        rows[d] = np.fromiter(map(odd.__getitem__, c), np.int64, len(c))
                    which, b.edges = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
                flat, ends = _ragged(words.ids, begin[which], words.lengths[which])
                yield pa.RecordBatch.from_arrays(
                    [b.batch.column("doc_id"), list_array(flat, np.concatenate([[0], ends])[b.edges], pa.int32())], ["doc_id", "ids"])
            held.clear()

        size = 0
        for part in text_blocks(batches):
            held.append(Block(*part))
            size += len(part[1])
            if size > HELD_BYTES:
                yield from done()
                size = 0
        yield from done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes that the ids stand for. Other columns stay; null ids decode to no bytes."""
    kept = [c for c in encoded.columns if c != "decoded"]
    encoded = encoded.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches):
        flat, size = token_bytes(vocab_path)
        begin = np.cumsum(size) - size
        for big in batches:
            col = big.column("ids")
            edges = np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths().fill_null(0)))])
            lo = 0
            while lo < big.num_rows:  # about a million ids at a time
                hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + 1_000_000, "right")) - 1)
                ids = col.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                n = size[ids]
                ends = np.cumsum(n)
                out = flat[np.repeat(begin[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
                at = np.concatenate([[0], ends])[edges[lo:hi + 1] - edges[lo]]
                decoded = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([*big.slice(lo, hi - lo).columns, decoded], [*big.schema.names, "decoded"])
                lo = hi

    fields = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes for every document."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    done = decode(encode(table(spark, sf_dir, "documents"), path, P.PATTERN), path)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
SQL: dict[str, str] = {}
