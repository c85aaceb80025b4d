"""Byte-level BPE by segment trees (operator 8).

Every pre-token keeps a segment tree over its byte positions. A leaf holds the
rank of the pair that starts at its position (or NONE), an inner node the
minimum of its children, so the root is the next merge and the descent that
prefers the left child finds its leftmost place. A merge changes three leaves:
the merged position, the position that died and the live neighbour on the left.
Each is a point update of logarithmic cost. Short pre-tokens are worked off
many at a time, one tree a row of a numpy array; long ones by a scalar tree.

Defined results: a null text counts as empty, an empty text gives no ids and
decodes to no bytes, repeated rows are encoded one by one, other columns pass
through (a column named like an output is replaced), an empty table gives an
empty table.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

NONE = np.int32(2**31 - 1)
#: Pre-tokens up to so many bytes are merged in numpy rows.
WIDEST = 64
#: Rows of one array, so that it stays in the processor's cache.
ROWS = 8_000
#: Pre-tokens and bytes (of texts and ids, and 200 an entry) that a worker remembers; the memory is emptied when it is full.
MEMO, MEMO_BYTES = 80_000, 24_000_000
#: Code points whose classes are asked for, and ids that are decoded, at a time.
ASKED, DECODED = 0x4000, 1_000_000
#: Characters of text that are split at a time.
GROUP_CHARS = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Splitter:
    """Splits text as tiktoken does. Its tables of letters and digits are asked for, since those of the regex module may be of another Unicode version."""

    def __init__(self, pattern: str | None = None):
        import public_tokenizers
        import regex
        import tiktoken

        self.pattern = pattern or public_tokenizers.PATTERN
        single = {bytes([i]): i for i in range(256)}
        odd: set[str] = set()
        exact = self.pattern
        for name in (r"\p{L}", r"\p{N}"):
            asked = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
            find, theirs, differ = regex.compile(name).findall, [], set()
            for first in range(0, 0x110000, ASKED):
                some = "".join(chr(c) for c in range(first, first + ASKED) if not 0xD800 <= c < 0xE000)
                theirs.append(bytes(asked.encode_ordinary(some)).decode())
                ours = "".join(find(some))
                if ours != theirs[-1]:
                    differ |= set(ours) ^ set(theirs[-1])
            if differ:
                odd |= differ
                exact = exact.replace(name, self._ranges("".join(theirs)))
        self.odd = frozenset(odd)
        self.fast = regex.compile(self.pattern).findall
        self.exact_pattern = self._join_sets(exact)
        self._exact = None

    @staticmethod
    def _ranges(chars: str) -> str:
        codes = np.array(sorted(map(ord, chars)))
        cut = np.flatnonzero(np.diff(codes) != 1)
        starts, ends = codes[np.r_[0, cut + 1]], codes[np.r_[cut, len(codes) - 1]]
        return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends)) + "]"

    @staticmethod
    def _join_sets(pattern: str) -> str:
        import re

        # a class inside a class: drop the inner brackets
        return re.sub(r"\[\^\\s(\[[^\]]*\]|\\p\{L\})(\[[^\]]*\]|\\p\{N\})\]", lambda m: "[^\\s" + m[1].strip("[]") + m[2].strip("[]") + "]", pattern)

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.odd.isdisjoint(text):
            return self.fast(text)
        if self._exact is None:
            import regex

            self._exact = regex.compile(self.exact_pattern).findall
        return self._exact(text)


class Merger:
    """The merges of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.words = [b""] * (max(ranks.values()) + 1)
        for w, r in ranks.items():
            self.words[r] = w
        keys, vals = array("q"), array("i")
        for w, r in ranks.items():
            for cut in range(1, len(w)):
                a, b = ranks.get(w[:cut]), ranks.get(w[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    vals.append(r)
        self._build(np.frombuffer(keys, dtype=np.int64), np.frombuffer(vals, dtype=np.int32))
        #: Ranks of pairs of bytes, by 256 * first + second.
        self.byte_pairs = self.rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))

    def _build(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """An open hash table of pairs; probes go to the next place, so a lookup takes at most self.probes steps."""
        bits = max(8, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << bits, NONE, dtype=np.int32)
        at, left, self.probes = self._place(keys), np.arange(len(keys)), 0
        while len(left):
            free = self.slots[at[left]] < 0
            _, first = np.unique(at[left][free], return_index=True)
            won = left[free][first]
            self.slots[at[won]], self.slot_rank[at[won]] = keys[won], vals[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask
            self.probes += 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; negative ids mark the ends."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        keys[(a < 0) | (b < 0)] = -2
        at = self._place(keys)
        out = np.where(self.slots[at] == keys, self.slot_rank[at], NONE)
        open_ = np.flatnonzero((self.slots[at] != keys) & (self.slots[at] >= 0) & (keys >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            got = self.slots[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def encode(self, piece: bytes) -> list[int]:
        """One pre-token of any length, by a scalar segment tree."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n == 0:
            return []
        width = 1 << max(1, (n - 1).bit_length())
        ranks, words, none = self.ranks, self.words, int(NONE)
        pair = lambda a, b: ranks.get(words[a] + words[b], none)
        ids = [int(self.byte_ids[c]) for c in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = pair(ids[i], ids[i + 1])
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            k >>= 1
            while k:
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1

        while (best := tree[1]) != none:
            k = 1
            while k < width:
                k = 2 * k if tree[2 * k] == best else 2 * k + 1
            i = k - width
            j = after[i]
            ids[i], ids[j] = best, -1
            right = after[i] = after[j]
            put(j, none)
            if right < n:
                before[right] = i
            put(i, pair(best, ids[right]) if right < n else none)
            if (left := before[i]) >= 0:
                put(left, pair(ids[left], best))
        return [x for x in ids if x >= 0]

    def encode_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pre-tokens of 1 to width bytes (width a power of two); the ids as packed little-endian 32-bit integers."""
        rows = len(pieces)
        lens = np.fromiter(map(len, pieces), dtype=np.int64, count=rows)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(rows, width)
        inside = np.arange(width) < lens[:, None]
        ids = np.full((rows, width + 2), -1, dtype=np.int32)  # place 0 and the last are ends
        ids[:, 1:-1] = np.where(inside, self.byte_ids[raw], -1)
        wide = width + 2
        after = np.tile(np.arange(1, wide + 1, dtype=np.int32), (rows, 1))
        before = np.tile(np.arange(-1, wide - 1, dtype=np.int32), (rows, 1))
        tree = np.full((rows, 2 * width), NONE, dtype=np.int32)
        pairs = self.byte_pairs[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]]
        tree[:, width:-1] = np.where(inside[:, 1:], pairs, NONE)
        level = width >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1
        fi, fa, fb, ft = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            base, root = live * wide, live * (2 * width)
            best = ft[root + 1]
            k = np.ones(len(live), dtype=np.int64)
            for _ in range(width.bit_length() - 1):
                k *= 2
                k += ft[root + k] != best
            i = k - width + 1
            j = fa[base + i]
            right = fa[base + j]
            left = fb[base + i]
            fi[base + i], fi[base + j] = best, -1
            fa[base + i] = right
            fb[base + right] = i
            spots = np.concatenate([j, i, np.maximum(left, 1)]).astype(np.int64) + width - 1
            tops = np.concatenate([root, root, root])
            has_left = left >= 1
            beside = np.concatenate([best, fi[(base + left)[has_left]]])
            ranks = self.rank(beside, np.concatenate([fi[base + right], best[has_left]]))
            ft[root + j + width - 1] = NONE
            ft[root + i + width - 1] = ranks[: len(live)]
            ft[(root + left + width - 1)[has_left]] = ranks[len(live) :]
            spots >>= 1
            while spots[0]:
                ft[tops + spots] = np.minimum(ft[tops + 2 * spots], ft[tops + 2 * spots + 1])
                spots >>= 1
            live = live[ft[root + 1] != NONE]
        alive = ids >= 0
        flat = ids[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(axis=1)) * 4
        starts = np.r_[0, ends[:-1]]
        return [flat[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


class Encoder:
    """Text to packed ids, remembering pre-tokens."""

    def __init__(self, path: str, most: int = MEMO, most_bytes: int = MEMO_BYTES):
        self.most, self.most_bytes = most, most_bytes
        self.split = Splitter()
        self.merger = Merger(load_ranks(path))
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def learn(self, lists: list[list[str]]) -> None:
        """Have the ids of all pre-tokens of lists in the memo."""
        memo, ranks = self.memo, self.merger.ranks
        if len(memo) > self.most or self.held > self.most_bytes:
            memo.clear()
            self.held = 0
        rows: dict[int, list[tuple[str, bytes]]] = {}
        for piece in set().union(*lists).difference(memo):
            raw = piece.encode("utf-8", "surrogatepass")
            self.held += 200 + 5 * len(raw)
            whole = ranks.get(raw)
            if whole is not None:
                memo[piece] = whole.to_bytes(4, "little")
            elif len(raw) > WIDEST:
                memo[piece] = np.array(self.merger.encode(raw), dtype="<u4").tobytes()
            else:
                rows.setdefault(1 << max(1, (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, both in rows.items():
            for start in range(0, len(both), ROWS):
                part = both[start : start + ROWS]
                memo.update(zip((p for p, _ in part), self.merger.encode_rows([r for _, r in part], width)))

    def ids(self, piece: str) -> bytes:
        """The ids of one pre-token, by the memo or else by the scalar tree."""
        known = self.memo.get(piece)
        if known is None:
            known = self.memo[piece] = np.array(self.merger.encode(piece.encode("utf-8", "surrogatepass")), dtype="<u4").tobytes()
        return known

    def groups(self, texts: list[str]):
        """Lists of pre-tokens of each text, for a bounded number of characters at a time, with the memo filled."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= GROUP_CHARS):
                chars += len(texts[end])
                end += 1
            lists = [self.split(t) for t in texts[start:end]]
            self.learn(lists)
            yield from lists
            start = end

    def encode(self, texts: list[str]):
        get = self.memo.__getitem__
        for pieces in self.groups(texts):
            yield b"".join(map(get, pieces))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, most: int = MEMO, most_bytes: int = MEMO_BYTES) -> Encoder:
    """This worker's encoder, kept for later tasks."""
    name = (path, most, most_bytes)
    if name not in _encoders:
        _encoders[name] = Encoder(*name)
    return _encoders[name]


class Decoder:
    """Packed ids to bytes, out of one buffer of all words."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        words = [b""] * (max(ranks.values()) + 1)
        for w, r in ranks.items():
            words[r] = w
        self.sizes = np.array(list(map(len, words)), dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(words), dtype=np.uint8)

    def __call__(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4")
        return b"".join(self._part(ids[a : a + DECODED]) for a in range(0, len(ids), DECODED))

    def _part(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()


_decoders: dict[str, Decoder] = {}


def decoder(path: str) -> Decoder:
    """This worker's decoder; it needs no encoder."""
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def encode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df with ids (binary: packed little-endian unsigned 32-bit ids) and n_tokens (long)."""
    import pyarrow as pa

    path = path or default_path()

    def made(batch):
        out = [x for texts in common.text_slices(batch.column(batch.schema.get_field_index(text))) for x in encoder(path).encode(texts)]
        return [pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in out], pa.int64())]

    return common.add_columns(df, made, "ids binary, n_tokens bigint")


def round_trip(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df with ids, n_tokens and decoded: encode() and decode() of the ids in one pass, with one worker for each task."""
    import pyarrow as pa

    path = path or default_path()

    def made(batch):
        out, back = [], []
        for texts in common.text_slices(batch.column(batch.schema.get_field_index(text))):
            some = list(encoder(path).encode(texts))
            out += some
            back += map(decoder(path), some)
        return [pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(back, pa.binary())]

    return common.add_columns(df, made, "ids binary, n_tokens bigint, decoded binary")


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with decoded (binary): the bytes of the packed ids; null ids decode to no bytes."""
    import pyarrow as pa

    path = path or default_path()

    def made(batch):
        words, column = decoder(path), batch.column(batch.schema.get_field_index(ids))
        return [pa.array((words(x.as_py() or b"") for x in column), pa.binary())]

    return common.add_columns(df, made, "decoded binary")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = round_trip(docs)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
