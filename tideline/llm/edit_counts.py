"""Edit-aware token counts (operator 5).

Every document keeps a segment tree over its pre-tokens; a node holds the
characters and the tokens below it. build_trees() makes a table of them, one
pass over the texts; update_trees() reads that table and applies edits, each of
which replaces a range of characters, and gives the edited texts and trees back,
so the table can be kept from revision to revision. Stored are the leaves, two
numbers a pre-token; the sums above them are additions when a tree is read, and
no text is split or encoded for it.

Only the pre-tokens that an edit touches are encoded again, together with
boundary context: splitting starts a few characters before the edit, and goes on
until a new boundary falls on an old one behind the edit. From there the rest is
the same, since a match depends on nothing before its start. Then the leaves in
between are replaced and the sums above them updated.

Defined results: a null text counts as empty, null edits as none; a null tree is
built anew, and a tree that doesn't have its text's length is an error; an edit
is clamped to the text as it stands; edits apply in the order of the array;
documents with one id are separate rows; extra columns pass through (those named
like an output are replaced, and outputs stand last); an empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

#: A match looks at most so many characters past its end (contractions and the blank look-ahead take two).
LOOK = 4
EDITS = "array<struct<start:bigint,length:bigint,replacement:string>>"


def pack(chars: np.ndarray, tokens: np.ndarray) -> bytes:
    """Leaves as bytes: the width of a number, then the characters and the tokens of every pre-token."""
    most = max(int(chars.max(initial=0)), int(tokens.max(initial=0)))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + chars.astype(f"<u{width}").tobytes() + tokens.astype(f"<u{width}").tobytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(packed, dtype=f"<u{packed[0]}", offset=1).astype(np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


class Tree:
    """Sums of characters and tokens over pre-tokens. A slot holds the pre-tokens that have taken the place of one old leaf."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.base, self.leaves = text, (chars, tokens)
        self.ends = np.cumsum(chars)
        if len(text) != (self.ends[-1] if len(chars) else 0):
            raise ValueError("the tree doesn't fit its text")
        self.count = max(1, len(chars))
        self.width = 1 << (self.count - 1).bit_length()
        self.chars, self.tokens = self._sums(chars, tokens)
        #: Pre-tokens, and their tokens, of the slots that edits have changed.
        self.changed: dict[int, tuple[list[str], list[int]]] = {}

    def _sums(self, *leaves: np.ndarray) -> np.ndarray:
        out = np.zeros((len(leaves), 2 * self.width), dtype=np.int64)
        for row, values in zip(out, leaves):
            row[self.width : self.width + len(values)] = values
        k = self.width
        while k > 1:
            np.add(out[:, k : 2 * k : 2], out[:, k + 1 : 2 * k : 2], out=out[:, k // 2 : k])
            k //= 2
        return out

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def slot(self, k: int) -> list[str]:
        """The pre-tokens of a slot."""
        if k in self.changed:
            return self.changed[k][0]
        if k >= len(self.ends):
            return []
        return [self.base[self.ends[k - 1] if k else 0 : self.ends[k]]]

    def find(self, at: int) -> tuple[int, int]:
        """The slot that holds character at, and the characters before that slot."""
        k, before = 1, 0
        while k < self.width:
            k *= 2
            left = int(self.chars[k])
            if at >= before + left and self.chars[k + 1]:
                before += left
                k += 1
        return k - self.width, before

    def put(self, slot: int, pieces: list[str], tokens: list[int]) -> None:
        self.changed[slot] = (pieces, tokens)
        k = slot + self.width
        path = k >> np.arange(k.bit_length())
        self.chars[path] += sum(map(len, pieces)) - self.chars[k]
        self.tokens[path] += sum(tokens) - self.tokens[k]

    def edit(self, start: int, length: int, replacement: str, encoder: bpe.Encoder) -> int:
        """Apply one edit; returns how many pre-tokens were encoded again."""
        start = min(max(start, 0), self.n_chars)
        length = min(max(length, 0), self.n_chars - start)
        if not length and not replacement:
            return 0
        first, before = self.find(max(start - LOOK, 0))
        last, known = first, 0
        text, bounds, taken = [], {0}, []

        def take() -> list[str]:
            """The next slot's pre-tokens, of which text, bounds, taken (pre-tokens and characters by slot) and known are told."""
            nonlocal last, known
            more, so_far = self.slot(last), known
            for p in more:
                known += len(p)
                bounds.add(known)
            text.extend(more)
            taken.append((len(more), known - so_far))
            last += 1
            return more

        while last < self.count and before + known <= start + length:
            take()
        old = "".join(text)
        cut, stop = start - before, start - before + length
        changed = old[:cut] + replacement + old[stop:]
        edge = cut + len(replacement)  # nothing behind it has changed
        tail = len(old) - len(changed)
        while True:
            pieces, at, met = encoder.split(changed), 0, None
            for k, p in enumerate(pieces):
                at += len(p)
                # A boundary is sure when the pre-token's end and what it looked at lie inside the known text.
                if at >= edge and at + tail in bounds and (at + LOOK <= len(changed) or last >= self.count):
                    met = k + 1
                    break
            if met is not None or last >= self.count:
                break
            behind = []
            for _ in range(max(4, last - first)):  # not met yet: take in more of what follows
                if last < self.count:
                    behind += take()
            changed += "".join(behind)
        made = pieces[: met if met is not None else len(pieces)]
        fresh = len(made)
        rest = len(changed) - sum(map(len, made))
        while last - first > 1 and taken[-1][1] <= rest:  # slots behind the meeting point stay as they are
            n, chars = taken.pop()
            del text[len(text) - n :]
            rest -= chars
            last -= 1
        kept = []
        while rest > 0:  # old pre-tokens of a slot that the edit reaches into
            kept.append(text.pop())
            rest -= len(kept[-1])
        made = made + kept[::-1]
        self.put(first, made, [len(encoder.ids(p)) // 4 for p in made])
        for slot in range(first + 1, last):
            self.put(slot, [], [])
        return fresh

    def text(self) -> str:
        out, at = [], 0
        for slot in sorted(self.changed):
            start, end = (int(self.ends[k - 1]) if k else 0 for k in (slot, min(slot + 1, len(self.ends))))
            out += [self.base[at:start], *self.changed[slot][0]]
            at = end
        return "".join([*out, self.base[at:]])

    def packed(self) -> bytes:
        """The leaves as they stand."""
        columns: list[list[np.ndarray]] = [[], []]
        at = 0
        for slot in sorted(self.changed):
            pieces, tokens = self.changed[slot]
            for column, leaves, new in zip(columns, self.leaves, (list(map(len, pieces)), tokens)):
                column += [leaves[at:slot], np.array(new, dtype=np.int64)]
            at = slot + 1
        return pack(*(np.concatenate([*column, leaves[at:]]) for column, leaves in zip(columns, self.leaves)))


#: Pre-tokens and bytes that a worker remembers here: no other operator runs beside this one.
MEMO = (300_000, 96_000_000)
COUNTS = "n_tokens_before bigint, n_tokens_after bigint, n_chars_after bigint, n_edits bigint, n_pretokens bigint, n_reencoded bigint"


def leaves(encoder: bpe.Encoder, texts: list[str]):
    """The characters and the tokens of the pre-tokens of each text."""
    for pieces in encoder.groups(texts):
        get, n = encoder.memo.__getitem__, len(pieces)
        yield np.fromiter(map(len, pieces), np.int64, n), np.fromiter(map(len, map(get, pieces)), np.int64, n) // 4


def build_trees(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df with tree (binary: the leaves of the text's tree) and n_tokens (long)."""
    import pyarrow as pa

    path = path or bpe.default_path()

    def made(batch):
        encoder, trees, totals = bpe.encoder(path, *MEMO), [], []
        for texts in common.text_slices(batch.column(batch.schema.get_field_index(text))):
            for chars, tokens in leaves(encoder, texts):
                trees.append(pack(chars, tokens))
                totals.append(int(tokens.sum()))
        return [pa.array(trees, pa.binary()), pa.array(totals, pa.int64())]

    return common.add_columns(df, made, "tree binary, n_tokens bigint")


def update_trees(df: DataFrame, text: str = "text", tree: str = "tree", edits: str = "edits", path: str | None = None, counts_only: bool = False) -> DataFrame:
    """df, a table of build_trees() with edits, after them: COUNTS and, unless counts_only, the edited text and tree in place of the old ones and n_tokens."""
    import pyarrow as pa

    path = path or bpe.default_path()

    def made(batch):
        encoder, rows, news = bpe.encoder(path, *MEMO), [], []
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        done = 0
        for texts in common.text_slices(column(text)):
            stored, todo = (column(c).slice(done, len(texts)).to_pylist() for c in (tree, edits))
            done += len(texts)
            anew = leaves(encoder, [t for t, packed in zip(texts, stored) if not packed])
            for t, packed, change in zip(texts, stored, todo):
                it = Tree(t, *(unpack(packed) if packed else next(anew)))
                before, held, change = it.n_tokens, len(it.leaves[0]), [e for e in change or () if e]
                again = sum(it.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "", encoder) for e in change)
                rows.append((before, it.n_tokens, it.n_chars, len(change), held, again))
                if not counts_only:
                    news.append((it.text(), it.packed(), it.n_tokens))
        out = [pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)]
        if not counts_only:
            out += [pa.array([n[i] for n in news], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.int64()))]
        return out

    return common.add_columns(df, made, COUNTS if counts_only else f"{COUNTS}, `{text}` string, `{tree}` binary, n_tokens bigint")


def count_with_edits(df: DataFrame, text: str = "text", edits: str = "edits", path: str | None = None) -> DataFrame:
    """df with n_tokens_before, n_tokens_after, n_chars_after, n_edits, n_pretokens and n_reencoded (all long), of trees that aren't kept."""
    tree = common.fresh(df, "tree")
    made = df.withColumn(tree, F.lit(None).cast("binary"))
    return update_trees(made, text, tree, edits, path, counts_only=True).drop(tree)


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the array column edits, from a table (doc_id, seq, start, length, replacement)."""
    grouped = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "length", "replacement"))).alias("edits"))
    plain = grouped.select(F.col("doc_id").alias("_edit_doc"), F.transform("edits", lambda e: F.struct(e["start"].cast("bigint").alias("start"), e["length"].cast("bigint").alias("length"), e["replacement"].alias("replacement"))).alias("edits"))
    return docs.drop("edits").join(plain, common.same(docs["doc_id"], plain["_edit_doc"]), "left").drop("_edit_doc")


def sample_edits(docs: DataFrame) -> DataFrame:
    """The revision that the query applies to every document: a new opening, a rewritten middle and a shortened end."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    make = lambda start, length, new: F.struct(start.cast("bigint").alias("start"), F.lit(length).cast("bigint").alias("length"), F.lit(new).alias("replacement"))
    return docs.withColumn("edits", F.array(make(F.lit(0), 0, "Revised: "), make(F.floor(n / 2), 5, "amended 2nd wording"), make(F.greatest(n - 3, F.lit(0)), 7, "")))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = common.materialize(build_trees(docs).select("doc_id", "text", "tree"), "trees", "zstd")
    return update_trees(sample_edits(trees), counts_only=True).select("doc_id", "n_tokens_before", "n_tokens_after", "n_chars_after", "n_edits", "n_pretokens", "n_reencoded")
