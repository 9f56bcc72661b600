"""Token counts by prefix dynamic programming over BPE pieces.

The counts are those of the ``tokenizers`` library for a word-level BPE file:
its normaliser, its split into pieces and its special strings are as the file
states them. Every piece is a run of byte symbols of which the last carries the
word-end mark. The tokens of a piece's prefix are those of a shorter prefix and
one token more: the only vocabulary entry that ends there and stays apart from
the token before it under the merge rules. So one pass over a piece gives the
token count of each of its prefixes, as inner text and as a whole piece. The new
pieces of a block are taken together, a byte of each at a time (``Together``).

``prefix_tables`` stores the exact count of every prefix of every document,
inside words and special strings as well. A task deals its rows to blocks of
``BLOCK_BYTES`` of text; a document holds the numbers of its runs between white
space, and each distinct run of the block stands once, with the counts of all its
prefixes. A prefix's count is the sum of the runs before its last one plus that
run's own entry: ``token_counts`` reads a document's count and the longest prefix
within the limit from there, and ``stored_prefixes`` gives any document's counts
back as one array, none of them by encoding. ``tokens_before`` and
``chars_within`` are then lookups.

Defined cases: null text has no tokens; repeated rows repeat their counts; a
very long text is a block of its own; an empty table gives an empty one. Runs
that are not plain ASCII are normalised and split by the library's own objects.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata
from collections.abc import Callable, Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType

from .common import written

DEFAULT_FILE = "word_bpe_49k.json"
CACHE = 300_000  # entries that each of a worker's caches holds; a full one begins anew
RECENT_RUNS = 150_000  # runs of a generation; a worker knows those of two
SHARED_CHARS = 8  # words share what is known of their beginnings up to this length, ...
BEGINNINGS = 600_000  # ... of which a worker keeps so many
BLOCK_BYTES = 16 << 20
LISTED = 8192  # runs of a block's table that one row carries
TOGETHER = 65_536  # runs whose new pieces are counted together, and pieces at a time, ...
TOGETHER_BYTES = 32  # ... of at most so many bytes each

#: Runs that any file of this kind takes for one piece of letters and one of other signs, each code point's lower case being one.
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@[-`{-~]*)")
#: Tables that add a number to each byte.
_ADDED = [bytes(min(255, k + n) for k in range(256)) for n in range(TOGETHER_BYTES + 1)]

_counters: dict[str, PieceCounter] = {}


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte, by the byte-level rule: printable Latin-1 stays, others follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Together:
    """The same counts for many short pieces at once, by an automaton of all entries.

    Its state after a byte names the longest entry that ends there, and every
    entry the next shorter one: the candidates of ``_step``, longest first.
    """

    def __init__(self, c: PieceCounter) -> None:
        self.c, byte = c, {s: b for b, s in enumerate(c.symbols)}
        children: list[dict[int, int]] = [{}]
        ends: tuple[dict[int, int], dict[int, int]] = {}, {}  # inner entries, those with the word-end mark
        for text, token in c.ids.items():
            kinds = (0, 1) if not c.end else (1,) if text.endswith(c.end) else (0,)
            for kind in kinds:
                stem = text.removesuffix(c.end) if kind else text
                if not stem or any(x not in byte for x in stem):
                    continue
                at = 0
                for x in stem:
                    nxt = children[at].get(byte[x])
                    if nxt is None:
                        nxt = children[at][byte[x]] = len(children)
                        children.append({})
                    at = nxt
                ends[kind][at] = token
        n = len(children)
        # Bytes that only begin entries lead to one state from anywhere; the others have a column.
        inner = sorted({b for made in children[1:] for b in made})
        self.column, self.root = np.full(256, -1, np.int16), np.zeros(256, np.int32)
        self.column[inner] = range(len(inner))
        self.root[list(children[0])] = list(children[0].values())
        self.table, fail = np.zeros((n, len(inner)), np.int32), np.zeros(n, np.int32)
        self.out, self.shorter = np.full((2, n), -1, np.int32), np.full((2, len(c.ids)), -1, np.int32)
        self.size = np.zeros((2, len(c.ids)), np.int32)
        level, depth = [0], 0
        while level:
            edges = np.array([(s, b, t) for s in level for b, t in children[s].items()], np.int32).reshape(-1, 3)
            columns = self.column[edges[:, 1]]
            if depth:
                self.table[level] = self.table[fail[level]]
                fail[edges[:, 2]] = self.table[edges[:, 0], columns]
                self.table[edges[:, 0], columns] = edges[:, 2]
            else:
                self.table[0] = self.root[inner]
            for kind in (0, 1):
                self.out[kind, level] = self.out[kind, fail[level]] if depth else -1
                for s in level:
                    if (token := ends[kind].get(s)) is not None:
                        self.shorter[kind, token], self.size[kind, token], self.out[kind, s] = self.out[kind, s], depth, token
            level, depth = edges[:, 2].tolist(), depth + 1
        self.keys, self.values = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_stays_apart of pairs; the last answer of each slot is known."""
        key = left.astype(np.int64) << 32 | right
        slot = (left.astype(np.int64) * 1_000_003 + right) * 2_654_435_761 >> 12 & (len(self.keys) - 1)
        found, known = self.values[slot], self.keys[slot] == key
        if not known.all():
            new, of = np.unique(key[~known], return_inverse=True)
            answers = np.array([self.c._merged_apart(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], bool)
            found[~known] = answers[of]
            # Of new pairs in one slot the first stays: key and answer have to be of one pair.
            at, first = np.unique(slot[~known], return_index=True)
            self.keys[at], self.values[at] = key[~known][first], found[~known][first]
        return found

    def _last(self, kind: int, state: np.ndarray, end: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ids) of the tokens that end the prefixes of so many bytes."""
        token = self.out[kind, state]
        open_ = np.arange(len(token))
        while len(open_):
            if (token[open_] < 0).any():
                raise ValueError("the file lacks a byte's symbol")
            start = end - self.size[kind, token[open_]]
            open_, start = open_[start > 0], start[start > 0]
            open_ = open_[~self._apart(last[open_, start], token[open_])]
            token[open_] = self.shorter[kind, token[open_]]
        return end - self.size[kind, token], token

    def counts(self, pieces: Collection[str], chars: bool = False) -> dict[str, bytes]:
        """Of each piece the token counts of its byte prefixes (chars: of those that end a code point), from one on, as whole pieces; long pieces, and those that spell the mark, are left out."""
        coded = sorted(((b, p) for p in pieces if 0 < len(b := p.encode()) <= TOGETHER_BYTES and not (self.c.end and self.c.end in p)), key=lambda x: -len(x[0]))
        out: dict[str, bytes] = {}
        for at in range(0, len(coded), TOGETHER):
            part = coded[at : at + TOGETHER]
            lengths = np.array([len(b) for b, _ in part])
            width = int(lengths[0])
            text = np.frombuffer(b"".join([b.ljust(width) for b, _ in part]), np.uint8).reshape(len(part), width)
            inner, last = np.zeros((len(part), width + 1), np.uint8), np.full((len(part), width + 1), -1, np.int32)
            whole, state = np.zeros((len(part), width), np.uint8), np.zeros(len(part), np.int32)
            for end in range(1, width + 1):
                rows = np.arange(int(np.searchsorted(-lengths, -end, side="right")))
                byte = text[: len(rows), end - 1]
                column = self.column[byte]
                state = np.where(column < 0, self.root[byte], self.table[state[: len(rows)], column])
                start, _ = self._last(1, state, end, last)
                whole[rows, end - 1] = inner[rows, start] + 1
                start, token = self._last(0, state, end, last)
                inner[rows, end], last[rows, end] = inner[rows, start] + 1, token
            kept = np.arange(width) < lengths[:, None]
            if chars:  # the byte after it is no continuation
                kept[:, :-1] &= text[:, 1:] & 0xC0 != 0x80
            counts, ends = whole[kept].tobytes(), np.cumsum(kept.sum(axis=1)).tolist()
            out.update((p, counts[a:b]) for (_, p), a, b in zip(part, [0, *ends], ends, strict=False))
        return out


class PieceCounter:
    """Counts for the pieces of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = ["".join(m) for m in merges]
        later = set(made)
        base = [t for t in model["vocab"] if t not in later]
        #: Tokens in the order in which merging makes them: single symbols first.
        self.ids = {t: k for k, t in enumerate([*base, *made])}
        self.halves = [(k, k) for k in range(len(base))] + [(self.ids[a], self.ids[b]) for a, b in merges]
        self.joined = {pair: len(base) + k for k, pair in enumerate(self.halves[len(base) :])}
        self.longest = max(map(len, self.ids))
        self.symbols = _byte_symbols()
        #: What every special string begins with: texts without it hold none.
        self.hint = os.path.commonprefix([t["content"] for t in spec["added_tokens"]])
        self.special = regex.compile("(" + "|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) + ")")
        self.piece = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.apart: dict[tuple[int, int], bool] = {}
        self.begun: dict[str, int] = {}
        self.counts: dict[str, int] = {}
        self.inside: dict[str, Sequence[int]] = {}
        self.before: dict[str, Sequence[int]] = {}
        self.path = path
        self.library: tuple | None = None
        self.together: Together | None = None

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether merging the symbols of both gives just these two tokens.

        It does not if some token over their border would have been made before
        the tokens beside the border were. These are taken back one merge at a
        time, the later one first.
        """
        key = (left, right)
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) >= CACHE:
                self.apart.clear()
            found = self.apart[key] = self._merged_apart(left, right)
        return found

    def _merged_apart(self, left: int, right: int) -> bool:
        """_stays_apart, worked out."""
        before = len(self.halves)  # the border's next merge must come before this one
        while True:
            if self.joined.get((left, right), before) < before:
                return False
            a, b = self.halves[left][1], self.halves[right][0]
            if a == left and b == right:
                return True
            if b == right or (a != left and left > right):
                before, left = left, a
            else:
                before, right = right + 1, b

    def _step(self, text: str, end: int, mark: str, last: list[int]) -> tuple[int, int]:
        """(start, id) of the token that ends the prefix text[:end]."""
        for start in range(max(0, end - self.longest), end):
            token = self.ids.get(text[start:end] + mark)
            if token is not None and (not start or self._stays_apart(last[start], token)):
                return start, token
        raise ValueError("the file lacks a byte's symbol")

    def prefixes(self, piece: str) -> tuple[list[int], list[int]]:
        """Token counts of each byte prefix of a normalised piece: (inside a longer piece, as a whole piece)."""
        text = "".join([self.symbols[b] for b in piece.encode()])
        begun, inner, whole, last = self.begun, [0], [0], [-1]
        for end in range(1, len(text) + 1):
            found = begun.get(text[:end]) if end <= SHARED_CHARS else None
            if found is None:  # it depends on the prefix alone
                start, _ = self._step(text, end, self.end, last)
                inside, token = self._step(text, end, "", last)
                inner.append(inner[inside] + 1)
                whole.append(inner[start] + 1)
                last.append(token)
                if end <= SHARED_CHARS:
                    if len(begun) >= BEGINNINGS:
                        begun.clear()
                    begun[text[:end]] = token << 8 | inner[-1] << 4 | whole[-1]  # both counts are below 16
            else:
                inner.append(found >> 4 & 15)
                whole.append(found & 15)
                last.append(found >> 8)
        return inner, whole

    def count(self, piece: str) -> int:
        n = self.counts.get(piece)
        if n is None:
            if len(self.counts) >= CACHE:
                self.counts.clear()
            n = self.counts[piece] = self.prefixes(piece)[1][-1]
        return n

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special strings, and these (True)."""
        for k, part in enumerate(self.special.split(text)):
            if part:
                yield part, bool(k % 2)

    def _pieces(self, run: str) -> tuple[str, list[tuple[int, int]]]:
        """The normalised run and where its pieces lie."""
        if run.isascii():
            normal = run.lower()
            return normal, [m.span() for m in self.piece.finditer(normal)]
        if self.library is None:
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(self.path)
            self.library = lib.normalizer, lib.pre_tokenizer
        normal = self.library[0].normalize_str(run)
        return normal, [at for _, at in self.library[1].pre_tokenize_str(normal)]

    def _run(self, run: str) -> int:
        """Tokens of a text without special strings."""
        total = 0
        for part in run.replace("\n", " ").split(" "):
            normal, pieces = self._pieces(part)
            total += sum(self.count(normal[a:b]) for a, b in pieces)
        return total

    def _piece_prefixes(self, piece: str, known: dict[str, bytes]) -> Sequence[int]:
        """Counts of a normalised piece's prefixes by code points, from one on; known: those by bytes."""
        if piece[0] == "'" and len(piece) > 1:  # a contraction's prefixes are split otherwise
            return [sum(map(self.count, self.piece.findall(piece[:k]))) for k in range(1, len(piece) + 1)]
        whole = known.get(piece)
        if whole is None:
            whole = self.prefixes(piece)[1][1:]
        if len(whole) == len(piece):
            return whole
        at, out = -1, []
        for c in piece:
            at += len(c.encode())
            out.append(whole[at])
        return out

    def run_prefixes(self, run: str, known: dict[str, bytes] | None = None, split: tuple[str, list[tuple[int, int]]] | None = None) -> Sequence[int]:
        """Counts of all prefixes of a run without spaces, the empty one first; as bytes where they fit, which takes a third of a list.

        known: counts of pieces; split: what _pieces gives.
        """
        found = self.inside.get(run)
        if found is not None:
            return found
        if len(self.inside) >= RECENT_RUNS:
            self.before, self.inside = self.inside, {}
        found = self.before.get(run)
        if found is not None:
            return found
        (normal, pieces), out, total = split or self._pieces(run), [0], 0
        if self._kept(run, normal):
            for a, b in pieces:
                out += [total] * (a + 1 - len(out))
                counts = self._piece_prefixes(normal[a:b], known or {})
                out += [total + n for n in counts] if total else counts
                total = out[-1]
            out += [total] * (len(run) + 1 - len(out))
        else:  # a prefix is normalised otherwise than the run
            out += [self._run(run[:k]) for k in range(1, len(run) + 1)]
        found = self.inside[run] = bytes(out) if max(out) < 256 else out
        return found

    def _kept(self, run: str, normal: str) -> bool:
        """Whether the run's prefixes are normalised as it is, one code point to one."""
        return len(normal) == len(run) and (run.isascii() or unicodedata.is_normalized("NFC", run))

    def tables(self, runs: Collection[str]) -> list[Sequence[int]]:
        """run_prefixes of each run, or every_prefix of what follows a line feed; new pieces of many runs are counted together."""
        if self.together is None:
            self.together = Together(self)
        runs, out = list(runs), []
        for at in range(0, len(runs), TOGETHER):
            out += self._tables(runs[at : at + TOGETHER])
        return out

    def _tables(self, runs: list[str]) -> list[Sequence[int]]:
        """tables of so many runs; those of a word and signs behind it are put together from these two pieces."""
        words = [m and (m[1].lower(), m[2]) for m in map(_WORD.fullmatch, runs)]
        known = self.together.counts({x for w in words if w for x in w if x}, chars=True)
        made: list = [known.get(w[0]) if w and (not w[1] or w[1] in known) else None for w in words]
        rest = [r for r, counts in zip(runs, made, strict=True) if counts is None and r[:1] != "\n"]
        split = {r: self._pieces(r) for r in rest if r not in self.inside and r not in self.before}
        pieces = self.together.counts({normal[a:b] for r, (normal, spans) in split.items() if self._kept(r, normal) for a, b in spans})
        out: list[Sequence[int]] = []
        for r, w, counts in zip(runs, words, made, strict=True):
            if counts is None:
                out.append(self.every_prefix(r[1:]).tolist() if r[:1] == "\n" else self.run_prefixes(r, pieces, split.get(r)))
            elif w[1]:
                out.append(b"\0" + counts + known[w[1]].translate(_ADDED[counts[-1]]))
            else:
                out.append(b"\0" + counts)
        return out

    def every_prefix(self, text: str) -> np.ndarray:
        """Token counts of text[:k] for k from 0 to its length."""
        out, total, tail, before = [0], 0, "", 0
        for part, special in self.parts(text):
            if special:  # a prefix that ends within it goes on with the run before it
                out += [before + self._run(tail + part[:k]) for k in range(1, len(part))]
                total += 1
                out.append(total)
                tail, before = "", total
                continue
            for k, run in enumerate(part.replace("\n", " ").split(" ")):
                if k:
                    out.append(total)
                counts = self.run_prefixes(run)
                out += [total + n for n in counts[1:]] if total else counts[1:]
                tail, before = run, total
                total += counts[-1]
        return np.array(out, np.int32)


def counter(path: str) -> PieceCounter:
    """The worker's counter of a file."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def _with_columns(df: DataFrame, path: str, made: dict[str, pa.DataType], types: list[DataType], values: Callable[[PieceCounter, str], tuple]) -> DataFrame:
    """df's columns but text, with what values gives for each text."""
    taken = set(made) & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are this operator's own")
    at, schema = df.columns.index("text"), df.drop("text").schema
    for name, kind in zip(made, types, strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            rows = [values(c, t or "") for t in batch.column(at).to_pylist()]
            rest = [x for k, x in enumerate(batch.columns) if k != at]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays([*rest, *columns], names=schema.names)

    return df.mapInArrow(run, schema)


class Block:
    """Rows of a task until they hold BLOCK_BYTES of text."""

    def __init__(self, number: int) -> None:
        self.number, self.size = number, 0
        self.texts: list[str] = []
        self.whole: list[int] = []  # texts with special strings
        self.rest: list[pa.RecordBatch] = []

    def add(self, c: PieceCounter, text: str) -> None:
        if c.hint in text and any(special for _, special in c.parts(text)):
            self.whole.append(len(self.texts))
        self.texts.append(text)
        self.size += len(text)

    def runs(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct runs, the number of each run of the texts, and where each text's begin (and the last one's end)."""
        plain = pa.array(self.texts, pa.large_string())
        if self.whole:
            mask = np.zeros(len(plain), bool)
            mask[self.whole] = True
            plain = pc.if_else(pa.array(mask), "", plain)
        split = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        units, starts, runs = coded.indices.to_numpy().copy(), split.offsets.to_numpy(), coded.dictionary.to_pylist()
        for k in self.whole:  # no run holds a line feed: this is a whole text with special strings
            units[starts[k]] = len(runs)
            runs.append("\n" + self.texts[k])
        return runs, units, starts

    def rows(self, c: PieceCounter, limit: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The documents, then the table of the block's runs."""
        runs, units, starts = self.runs()
        tables = c.tables(runs)
        last, chars = np.array([t[-1] for t in tables]), np.array([len(t) for t in tables])
        totals, fits = [], []
        for begin, end in itertools.pairwise(starts.tolist()):
            u = units[begin:end]
            ends = np.cumsum(last[u])
            totals.append(int(ends[-1]))
            over = int(np.searchsorted(ends, limit, side="right"))  # the first run that goes beyond the limit
            if over == len(u):
                fits.append(int(chars[u].sum()) - 1)
            else:
                before = int(ends[over - 1]) if over else 0
                fits.append(int(chars[u[:over]].sum()) + max(k for k, n in enumerate(tables[u[over]]) if before + n <= limit))
        rest = pa.Table.from_batches(self.rest).combine_chunks()
        made = {
            "n_bytes": pa.array([len(t.encode()) for t in self.texts]), "n_tokens": pa.array(totals), "over_limit": pa.array([n > limit for n in totals]), "fit_chars": pa.array(fits),
            "block": pa.array([self.number] * len(totals)), "units": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(units)),
        }
        yield from pa.Table.from_arrays([rest[f.name] if f.name in rest.column_names else made[f.name].cast(f.type) if f.name in made else pa.nulls(len(totals), f.type) for f in schema], schema=schema).to_batches()
        for at in range(0, len(tables), LISTED):
            part = tables[at : at + LISTED]
            values = np.frombuffer(b"".join(part), np.uint8) if all(isinstance(t, bytes) for t in part) else np.concatenate([np.array(list(t)) for t in part])
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(chars[at : at + LISTED])), pa.int32()), pa.array(values.astype(np.int32)))
            made = {"block": pa.array([self.number]), "first": pa.array([at], pa.int32()), "prefixes": pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), listed)}
            yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(1, f.type) for f in schema], schema=schema)


OWN = {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean", "fit_chars": "long", "block": "long", "units": "array<int>", "first": "int", "prefixes": "array<array<int>>"}


def prefix_tables(df: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """A row for each of df's (its columns but text, n_bytes, n_tokens, over_limit, fit_chars, and its runs' numbers in its block), and rows with first and prefixes: a block's runs from that number on."""
    taken = set(OWN) & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are this operator's own")
    kept = df.drop("text")
    out = kept.select("*", *[F.lit(None).cast(kind).alias(n) for n, kind in OWN.items()])
    at, names = df.columns.index("text"), kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, block, schema = counter(path), Block(TaskContext.get().partitionId() << 32), None
        for batch in batches:
            rest, begin = pa.RecordBatch.from_arrays([x for k, x in enumerate(batch.columns) if k != at], names=names), 0
            schema = schema or pa.schema([*rest.schema, *(pa.field(n, kind) for n, kind in _KINDS.items())])
            for k, text in enumerate(batch.column(at)):
                block.add(c, text.as_py() or "")
                if block.size >= BLOCK_BYTES:
                    block.rest.append(rest.slice(begin, k + 1 - begin))
                    yield from block.rows(c, limit, schema)
                    block, begin = Block(block.number + 1), k + 1
            if begin < batch.num_rows:
                block.rest.append(rest.slice(begin))
        if block.texts:
            yield from block.rows(c, limit, schema)

    return df.mapInArrow(run, out.schema)


_KINDS = {"n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_(), "fit_chars": pa.int64(), "block": pa.int64(), "units": pa.list_(pa.int32()), "first": pa.int32(), "prefixes": pa.list_(pa.list_(pa.int32()))}


def token_counts(df: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """df's columns but text, with n_bytes, n_tokens, over_limit and fit_chars (code points of the longest prefix within the limit), from stored prefix counts."""
    stored = written(prefix_tables(df, path, limit), "token-prefixes")
    return stored.filter(F.col("first").isNull()).drop("block", "units", "first", "prefixes")


def stored_prefixes(stored: DataFrame) -> DataFrame:
    """The documents of prefix_tables with prefix_tokens, the token counts of their prefixes of 0, 1, 2, ... code points, put together from the stored runs."""
    docs = stored.filter(F.col("first").isNull()).drop("first", "prefixes")
    tables = stored.filter(F.col("first").isNotNull()).select(F.col("block").alias("of_block"), "first", "prefixes")
    kept = docs.drop("block", "units")
    out, names = kept.withColumn("prefix_tokens", F.lit(None).cast("array<int>")), kept.columns

    def joined(rows: pa.Table, block: pa.Table) -> pa.Table:
        runs = [np.array(x) for part in block.sort_by("first")["prefixes"].to_pylist() for x in part]
        counts = []
        for units in rows["units"].to_pylist():
            total, parts = 0, []
            for k in units:
                parts.append(runs[k] + total)
                total += int(runs[k][-1])
            counts.append(np.concatenate(parts))
        return rows.select(names).append_column("prefix_tokens", pa.array(counts, pa.list_(pa.int32())))

    return docs.groupBy("block").cogroup(tables.groupBy("of_block")).applyInArrow(joined, out.schema)


def prefix_counts(df: DataFrame, path: str) -> DataFrame:
    """df's columns but text, with prefix_tokens: the token counts of the text's prefixes of 0, 1, 2, ... code points."""
    return _with_columns(df, path, {"prefix_tokens": pa.list_(pa.int32())}, [ArrayType(IntegerType())], lambda c, text: (c.every_prefix(text),))


def tokens_before(chars: Column) -> Column:
    """Tokens of the text's first code points (of all of it, if it has fewer)."""
    return F.element_at("prefix_tokens", F.least(chars + 1, F.size("prefix_tokens")).cast("int"))


def chars_within(tokens: Column) -> Column:
    """Code points of the longest prefix of at most so many tokens."""
    return F.array_max(F.filter(F.transform("prefix_tokens", lambda n, k: F.when(n <= tokens, k)), lambda k: k.isNotNull()))
