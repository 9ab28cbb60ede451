"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A text is cut into pre-tokens as the tokenizer prescribes. In each of them the program stores,
for every prefix, the one token that its encoding ends with. Candidates are the tokens that are a
suffix of the prefix, read off a suffix automaton of the vocabulary; the right one is the one that
is compatible with the last token of what precedes it, that is, merging byte pairs in rank order
never crosses the border between the two. Back-pointers then give the ids, exactly as merging in
rank order does.

The automaton and the merge tables are built on the driver and broadcast: their size is the
vocabulary's. Workers remember the ids of pre-tokens they have met, in a table of bounded size.

Null text counts as empty, and empty text has no ids. Texts of any length are encoded whole. Extra
columns pass through; repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skyledger.llm.common import give_back, pieces, share, shared

#: Pre-tokens a worker remembers before it starts a new table; the one before is kept beside it.
MEMORY = 250_000
#: Bytes of text, or ids, that a worker turns at a time.
SLICE = 512 << 10
#: Later than every merge.
NEVER = 1 << 40
#: White space of the Unicode standard, as the tokenizer's pattern means it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def category(major: str, end: int) -> str:
    """A character class of the code points below `end` whose general category begins with `major`."""
    ranges, start = [], None
    for c in range(end + 1):
        inside = c < end and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(ranges)


def pre_token_pattern(end: int = 0x110000) -> str:
    """The byte-level pre-tokenizer's pattern, with its classes written out, for code points
    below `end`."""
    letter, number = category("L", end), category("N", end)
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+|"
        rf" ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


def suffix_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[int], list[int], list[int]]:
    """The suffix automaton of several strings: edges, suffix links, lengths, each string's state.

    A state's strings all end at the same places. A string of the list is the longest of its
    state, since at its own start nothing precedes it.
    """
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def split(p: int, q: int, byte: int) -> int:
        clone = len(length)
        edges.append(dict(edges[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and edges[p].get(byte) == q:
            edges[p][byte] = clone
            p = link[p]
        return clone

    final = []
    for word in words:
        last = 0
        for byte in word:
            q = edges[last].get(byte)
            if q is not None:
                last = q if length[q] == length[last] + 1 else split(last, q, byte)
                continue
            state, p = len(length), last
            edges.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and byte not in edges[p]:
                edges[p][byte] = state
                p = link[p]
            if p >= 0:
                q = edges[p][byte]
                link[state] = q if length[q] == length[p] + 1 else split(p, q, byte)
            last = state
        final.append(last)
    return edges, link, length, final


@dataclass
class Model:
    """A byte-level vocabulary, ready for the dynamic program. Plain arrays, small to ship."""

    tokens: list[bytes]
    special: dict[str, int]
    pattern: str
    rank: dict[int, int]  # of a pair, packed into one number
    parts: tuple[list[int], list[int]]  # left and right token that merging makes a token of
    made_at: list[int]  # rank of that merge, -1 for bytes
    labels: bytes  # edges of state s: labels[first[s]:first[s + 1]] to target
    first: np.ndarray
    target: np.ndarray
    link: np.ndarray  # nearest state down the suffix links that is a token
    token: np.ndarray  # the token a state is, or -1
    shorter: np.ndarray  # suffix link
    longest: np.ndarray  # length of a state's longest string
    memory: int = MEMORY
    _ready: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens on the left (0) or right (1) edge of a token, in the order in which merging makes
        them, each with the rank of the merge that absorbs it."""
        out = [(token, NEVER)]
        while self.made_at[token] >= 0:
            r, token = self.made_at[token], self.parts[side][token]
            out.append((token, r))
        return out[::-1]

    def compatible(self, a: int, b: int, own: int = -1) -> bool:
        """Is the encoding of the two tokens' text just these two?

        Just before each merge, one token touches the border from the left and one from the right.
        The encoding crosses the border if that pair's rank comes before the merge that absorbs
        either; of equal ranks the leftmost merges first. `own` is a merge to leave out.
        """
        i, j, right, left = 0, 0, self.edge(a, 1), self.edge(b, 0)
        while True:
            (x, x_rank), (y, y_rank) = right[i], left[j]
            r = self.rank.get(x << 20 | y)
            if r is not None and r < x_rank and r <= y_rank and r != own:
                return False
            if x_rank <= y_rank:
                i += 1
                if i == len(right):
                    return True
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the last token of every prefix, then back-pointers."""
        _, edges, link, token, lengths, shorter, longest, _, _, pairs, _ = self._ready
        n = len(piece)
        last, state, matched = [0] * (n + 1), 0, 0
        for i, byte in enumerate(piece, 1):
            while (to := edges.get(state << 8 | byte)) is None:
                state = shorter[state]
                matched = longest[state]
            state = to
            matched += 1
            # The state's own token only if the match is as long as it.
            s = state if token[state] >= 0 and lengths[token[state]] == matched else link[state]
            while True:
                t = token[s]
                before = i - lengths[t]
                if not before:
                    break
                pair = last[before] << 20 | t
                ok = pairs.get(pair)
                if ok is None:
                    ok = pairs[pair] = self.compatible(last[before], t)
                if ok:
                    break
                s = link[s]
            last[i] = t
        ids = []
        while n:
            ids.append(last[n])
            n -= lengths[last[n]]
        return ids[::-1]

    def prepare(self) -> Model:
        """Lookup tables of a worker, made once."""
        if self._ready is None:
            special = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
            first, target = self.first.tolist(), self.target.tolist()
            edges = {s << 8 | self.labels[i]: target[i] for s in range(len(self.link)) for i in range(first[s], first[s + 1])}
            self._ready = (
                re.compile(self.pattern), edges, self.link.tolist(), self.token.tolist(),
                [len(t) for t in self.tokens], self.shorter.tolist(), self.longest.tolist(),
                re.compile(f"({special})") if special else None, Known(self), {},
                re.compile(pre_token_pattern(0x100)),
            )
        return self

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers in a row."""
        special, known, narrow = self._ready[7], self._ready[8], self._ready[10]
        try:
            text.encode("latin-1")
            pattern = narrow  # the same classes up to 255: a shorter table, faster to match
        except UnicodeEncodeError:
            pattern = self._ready[0]
        if not (special and special.search(text)):
            return b"".join(map(known.__getitem__, pattern.findall(text)))
        parts = special.split(text)
        for k, part in enumerate(parts):
            if k % 2:
                parts[k] = self.special[part].to_bytes(4, "little")
            else:
                parts[k] = b"".join(map(known.__getitem__, pattern.findall(part)))
        return b"".join(parts)


class Known(dict):
    """Ids of the pre-tokens met last, as 32-bit integers in a row. When it is full it starts anew,
    and what is still in use moves over from the table before."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.older = model, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = array("i", self.model.encode_piece(piece.encode())).tobytes()
            pairs = self.model._ready[9]
            if len(pairs) >= 2 * self.model.memory:
                pairs.clear()
        if len(piece) <= 64:
            if len(self) >= self.model.memory:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


def _read(path: str) -> tuple[dict, dict[str, int], dict[str, int], list[bytes]]:
    """A byte-level BPE file of the tokenizers library: all of it, special tokens, vocabulary,
    and the bytes of each id."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {w: i for w, i in spec["model"]["vocab"].items() if w not in special}
    tokens: list[bytes] = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for word, i in vocab.items():
        tokens[i] = bytes(alphabet[c] for c in word)
    for word, i in special.items():
        tokens[i] = word.encode()
    return spec, special, vocab, tokens


def load(path: str) -> Model:
    """Build the model from a byte-level BPE file of the tokenizers library."""
    spec, special, vocab, tokens = _read(path)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    rank: dict[int, int] = {}
    parts = [0] * len(tokens), [0] * len(tokens)
    made_at = [-1] * len(tokens)
    for r, (a, b) in enumerate(pairs):
        rank[vocab[a] << 20 | vocab[b]] = r
        whole = vocab[a + b]
        if made_at[whole] < 0:
            parts[0][whole], parts[1][whole], made_at[whole] = vocab[a], vocab[b], r
    used = sorted(vocab.values())
    model = Model(tokens, special, pre_token_pattern(), rank, parts, made_at, b"", *[np.zeros(0, np.int32)] * 6)
    # Without the tokens that merging never makes, since it goes another way through their bytes.
    made = [i for i in used if made_at[i] < 0 or model.compatible(parts[0][i], parts[1][i], made_at[i])]
    edges, link, length, final = suffix_automaton([tokens[i] for i in made])
    token = np.full(len(link), -1, np.int32)
    token[final] = made
    nearest = np.zeros(len(link), np.int32)
    for s in np.argsort(length, kind="stable")[1:]:  # a suffix link leads to a shorter state
        p = link[s]
        nearest[s] = p if token[p] >= 0 else nearest[p]
    counts = np.array([len(e) for e in edges])
    model.first = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    model.labels = bytes(b for e in edges for b in e)
    model.target = np.array([t for e in edges for t in e.values()], np.int32)
    model.link, model.token = nearest, token
    model.shorter, model.longest = np.array(link, np.int32), np.array(length, np.int32)
    return model


def _mapped(df: DataFrame, handle: Broadcast, added: list[tuple[str, T.DataType]], keep: Sequence[str] | None,
            widths, work) -> DataFrame:
    """Append columns computed from slices of batches, so that memory doesn't follow their size."""
    kept = list(df.columns) if keep is None else list(keep)
    names = [*kept, *[n for n, _ in added]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.concatenate(([0], np.cumsum(widths(batch))))
            for a, b in pieces(ends, SLICE):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), *work(shared(handle), part)], names)
        give_back()

    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, k) for n, k in added]]))


def _lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(column, 0), np.int64)


def _text_of(tokens: tuple[np.ndarray, np.ndarray], ids: pa.ListArray) -> pa.Array:
    """The texts of lists of ids, from the bytes of all tokens and where each begins."""
    data, first = tokens
    flat = np.asarray(ids.flatten(), np.int64)
    length = first[flat + 1] - first[flat]
    ends = np.concatenate(([0], np.cumsum(length)))
    out = data[np.repeat(first[flat] - ends[:-1], length) + np.arange(ends[-1])]
    cut = ends[np.concatenate(([0], np.cumsum(_lengths(pc.list_value_length(ids)))))]
    found = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(out)])
    try:
        found.validate(full=True)
    except pa.ArrowInvalid:  # bytes that are not valid UTF-8
        whole = out.tobytes()
        found = pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)],
                         pa.large_string())
    return pc.if_else(ids.is_valid(), found, None).cast(pa.string())


def _packed(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in tokens])))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None,
           keep: Sequence[str] | None = None, memory: int = MEMORY) -> DataFrame:
    """Append the ids of a text column as an array of integers.

    `decoded` names a further column for the text that the ids stand for, decoded in the same
    pass. `keep` names the columns that come along, all by default; what isn't needed later
    shouldn't travel back from the workers. `memory` bounds the table of pre-tokens in a worker,
    about half a kilobyte each; a smaller table costs time.
    """

    def work(known: tuple, batch: pa.RecordBatch) -> list[pa.Array]:
        model, tokens = known
        model.prepare()
        out = [model.encode(value) if value else b"" for value in batch.column(text).to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in out])))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(out), "<i4")))
        return [lists, _text_of(tokens, lists)] if tokens else [lists]

    def widths(batch: pa.RecordBatch) -> np.ndarray:
        return _lengths(pc.binary_length(batch.column(text)))

    model = load(path)
    model.memory = memory
    handle = share(df.sparkSession, (model, _packed(model.tokens) if decoded else None))
    added = [(ids, T.ArrayType(T.IntegerType())), *[(decoded, T.StringType())] * bool(decoded)]
    return _mapped(df, handle, added, keep, widths, work)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded",
           keep: Sequence[str] | None = None) -> DataFrame:
    """Append the text of a column of ids; null ids give null. Bytes that are not valid UTF-8
    become replacement characters."""

    def widths(batch: pa.RecordBatch) -> np.ndarray:
        return _lengths(pc.list_value_length(batch.column(ids)))

    def work(tokens: tuple, batch: pa.RecordBatch) -> list[pa.Array]:
        return [_text_of(tokens, batch.column(ids))]

    handle = share(df.sparkSession, _packed(_read(path)[3]))
    return _mapped(df, handle, [(text, T.StringType())], keep, widths, work)
