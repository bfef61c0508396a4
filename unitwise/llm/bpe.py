"""Byte-level BPE encoding and decoding.

Text is cut by the pre-split pattern; each piece is encoded apart. For a piece, an Aho-Corasick
automaton over the vocabulary (bytes as Latin-1 characters) gives every token that starts at each
offset. The encoding is then found by backtracking from the longest match: a token is taken only
if it is compatible with the token before it, and two tokens are compatible exactly when plain
merging of their joined bytes gives those two tokens back. Offsets from which no encoding can be
finished are marked, so each offset is left at most once for each token that ends there and the
search is linear in the length of the piece. The outcome equals rank-ordered merging.

Nulls count as empty texts; an empty text has no ids. Very long pieces cost time in proportion
to their length. Repeated rows are encoded alike, and extra columns are left out or kept by name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import WHITE, ship, spread, steps

#: A space before more white space: only then can a piece of the pre-split pattern reach over a space. (RE2 takes the characters themselves.)
RUN_RE2 = " [" + "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c)) + "]"
#: A space that stands alone before a visible character; no piece reaches over it.
#: Marks that a byte-level pre-split never leaves in one piece with a letter before them.
MARKS = ".,;:!?#$&*()"
LONE = re.compile(f"(?<![{WHITE}]) (?=[^{WHITE}])")


def explicit(pattern: str) -> str:
    r"""The pattern with \s and \S spelled out as Unicode White_Space, as the Rust engines read them."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


class BytePairCodec:
    """Encodes and decodes with one rank file. Memos are bounded and shared by all texts of a worker."""

    def __init__(self, path: str, pattern: str, memo_limit: int = 120_000):
        import ahocorasick

        self.ranks = load_ranks(path)
        self.vocab: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        self.sizes = [0] * len(self.vocab)
        self.halves: list[tuple[int, int] | None] = [None] * len(self.vocab)  # what a token's last merge joined; bytes have none
        self.tokens: dict[str, int] = {}  # what merging can produce; any other token only stands for a whole piece
        self.trie = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.vocab[rank], self.sizes[rank] = token, len(token)
            parts, halves = self._merge(token)
            if len(parts) == 1:
                self.halves[rank] = halves
                self.tokens[latin := token.decode("latin-1")] = rank
                self.trie.add_word(latin, rank)
        self.longest_token = max(self.sizes)
        self.pieces = regex.compile(explicit(pattern)).findall
        self._longest = Made(self._longest_token)
        self._shorter = [self._shorter_token(t.decode("latin-1")) for t in self.vocab]
        self._pairs = Made(lambda key: self.compatible(key >> 32, key & 0xFFFFFFFF), 4 * memo_limit)
        self._piece = Memo(lambda piece: struct.pack(f"<{len(ids := self.encode_piece(piece.encode('utf-8', 'surrogatepass')))}I", *ids), 2 * memo_limit)
        self.chunks = ChunkIds(lambda parts: [b"".join(map(self._piece.__getitem__, self.pieces(p))) for p in parts], 2 * memo_limit)

    def _merge(self, data: bytes) -> tuple[list[bytes], tuple[int, int] | None]:
        """Rank-ordered merging of a short byte string, and the ranks of what it joined last."""
        parts, ranks, last = [data[i : i + 1] for i in range(len(data))], self.ranks, None
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            left, right = parts[best], parts[best + 1]
            if left + right not in ranks:
                break
            last = ranks[left], ranks[right]
            parts[best : best + 2] = [left + right]
        return parts, last

    def merged(self, data: bytes) -> list[int]:
        """Rank-ordered merging, the definition of what encoding a piece has to give."""
        return [self.ranks[p] for p in self._merge(data)[0]]

    def _longest_token(self, prefix: str) -> int:
        """The longest token that a path of the trie begins with."""
        for size in range(len(prefix), 0, -1):
            if (token := self.tokens.get(prefix[:size])) is not None:
                return token
        raise ValueError("the vocabulary lacks a byte")

    def _shorter_token(self, latin: str) -> int:
        """The next shorter token that begins alike, or -1."""
        return next((self.tokens[latin[:n]] for n in range(len(latin) - 1, 0, -1) if latin[:n] in self.tokens), -1)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives these two back.

        A merge over the border can only join what stands on its two sides at some time. Going back in time, the side
        formed last is undone; a pair may then be joined only before that moment (at it, the merge further left comes first)."""
        ranks, vocab, halves, before = self.ranks, self.vocab, self.halves, 1 << 60
        while True:
            if ranks.get(vocab[left] + vocab[right], 1 << 60) < before:
                return False
            of_left, of_right = halves[left], halves[right]
            if of_left and (not of_right or left > right):
                before, left = left, of_left[1]
            elif of_right:
                before, right = right + 1, of_right[0]
            else:
                return True

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        latin, n, sizes, pairs, shorter = data.decode("latin-1"), len(data), self.sizes, self._pairs, self._shorter
        reach, longest, width = self.trie.longest_prefix, self._longest, self.longest_token
        open_at = bytearray(b"\1") * (n + 1)  # cleared where no encoding of the rest was found
        ids: list[int] = []
        at, token = 0, longest[latin[: reach(latin[:width])]] if n else -1
        while at < n:
            if token < 0:
                open_at[at] = 0
                token = ids.pop()
                at -= sizes[token]
                token = shorter[token]
            elif open_at[at + sizes[token]] and (not ids or pairs[ids[-1] << 32 | token]):
                ids.append(token)
                at += sizes[token]
                if at < n:
                    window = latin[at : at + width]
                    token = longest[window[: reach(window)]]
            else:
                token = shorter[token]
        return ids

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text]))[0].tolist()

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; of a null none."""
        return list(self.chunks.ids(texts))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


class Made(dict):
    """Values made when first asked for; emptied where it has grown past a limit."""

    def __init__(self, make, limit: int = 1 << 60):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Memo(Made):
    """A bounded memo in two generations: what was used since the last turn survives it."""

    def __init__(self, make, limit: int):
        super().__init__(make, limit // 2)
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:  # a long key is rarely seen again
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ChunkIds:
    """Ids of texts by their chunks between lone spaces, over which no piece reaches.

    `encode` gives the ids of each of a list of strings as little-endian 32-bit numbers. The chunks of some megabytes of
    text are told apart by Arrow's dictionary encoding, so that Python sees each distinct chunk once, and only those not
    met of late are encoded (a memo in two generations)."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 400_000, tail: str = "", step: int = 6_000_000):
        """tail: characters that never share a piece with a letter before them; words are then known without them."""
        self.encode, self.limit, self.tail, self.step = encode, limit // 2, tail, step
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails = Made(lambda t: encode([t])[0], limit)
        self.to_tail = "^[^" + "".join(map(re.escape, tail)) + "]+"

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of a space and each of some distinct words."""
        if len(self.memo) > self.limit:
            self.memo, self.old = {}, self.memo
        found = list(map(self.memo.get, words))
        missing = [i for i, raw in enumerate(found) if raw is None]
        if missing:
            asked = [words[i] for i in missing]
            kept = self.old.keys() & asked if self.old else ()
            new = list(set(asked).difference(kept))
            made = dict(zip(new, self.encode([" " + w for w in new]), strict=True))
            made.update((w, self.old[w]) for w in kept)
            for i, raw in zip(missing, map(made.__getitem__, asked), strict=True):
                found[i] = raw
            self.memo.update(made)
            for w in [w for w in new if len(w) > 64]:  # a long one is rarely seen again
                del self.memo[w]
        return found

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts, one text after the other, and how many each has."""
        split = pc.split_pattern(texts, " ")
        values, sizes = split.flatten(), np.diff(split.offsets.to_numpy())
        runs = np.flatnonzero(pc.match_substring_regex(texts, RUN_RE2).to_numpy(zero_copy_only=False))
        if len(runs):
            other = [LONE.split(t) for t in texts.take(pa.array(runs)).to_pylist()]
            starts, n = np.cumsum(sizes) - sizes, np.array(list(map(len, other)))
            starts[runs], sizes[runs] = len(values) + np.cumsum(n) - n, n
            values = pa.concat_arrays([values, pa.array(chain.from_iterable(other), values.type)]).take(pa.array(spread(starts, sizes)))
        return values, sizes

    def ids(self, texts: pa.Array, end: int | None = None) -> Iterator[np.ndarray]:
        """uint32 ids of each text, followed by `end`; a null text counts as empty."""
        for part in steps(texts, self.step):
            flat, cuts = self._ids(part, end)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield flat[a:b]
            pa.default_memory_pool().release_unused()

    def _ids(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts together, and the bounds of each.

        The distinct strings are entries; a text is a run of entry numbers: its first chunk, then a word and what follows
        the word for each further chunk, then the end."""
        values, n = self.cut(texts)
        first = np.cumsum(n) - n
        rest = np.ones(len(values), bool)
        rest[first] = False
        words = values.filter(pa.array(rest))
        marked = np.empty(0, np.int64)
        if self.tail:
            bare = pc.utf8_rtrim(words, self.tail)
            cut = pc.and_(pc.less(pc.binary_length(bare), pc.binary_length(words)), pc.utf8_is_alpha(bare))
            marked = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
            tails = pc.replace_substring_regex(words.take(pa.array(marked)), self.to_tail, "").dictionary_encode()
            words = pc.if_else(cut, bare, words)
            del bare, cut
        coded = words.dictionary_encode()
        del words
        entries = self.known(coded.dictionary.to_pylist())
        place = len(entries)
        entries += self.encode(values.take(pa.array(first)).to_pylist())
        every = np.empty(len(values), np.int32)
        every[first], every[rest] = place + np.arange(len(n)), coded.indices.to_numpy()
        width = np.ones(len(values), np.int32)  # entries of each chunk: a second one for what follows the word
        if len(marked):
            width[np.flatnonzero(rest)[marked]] = 2
        if end is not None:
            width[first + n - 1] += 1
        at = np.cumsum(width) - width
        order = np.empty(int(width.sum()), np.int32)
        order[at] = every
        if len(marked):
            order[at[np.flatnonzero(rest)[marked]] + 1] = len(entries) + tails.indices.to_numpy()
            entries += map(self.tails.__getitem__, tails.dictionary.to_pylist())
        if end is not None:
            order[(at + width)[first + n - 1] - 1] = len(entries)
            entries.append(np.array([end], "<u4").tobytes())
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        length = sizes[order]
        flat = np.frombuffer(b"".join(entries), "<u4")[spread((np.cumsum(sizes) - sizes)[order], length)]
        return flat, np.append(np.concatenate(([0], np.cumsum(length)))[at[first]], len(flat))


def encode_lines(encode: Callable[[str], np.ndarray]) -> Callable[[list[str]], list[bytes]]:
    """For tokenizers whose line end is a token of its own and at whose line ends pieces end: many strings in one call.

    Strings with white space other than a leading space and single line ends between visible characters are encoded alone."""
    (line_end,) = encode("\n").tolist()

    def lines_of(string: str) -> int:
        """How many lines a string takes; 0 if it has other white space."""
        words, body = string.split(), string.removeprefix(" ")
        return len(words) if words and "\n".join(words) == body else 0

    def some(strings: list[str]) -> list[bytes]:
        lines = [1 if s[1:].isalpha() else lines_of(s) for s in strings]
        plain = strings if all(lines) else [s for s, n in zip(strings, lines, strict=True) if n]
        out: list[bytes] = []
        if plain:
            ids = encode("\n".join(plain)).astype("<u4")
            ends = np.append(np.flatnonzero(ids == line_end), len(ids))
            last = np.cumsum([n for n in lines if n]) - 1
            if len(ends) == last[-1] + 1:
                raw, stops = ids.tobytes(), (4 * ends[last]).tolist()
                out = [raw[a:b] for a, b in zip([0, *[x + 4 for x in stops[:-1]]], stops, strict=True)]
            else:
                out = [encode(s).astype("<u4").tobytes() for s in plain]
        if plain is strings:
            return out
        rest = iter(out)
        return [next(rest) if n else encode(s).astype("<u4").tobytes() if s else b"" for s, n in zip(strings, lines, strict=True)]

    def run(strings: list[str]) -> list[bytes]:
        return list(chain.from_iterable(some(strings[i : i + 4000]) for i in range(0, len(strings), 4000)))

    return run


_codecs: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec for each vocabulary in a Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = BytePairCodec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row of docs; a null text gives an empty array."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.encode_all(b.column(1)), pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) for each row; null ids give no bytes."""
    ship(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            raw = [c.decode(x or ()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=[id_col, "bytes"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass: id, kept columns, n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is over the decimal ids joined by spaces, decoded_sha256 over the decoded bytes."""
    ship(docs.sparkSession)
    columns = [id_col, *[k for k in keep if k not in (id_col,)]]
    n_kept = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        decimal = [str(i) for i in range(len(c.vocab))].__getitem__
        for b in batches:
            rows = []
            for ids in c.chunks.ids(b.column(n_kept)):
                ids = ids.tolist()
                rows.append((len(ids), hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            n, ids_sha, text_sha = zip(*rows, strict=True) if rows else ((), (), ())
            arrays = [b.column(i) for i in range(n_kept)] + [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = ", ".join(f"`{f}` {docs.schema[f].dataType.simpleString()}" for f in columns)
    return docs.select(*columns, docs[text_col].alias("__text")).mapInArrow(run, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string")
