"""SentencePiece encoding by unigram Viterbi over a double-array trie of pieces, and decoding.

The pieces, their kinds and their order come from a public .model file; nothing is trained. Such a file's numbers are merge
ranks where it was made by BPE, so the log scores used here follow Zipf's law in the rank: -log(rank + 1), less the log of
their sum. A character that no piece covers is one node of a score below all others, and leaves as its bytes' pieces.

No piece has a blank marker after another character, so the best path over a text is made of the best paths over its words,
each with the blanks before it. Words are solved side by side, each distinct word of a stretch once. A long word, as in scripts
that have no blanks, is first cut wherever none of the pieces that occur in it crosses, which no path can notice.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from talkmill.llm.common import binary, steps, raw, with_columns

MARK = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of more bytes are cut; what is still longer than LONGEST is solved by itself.
LONG, LONGEST = 48, 1024
#: Words that a task remembers.
REMEMBERED = 150_000

_words = re.compile(rb" *[^ ]+| +$")


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def puts_blank_first(path: str) -> bool:
    """Whether the model file's normaliser puts a blank before a text. Raises if it would change texts in other ways, as pieces are
    to decode to the text again: by a table of characters, by taking blanks away, or by leaving blanks unmarked."""
    for number, value in fields(Path(path).read_bytes()):
        if number == 3:
            settings = dict(fields(value))
            if settings.get(2) or settings.get(4, 1) or not settings.get(5, 1):
                raise ValueError("the model's normaliser changes texts")
            return bool(settings.get(3, 1))
    raise ValueError("the model file has no normaliser settings")


def read_model(path: str) -> list[tuple[bytes, float, int]]:
    """(piece, stored number, kind) of each piece of a model file."""
    out = []
    for number, value in fields(Path(path).read_bytes()):
        if number == 1:
            one = dict(fields(value))
            out.append((one.get(1, b""), struct.unpack("<f", one[2])[0] if 2 in one else 0.0, one.get(3, NORMAL)))
    return out


class DoubleArray:
    """A trie of byte strings in two arrays: the child of state s by byte b is base[s] + b + 1 if check there is s."""

    def __init__(self, keys: list[bytes]):
        root: dict = {}
        for i, key in enumerate(keys):
            node = root
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = i
        base, check, value, used = [0], [-1], [-1], bytearray(1)
        used[0] = 1
        single, dense, todo = 1, 1, [(0, root)]  # where free places are looked for, for one child and for more
        while todo:
            state, node = todo.pop()
            value[state] = node.get(-1, -1)
            children = sorted(b + 1 for b in node if b >= 0)
            if not children:
                continue
            at = max(single if len(children) == 1 else dense, children[0])
            tries = 0
            while True:
                short = at - children[0] + 258 - len(used)
                if short > 0:
                    used += bytes(short)
                    base += [0] * short
                    check += [-1] * short
                    value += [-1] * short
                if not any(used[at - children[0] + c] for c in children):
                    break
                at += 1
                tries += 1
            if len(children) == 1:
                single = at
            elif tries > 32:
                dense += tries // 2
            base[state] = at - children[0]
            for c in children:
                used[base[state] + c] = 1
                check[base[state] + c] = state
                todo.append((base[state] + c, node[c - 1]))
        self.base, self.check, self.value = (np.array(x + [d] * 258, np.int32) for x, d in ((base, 0), (check, -1), (value, -1)))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each state, -1 if there is none. Every state is at least 0."""
        to = self.base[state] + byte + 1
        return np.where(self.check[to] == state, to, -1)


@dataclass
class Pieces:
    """The trie, the pieces' scores, and what each decodes to."""

    trie: DoubleArray
    ids: np.ndarray
    scores: np.ndarray
    unknown: float
    byte_ids: np.ndarray
    text: np.ndarray
    text_at: np.ndarray
    is_byte: np.ndarray
    blank_first: bool = True

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Pieces:
        model = read_model(path)
        used = [i for i, (_, _, kind) in enumerate(model) if kind in (NORMAL, USER)]
        if any(re.search(rb"[^ ] ", model[i][0].replace(MARK, b" ")) for i in used):
            raise ValueError("a piece has a blank after another character")
        rank = {i: r for r, i in enumerate(sorted(used, key=lambda i: (-model[i][1], i)))}
        scores = -np.log(np.array([rank[i] + 1.0 for i in used]))
        scores -= np.log(np.exp(scores).sum())
        byte_ids = np.full(256, -1, np.int32)
        for i, (piece, _, kind) in enumerate(model):
            if kind == BYTE:
                byte_ids[int(piece[3:5], 16)] = i
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        plain = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (UNKNOWN, CONTROL) else p.replace(MARK, b" ") for p, _, kind in model]
        at = np.concatenate(([0], np.cumsum([len(p) for p in plain])))
        return cls(DoubleArray([model[i][0].replace(MARK, b" ") for i in used]), np.array(used, np.int32), scores, float(scores.min() - 10), byte_ids, np.frombuffer(b"".join(plain), np.uint8), at, np.array([k == BYTE for _, _, k in model]), puts_blank_first(path))

    def matches(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every piece that occurs in text (bytes as int32), starts in order. All starts step together."""
        at, state, t = np.flatnonzero((text & 0xC0) != 0x80), None, 0
        state = np.zeros(len(at), np.int32)
        found = []
        while len(at):
            state = self.trie.step(state, text[at + t])
            at, state = at[state >= 0], state[state >= 0]
            t += 1
            known = self.trie.value[state]
            has = known >= 0
            found.append((at[has], at[has] + t, known[has]))
            inside = at + t < len(text)
            at, state = at[inside], state[inside]
        start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(start, kind="stable")
        return start[order], end[order], piece[order]

    def cut(self, words: list[bytes]) -> list[list[bytes]]:
        """Each word in parts that no piece within it crosses: the best path over the word is that over its parts."""
        joined = b"\xff".join(words)  # a byte that is in no piece
        text = np.frombuffer(joined, np.uint8).astype(np.int32)
        start, end, _ = self.matches(text)
        crossed = np.bincount(start + 1, minlength=len(text) + 2) - np.bincount(end, minlength=len(text) + 2)
        free = (np.cumsum(crossed)[: len(text)] == 0) & ((text & 0xC0) != 0x80)
        out, at = [], 0
        cuts = np.flatnonzero(free)
        for w in words:
            mine = cuts[np.searchsorted(cuts, at + 1) : np.searchsorted(cuts, at + len(w))].tolist()
            out.append([joined[i:j] for i, j in zip([at, *mine], [*mine, at + len(w)], strict=True)])
            at += len(w) + 1
        return out

    def best(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the piece ids of the words' best paths, how many each word has). Of equal paths the one found first stays."""
        order = np.argsort([len(w) for w in words], kind="stable")[::-1]
        at, found = 0, []
        while at < len(order):
            longest = len(words[order[at]])
            take = 1 if longest > LONGEST else max(1, 200_000 // max(1, longest))
            found.append(self._solve_one(words[order[at]]) if longest > LONGEST else self._solve([words[i] for i in order[at : at + take]]))
            at += take
        ids, size = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        begin = (np.cumsum(size) - size)[np.argsort(order)]
        size = size[np.argsort(order)]
        return ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())], size

    def _solve_one(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long word, whose pieces are found for all places at once."""
        text = np.frombuffer(word, np.uint8).astype(np.int32)
        start, end, piece = self.matches(text)
        value = self.scores[piece].tolist()
        begins = np.flatnonzero((text & 0xC0) != 0x80)
        first = np.searchsorted(start, np.append(begins, len(word))).tolist()
        begins, end, piece = begins.tolist(), end.tolist(), piece.tolist()
        score, back, used = [-float("inf")] * (len(word) + 1), [0] * (len(word) + 1), [-1] * (len(word) + 1)
        score[0] = 0.0
        for k, s in enumerate(begins):
            e = begins[k + 1] if k + 1 < len(begins) else len(word)
            now = score[s]
            if now + self.unknown > score[e]:
                score[e], back[e], used[e] = now + self.unknown, s, -1
            for i in range(first[k], first[k + 1]):
                if now + value[i] > score[end[i]]:
                    score[end[i]], back[end[i]], used[end[i]] = now + value[i], s, piece[i]
        ids, at = [], len(word)
        while at:
            if used[at] >= 0:
                ids.append(int(self.ids[used[at]]))
            else:
                ids += [int(self.byte_ids[b]) for b in word[back[at] : at][::-1]]
            at = back[at]
        return np.array(ids[::-1], np.int32), np.array([len(ids)])

    def _solve(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(words), max(map(len, words))
        size = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width).astype(np.int32)
        score, back = np.full((n, width + 1), -np.inf), np.zeros((n, width + 1), np.int32)
        piece = np.full((n, width + 1), -1, np.int32)
        score[:, 0] = 0
        lead = np.where(text < 0xC0, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        for s in range(width):
            rows = np.flatnonzero((size > s) & (score[:, s] > -np.inf))
            if not len(rows):
                continue
            end = np.minimum(s + lead[rows, s], size[rows])  # the character as unknown
            value = score[rows, s] + self.unknown
            better = value > score[rows, end]
            r, e = rows[better], end[better]
            score[r, e], back[r, e], piece[r, e] = value[better], s, -1
            state = np.zeros(len(rows), np.int32)
            for t in range(s, width):
                alive = size[rows] > t
                state = np.where(alive, self.trie.step(state, text[rows, t]), -1)
                alive = state >= 0
                rows, state = rows[alive], state[alive]
                if not len(rows):
                    break
                known = self.trie.value[state]
                has = known >= 0
                r, p = rows[has], known[has]
                value = score[r, s] + self.scores[p]
                better = value > score[r, t + 1]
                r = r[better]
                score[r, t + 1], back[r, t + 1], piece[r, t + 1] = value[better], s, p[better]
        # All paths, walked back together: a step gives one piece of each word, or the bytes of one character.
        rows, end, order, ids, step = np.arange(n), size.copy(), [], [], 0
        while len(rows := rows[end[rows] > 0]):
            e = end[rows]
            s, p = back[rows, e], piece[rows, e]
            some = p >= 0
            order.append((rows[some], np.full(some.sum(), step)))
            ids.append(self.ids[p[some]])
            for i in range(4):  # a character's last byte comes first here
                r = rows[~some & (e - s > i)]
                order.append((r, np.full(len(r), step + i)))
                ids.append(self.byte_ids[text[r, end[r] - 1 - i]])
            end[rows], step = s, step + 4
        row, place = (np.concatenate(x) for x in zip(*order, strict=True)) if order else (np.zeros(0, np.int64),) * 2
        return np.concatenate(ids)[np.lexsort((-place, row))] if ids else np.zeros(0, np.int32), np.bincount(row, minlength=n)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of each text and where they begin; at: where each text's ids begin. The blank put first goes."""
        size = self.text_at[ids + 1] - self.text_at[ids]
        begin = np.cumsum(size) - size
        data = self.text[np.repeat(self.text_at[ids] - begin, size) + np.arange(size.sum())]
        edge = np.append(begin, len(data))[at]
        first = edge[:-1][edge[:-1] < edge[1:]]
        drop = np.zeros(len(data), bool)
        drop[first] = (data[first] == 32) & self.blank_first
        lost = np.concatenate(([0], np.cumsum(drop)))
        return data[~drop], edge - lost[edge]


_loaded: dict[str, Pieces] = {}


def encoder(pieces: Pieces):
    """A function from a list of texts' bytes to (ids of all, where each text's begin); it remembers words."""
    number: dict[bytes, int] = {}
    pool, ends = np.zeros(0, np.int32), np.zeros(1, np.int64)  # word i has pool[ends[i] : ends[i + 1]]

    def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        nonlocal pool, ends
        if len(number) > REMEMBERED:
            number.clear()
            pool, ends = pool[:0], ends[:1]
        blank = b" " if pieces.blank_first else b""
        split = [_words.findall(blank + x.replace(MARK, b" ")) if x else [] for x in texts]
        long = list({w for words in split for w in words if len(w) > LONG})
        if long:
            parts = dict(zip(long, pieces.cut(long), strict=True))
            split = [list(chain.from_iterable(parts.get(w) or (w,) for w in words)) for words in split]
        flat = list(chain.from_iterable(split))
        new = list(set(flat).difference(number))
        if new:
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            ids, size = pieces.best(new)
            pool, ends = np.concatenate([pool, ids]), np.concatenate([ends, ends[-1] + np.cumsum(size)])
        which = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        size = ends[which + 1] - ends[which]
        end = np.cumsum(size)
        ids = pool[np.repeat(ends[which] - (end - size), size) + np.arange(size.sum())]
        words_at = np.concatenate(([0], np.cumsum([len(w) for w in split]))).astype(np.int64)
        return ids, np.concatenate(([0], end))[words_at]

    return encode


def with_pieces(docs: DataFrame, text: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """docs and, from each whole text: token_ids, n_pieces, n_bytes (byte pieces), decoded, round_trip.

    The file is read on the driver and sent to the executors. Empty texts have no ids; null texts have null token_ids and
    decoded, no pieces, and a true round_trip. round_trip is whether decoding gives the text again; it fails only for a
    text that holds the blank marker itself, which decodes to a blank.
    """
    held = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def make():
        pieces = load_bytes(held.value)
        encode = encoder(pieces)

        def run(column):
            texts = binary(column)
            data, offsets = raw(texts)
            parts = []
            for i, j in steps(offsets):
                some = [x or b"" for x in texts.slice(i, j - i).to_pylist()]
                ids, at = encode(some)
                plain, plain_at = pieces.decode(ids, at)
                blob = plain.tobytes()
                decoded = [blob[a:b] for a, b in zip(plain_at[:-1].tolist(), plain_at[1:].tolist(), strict=True)]
                fallback = np.concatenate(([0], np.cumsum(pieces.is_byte[ids])))[at]
                parts.append((ids, np.diff(at), np.diff(fallback), decoded, [a == b for a, b in zip(some, decoded, strict=True)]))
            null = np.array(texts.is_null())
            size = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            at = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)), mask=pa.array(null))
            decoded = pa.array([None if m else x for m, x in zip(null, (x for p in parts for x in p[3]), strict=True)], pa.binary()).cast(pa.string())
            return [lists, pa.array(size.astype(np.int64)), pa.array(np.concatenate([p[2] for p in parts]).astype(np.int64) if parts else size), decoded, pa.array([x for p in parts for x in p[4]], pa.bool_())]

        return run

    columns = [("token_ids", pa.list_(pa.int32()), T.ArrayType(T.IntegerType())), ("n_pieces", pa.int64(), T.LongType()), ("n_bytes", pa.int64(), T.LongType()), ("decoded", pa.string(), T.StringType()), ("round_trip", pa.bool_(), T.BooleanType())]
    return with_columns(docs, text, columns, make)


def load_bytes(data: bytes) -> Pieces:
    """Pieces.load for a file's content, once a process."""
    import hashlib
    import tempfile

    key = hashlib.sha256(data).hexdigest()
    if key not in _loaded:
        with tempfile.NamedTemporaryFile(suffix=".model") as file:
            file.write(data)
            file.flush()
            _loaded[key] = Pieces.load(file.name)
    return _loaded[key]
