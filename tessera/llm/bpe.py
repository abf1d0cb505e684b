"""Byte-level BPE: a lazily determinised transducer for encoding, and streaming
decoding with an incremental UTF-8 state machine.

Encoding.  The merges (given as ranks of byte strings) are compiled into a
finite-state transducer over bytes.  The BPE result of a prefix ends in exactly
one token, the longest one that is compatible with the result up to that token's
start; two tokens are compatible when merging their joined bytes gives the two
tokens back.  A transducer state therefore holds, for each position from which a
longer token may still begin (the suffixes of the input that are proper prefixes
of tokens), the tokens not yet written on the way to that position.  What all
these ways share is written at once, so a token leaves after a lookahead bounded
by the longest token.  States and transitions are made when they are first met
and kept in bounded tables.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from tessera.llm.shared import kept, map_rows

#: Splits text before merging (a published pattern; fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks from lines of ``base64 rank``."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if (pair := parts[best] + parts[best + 1]) not in ranks:
            break
        parts[best : best + 2] = [pair]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes byte strings by ``ranks``.  ``max_states`` bounds the tables; they are
    started anew when full, which costs time but never changes a result."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.prefixes = {t[:i] for t in ranks for i in range(len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.own: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.moves: dict[tuple[bytes, int], tuple[bytes, tuple, tuple]] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = [(b"", -1, ((0, ()),))]
        self.number = {self.states[0]: 0}
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}  # by state * 256 + byte

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens leaves both as they are.

        Undoes the merges on either side of the border, the latest first: the tokens
        are compatible if at no time a merge across the border would have come before
        the merge that was undone.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 2 * self.max_states:
                self.pairs.clear()
            known = self.pairs[left, right] = self._hold(left, right)
        return known

    def _hold(self, left: int, right: int) -> bool:
        of, ranks, limit = self.bytes_of, self.ranks, 1 << 60
        while True:
            across = ranks.get(of[left] + of[right])
            if across is not None and across < limit:
                return False
            a, b = self._halves(left), self._halves(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                limit, left = left, a[1]  # the pair to the right is later in order: it must be strictly earlier
            else:
                limit, right = right + 1, b[0]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives a token; none for a single byte."""
        if token not in self.split:
            data, parts = self.bytes_of[token], None
            if len(data) > 1:
                own = {t: r for t, r in self._inner(data) if r < token}
                parts = tuple(merged(data, own))
            self.split[token] = parts if parts and len(parts) == 2 else None
        return self.split[token]

    def _inner(self, data: bytes) -> Iterator[tuple[bytes, int]]:
        for i in range(len(data)):
            for j in range(i + 1, len(data) + 1):
                if (rank := self.ranks.get(data[i:j])) is not None:
                    yield data[i:j], rank

    def _alone(self, token: int) -> bool:
        """Whether merging a token's bytes gives the token."""
        known = self.own.get(token)
        if known is None:
            known = self.own[token] = merged(self.bytes_of[token], self.ranks) == [token]
        return known

    def _move(self, suffix: bytes, byte: int) -> tuple[bytes, tuple, tuple]:
        """After ``suffix`` and one more byte: the longest suffix that is a proper prefix
        of a token; the tokens that end here, the longest first, as (bytes before this
        one, token); and the lengths of all suffixes that are proper prefixes."""
        grown = suffix + bytes((byte,))
        ends = tuple(
            (len(grown) - 1 - i, token)
            for i in range(len(grown))
            if (token := self.ranks.get(grown[i:])) is not None and self._alone(token)
        )
        while grown not in self.prefixes:
            grown = grown[1:]
        lengths = tuple(d for d in range(len(grown), 0, -1) if grown[len(grown) - d :] in self.prefixes)
        return grown, ends, lengths

    def _step(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        suffix, written, ways = self.states[at]
        move = self.moves.get((suffix, byte))
        if move is None:
            if len(self.moves) > self.max_states:
                self.moves.clear()
            move = self.moves[suffix, byte] = self._move(suffix, byte)
        grown, ends, lengths = move
        old = dict(ways)
        for depth, token in ends:
            if depth in old:
                way = old[depth]
                last = way[-1] if way else written
                if last < 0 or self._compatible(last, token):
                    here = (*way, token)
                    break
        else:
            raise ValueError(f"no token covers byte {byte}")
        new = [(d, old[d - 1]) for d in lengths if d - 1 in old]
        new.append((0, here))
        first, n = new[0][1], 0
        while all(len(w) > n and w[n] == first[n] for _, w in new):
            n += 1
            if n == len(first):
                break
        out = first[:n]
        rest = tuple((d, w[n:]) for d, w in new) if n else tuple(new)
        state = (grown, (out[-1] if out else written) if any(not w for _, w in rest) else -2, rest)
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
        move = self.next[at << 8 | byte] = to, out
        return move

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Token ids of one piece, each as soon as it is certain."""
        if len(self.states) > self.max_states:
            self._clear()
        at = 0
        for n, byte in enumerate(data):
            if n & 0xFFF == 0xFFF and len(self.states) > self.max_states:
                here = self.states[at]
                self._clear()
                at = self.number.setdefault(here, len(self.states))
                if at == len(self.states):
                    self.states.append(here)
            at, out = self.next.get(at << 8 | byte) or self._step(at, byte)
            if out:
                yield from out
        yield from self.states[at][2][-1][1]

    def piece(self, data: bytes) -> list[int]:
        """One piece; a piece that is itself in the vocabulary is that token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else list(self.stream(data))


class Encoder(dict):
    """Encodes texts: each match of ``pattern`` separately.  The dictionary keeps the
    packed ids of short pieces.  Two generations of ``max_pieces`` each bound it: a full
    one becomes the old one, and pieces met again come back from there."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, max_pieces: int = 200_000, max_states: int = 200_000):
        super().__init__()
        self.transducer, self.max_pieces, self.old = Transducer(ranks, max_states), max_pieces, {}
        self.findall = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = array("I", self.transducer.piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 40:
            if len(self) >= self.max_pieces:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def packed(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        pieces = self.findall(text)
        found = list(map(self.get, pieces))
        if None in found:
            found = [self[p] if f is None else f for p, f in zip(pieces, found, strict=True)]
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()


class Utf8Machine:
    """Incremental UTF-8: takes bytes in any portions and gives text up to the last
    whole character.  State: how many continuation bytes are due, the range of the
    next one, and the bytes of the character that has begun.  Malformed parts become
    U+FFFD."""

    def __init__(self) -> None:
        self.due, self.low, self.high, self.begun = 0, 0x80, 0xBF, b""

    def _lead(self, b: int) -> int:
        """Continuation bytes due after a lead byte (0: none, -1: not a lead byte)."""
        self.low, self.high = 0x80, 0xBF
        if b < 0x80:
            return 0
        if 0xC2 <= b <= 0xDF:
            return 1
        if 0xE0 <= b <= 0xEF:
            self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            return 2
        if 0xF0 <= b <= 0xF4:
            self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            return 3
        return -1

    def step(self, b: int) -> str:
        """One byte through the machine."""
        if self.due:
            if self.low <= b <= self.high:
                self.low, self.high = 0x80, 0xBF
                self.due -= 1
                self.begun += bytes((b,))
                if self.due:
                    return ""
                out, self.begun = self.begun.decode(), b""
                return out
            self.due, self.begun = 0, b""
            return "�" + self.step(b)
        due = self._lead(b)
        if due > 0:
            self.due, self.begun = due, bytes((b,))
            return ""
        return "�" if due < 0 else chr(b)

    def feed(self, data: bytes) -> str:
        """A portion of bytes.  Whole characters in its middle are decoded together;
        only its ends go through the machine byte by byte."""
        out, at = [], 0
        while at < len(data) and self.due:
            out.append(self.step(data[at]))
            at += 1
        end = len(data)
        while end > at and len(data) - end < 3 and data[end - 1] & 0xC0 == 0x80:
            end -= 1
        if end > at and data[end - 1] >= 0xC0:
            end -= 1
        elif end < len(data):
            end = len(data) if end == at or data[end - 1] < 0x80 else end
        out.append(data[at:end].decode("utf-8", "replace"))
        out.extend(self.step(b) for b in data[end:])
        return "".join(out)

    def end(self) -> str:
        """What remains at the end of the stream: a mark for a character cut off."""
        cut, self.due, self.begun = bool(self.due), 0, b""
        return "�" if cut else ""


class Decoder:
    """Ids back to bytes and, in a stream, to text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token

    def portions(self, packed: bytes, tokens: int = 1 << 16) -> Iterator[bytes]:
        for at in range(0, len(packed), 4 * tokens):
            ids = np.frombuffer(packed[at : at + 4 * tokens], "<u4").tolist()
            yield b"".join(map(self.table.__getitem__, ids))

    def text(self, packed: bytes, tokens: int = 1 << 16) -> Iterator[str]:
        machine = Utf8Machine()
        for portion in self.portions(packed, tokens):
            yield machine.feed(portion)
        yield machine.end()


def codec(path: str, pattern: str = PATTERN, max_pieces: int = 200_000, max_states: int = 200_000) -> tuple[Encoder, Decoder]:
    """The encoder and decoder of a rank file, kept for a Python worker's next tasks of this
    operator."""

    def make():
        gc.set_threshold(200_000, 50, 100)  # the tables hold no cycles; seldom look for any
        with open(path, "rb") as lines:
            ranks = load_ranks(lines)
        return Encoder(ranks, pattern, max_pieces, max_states), Decoder(ranks)

    return kept((path, pattern, max_pieces, max_states), make)


def encode_documents(
    docs: DataFrame,
    vocabulary: str,
    pattern: str = PATTERN,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    max_pieces: int = 300_000,
    max_states: int = 300_000,
) -> DataFrame:
    """Encode each text and decode it again.

    ``vocabulary`` is the path of a rank file that every machine has (it comes with
    an installed library).  Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``
    and, unless ``with_ids`` is false, ``ids`` and ``decoded``.  A null text counts
    as empty: no ids, digests of the empty string.  Null identifiers and repeated
    rows pass through, one row out for each row in; an empty table gives an empty
    table; other columns are not read, so their names can't clash.  A very long text
    is decoded in portions.  ``max_pieces`` and ``max_states`` bound the tables of a worker
    (about 1 KB for each of both); they change its speed, not the result.
    """

    def rows():
        encoder, decoder = codec(vocabulary, pattern, max_pieces, max_states)

        def apply(cols):
            out = {k: [] for k in ("n", "ids_sha256", "decoded_sha256", "ids", "decoded")}
            for text in cols["text"]:
                packed = encoder.packed(text or "")
                digest, parts = hashlib.sha256(), []
                for part in decoder.text(packed):
                    digest.update(part.encode("utf-8"))
                    if with_ids:
                        parts.append(part)
                out["n"].append(len(packed) // 4)
                out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                out["decoded_sha256"].append(digest.hexdigest())
                if with_ids:
                    out["ids"].append(np.frombuffer(packed, "<u4").astype("<i4"))
                    out["decoded"].append("".join(parts))
            out["id"], out["n_tokens"] = cols["id"], out["n"]
            return out

        return apply

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return map_rows(picked, rows, schema).withColumnRenamed("id", id_col)
