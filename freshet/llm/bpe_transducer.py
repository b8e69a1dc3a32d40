"""Operator 1: byte-level BPE encoding and decoding.

The merge ranks are compiled into a finite-state transducer over bytes.  A
nondeterministic state is a hypothesis ``(last token, trie node, pending
tokens)``: the prefix up to some byte is encoded and ends in that token, and the
bytes since then lead to that node of the trie of all tokens.  A token may follow
another only if the merge rule, applied to the two together, leaves just these
two; with this condition every prefix has exactly one encoding.  Sets of hypotheses are
determinised when they are first reached; tokens on which all hypotheses agree
are emitted at once, so a token waits only as long as the bytes read leave a
choice, which the longest token bounds.

Contract
--------
* ``bpe_encode``: null and empty texts give no tokens.  Repeated rows give
  repeated rows, null keys are kept, extra columns are left out.
* ``bpe_decode``: null ids give an empty text.  Bytes that aren't UTF-8 (a
  sequence of ids cut within a character) become U+FFFD, or are kept as bytes if
  ``as_bytes``.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, groups_by_size, lean, only
from .wordcache import ChunkEncoder

#: How the public vocabularies used here pre-split a text (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Rows whose texts are held as Python strings at a time.
SLICE_ROWS = 1000


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class Transducer:
    """Lazily determinised transducer of one vocabulary.

    ``max_states`` bounds the states held; beyond it the later half is forgotten and
    made again as needed.  The first states reached are those of common prefixes.
    ``max_pairs`` bounds the answers kept on pairs of tokens.
    """

    ROOT = 0

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000, max_pairs: int = 400_000):
        self.ranks, self.max_states, self.max_pairs = ranks, max_states, max_pairs
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token_at: dict[int, int] = {}
        for token, rank in ranks.items():
            node = self.ROOT
            for byte in token:
                down = self.child[node]
                if byte not in down:
                    down[byte] = len(self.child)
                    self.child.append({})
                node = down[byte]
            self.token_at[node] = rank
        self.follows: dict[tuple[int, int], bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        start = ((-1, self.ROOT, ()),)
        self.number = {start: 0}
        self.states = [start]
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}  # by 256 * state + byte
        self.final: list[tuple[int, ...]] = [()]

    def forget(self, state: int = 0) -> int:
        """Forget the later half of the states but for ``state``, whose new number is returned."""
        key = self.states[state]
        kept = max(1, self.max_states // 2)
        for state in self.states[kept:]:
            del self.number[state]
        del self.states[kept:], self.final[kept:]
        self.step = {k: move for k, move in self.step.items() if k < 256 * kept and move[0] < kept}
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.final.append(key[-1][2])
        return self.number[key]

    def merged(self, piece: bytes, stop_at: int = 1) -> list[bytes]:
        """The merge rule itself: join the pair of least rank, the leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.ranks.get
        pairs = [rank(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None or len(parts) == stop_at:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1])

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, (-1, -1) if no merge makes it."""
        if token not in self.split:
            whole = self.bytes_of[token]
            if len(whole) == 1:
                self.split[token] = None
            else:
                parts = self.merged(whole, stop_at=2)
                good = len(parts) == 2 and self.merged(whole) == [whole]
                self.split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if good else (-1, -1)
        return self.split[token]

    def may_follow(self, last: int, token: int) -> bool:
        """Whether the merge rule leaves the two apart.

        Their merges are undone from the last; at each point the parts that meet
        at the border must not have a merge of lower rank than the one undone.
        """
        known = self.follows.get((last, token))
        if known is not None:
            return known
        good = self.halves(token) != (-1, -1)
        left, right, limit = last, token, 1 << 62
        bytes_of, rank = self.bytes_of, self.ranks.get
        while good and last >= 0:
            joined = rank(bytes_of[left] + bytes_of[right])
            if joined is not None and joined < limit:
                good = False
                break
            if left > right:
                parts = self.halves(left)
                if parts is None:
                    break
                left, limit = parts[1], left
            else:
                parts = self.halves(right)
                if parts is None:
                    break
                right, limit = parts[0], right + 1
        if len(self.follows) >= self.max_pairs:
            self.follows.clear()
        self.follows[last, token] = good
        return good

    def advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the deterministic step from a state by a byte."""
        alive, complete = [], None
        child, token_at = self.child, self.token_at
        for last, node, pending in self.states[state]:
            down = child[node].get(byte)
            if down is None:
                continue
            if complete is None:
                token = token_at.get(down)
                if token is not None and self.may_follow(last, token):
                    complete = (token, self.ROOT, (*pending, token))
            if child[down]:
                alive.append((last, down, pending))
        if complete is None:
            raise ValueError("the vocabulary lacks a byte or its merges are not consistent")
        alive.append(complete)
        agreed, first = 0, alive[0][2]
        while agreed < len(first) and all(len(p) > agreed and p[agreed] == first[agreed] for _, _, p in alive):
            agreed += 1
        emitted = first[:agreed]
        key = tuple((last, node, pending[agreed:]) for last, node, pending in alive) if agreed else tuple(alive)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.final.append(key[-1][2])
        move = (self.number[key], emitted)
        self.step[256 * state + byte] = move
        return move

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state = 0
        for at in range(0, len(piece), 65536):
            if len(self.states) > self.max_states:
                state = self.forget(state)
            step = self.step
            for byte in piece[at : at + 65536]:
                move = step.get(256 * state + byte)
                state, emitted = move if move is not None else self.advance(state, byte)
                if emitted:
                    out += emitted
        out += self.final[state]
        return out


#: First bytes of UTF-8 characters and the ranges of the bytes that must follow (fixed values).
UTF8 = [
    (0x00, 0x7F, ()),
    (0xC2, 0xDF, ((0x80, 0xBF),)),
    (0xE0, 0xE0, ((0xA0, 0xBF), (0x80, 0xBF))),
    (0xE1, 0xEC, ((0x80, 0xBF), (0x80, 0xBF))),
    (0xED, 0xED, ((0x80, 0x9F), (0x80, 0xBF))),
    (0xEE, 0xEF, ((0x80, 0xBF), (0x80, 0xBF))),
    (0xF0, 0xF0, ((0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF))),
    (0xF1, 0xF3, ((0x80, 0xBF), (0x80, 0xBF), (0x80, 0xBF))),
    (0xF4, 0xF4, ((0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF))),
]


def utf8_machine() -> list[list[int]]:
    """Next state by state and byte; state 0 lies between characters, -1 is an error.

    A state stands for the ranges of the bytes still to come.
    """
    number: dict[tuple, int] = {(): 0}
    for _, _, rest in UTF8:
        for i in range(len(rest)):
            number.setdefault(rest[i:], len(number))
    steps = [[-1] * 256 for _ in number]
    for low, high, rest in UTF8:
        steps[0][low : high + 1] = [number[rest]] * (high + 1 - low)
    for rest, state in number.items():
        if rest:
            (low, high), *more = rest
            steps[state][low : high + 1] = [number[tuple(more)]] * (high + 1 - low)
    return steps


class Utf8Stream:
    """Incremental UTF-8 state machine: text of whole characters as bytes arrive.

    Between calls it holds the bytes of a character that has begun without ending, at most
    three.  Only the last three bytes of what arrives can begin one, so the machine starts there.
    """

    STEPS = utf8_machine()

    def __init__(self, errors: str = "replace"):
        self.held, self.errors = b"", errors

    @classmethod
    def unfinished(cls, data: bytes) -> int:
        """How many bytes at the end begin a character without ending it."""
        if not data or data[-1] < 0x80:
            return 0
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                state = 0
                for byte in data[-back:]:
                    state = cls.STEPS[state][byte] if state >= 0 else -1
                return back if state > 0 else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", self.errors)

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", self.errors)


_MADE: dict[str, tuple[Transducer, ChunkEncoder]] = {}


def worker_encoder(path: str) -> ChunkEncoder:
    """One transducer and chunk cache for each Python worker."""
    if path not in _MADE:
        import regex

        machine = Transducer(read_ranks(path))
        pieces = regex.compile(PATTERN).findall

        def encode_many(strings: list[str]) -> list[bytes]:
            piece = machine.encode_piece
            return [array("I", [i for p in pieces(s) for i in piece(p.encode())]).tobytes() for s in strings]

        gc.freeze()  # the tables stay; states are tuples without cycles
        gc.set_threshold(200_000, 20, 100)
        _MADE[path] = machine, ChunkEncoder(encode_many)
    return _MADE[path][1]


def encoded_batches(batches: Iterator[pa.RecordBatch], ranks_path: str) -> Iterator[pa.RecordBatch]:
    """``(key, ids)`` of batches ``(key, text)``."""
    encoder = worker_encoder(ranks_path)
    for batch in batches:
        at, rows = 0, len(batch)
        while at < rows:
            # a slice at a time: the texts of a whole batch needn't be held twice
            for part in groups_by_size([t or "" for t in batch.column(1).slice(at, SLICE_ROWS).to_pylist()], 500_000):
                ids = encoder.batch(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(ids, pa.binary())], ["key", "ids"])
                at += len(part)
        pa.default_memory_pool().release_unused()


def bpe_encode(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token ids of every text: ``(<id>, ids binary)``, ids as little-endian unsigned 32-bit integers.

    No shuffle; memory is bounded by an Arrow batch, the chunk cache and the states.
    """
    narrow = only(docs, key=id_column, text=text_column)
    schema = f"key {narrow.schema['key'].dataType.simpleString()}, ids binary"
    return narrow.mapInArrow(lean(lambda batches: encoded_batches(batches, ranks_path)), schema).withColumnRenamed("key", id_column)


def decoder(ranks_path: str, as_bytes: bool = False, block: int = 65536) -> Callable[[bytes | None], str]:
    """A function from packed ids to their text; with ``as_bytes`` bad bytes become surrogates."""
    table = {i: b for b, i in read_ranks(ranks_path).items()}
    of = [table[i] for i in range(len(table))] if sorted(table) == list(range(len(table))) else table
    errors = "surrogateescape" if as_bytes else "replace"

    def text(packed: bytes | None) -> str:
        ids = array("I", packed or b"")
        stream = Utf8Stream(errors)
        parts = [stream.feed(b"".join(map(of.__getitem__, ids[i : i + block]))) for i in range(0, len(ids), block)]
        return "".join([*parts, stream.close()])

    return text


def decoded_array(texts: Iterable[str], as_bytes: bool) -> pa.Array:
    if as_bytes:
        return pa.array([t.encode("utf-8", "surrogateescape") for t in texts], pa.binary())
    return pa.array(list(texts), pa.string())


def bpe_decode(encoded: DataFrame, ranks_path: str, id_column: str = "doc_id", ids_column: str = "ids", as_bytes: bool = False, block: int = 65536) -> DataFrame:
    """Texts of token ids: ``(<id>, text)``, or ``(<id>, data binary)`` if ``as_bytes``."""
    narrow = only(encoded, key=id_column, ids=ids_column)
    out = "data binary" if as_bytes else "text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = decoder(ranks_path, as_bytes, block)
        for batch in batches:
            data = decoded_array(map(text, batch.column(1).to_pylist()), as_bytes)
            yield pa.RecordBatch.from_arrays([batch.column(0), data], ["key", out.split()[0]])

    return narrow.mapInArrow(lean(run), f"key {narrow.schema['key'].dataType.simpleString()}, {out}").withColumnRenamed("key", id_column)


def bpe_round_trip(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(<id>, ids binary, data binary)``: ``bpe_encode``, and ``bpe_decode`` as bytes of its ids.

    Both run in one Python worker, so the ids don't travel to a second one.
    """
    narrow = only(docs, key=id_column, text=text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = decoder(ranks_path, as_bytes=True)
        for batch in encoded_batches(batches, ranks_path):
            data = decoded_array(map(text, batch.column(1).to_pylist()), as_bytes=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, data], ["key", "ids", "data"])

    schema = f"key {narrow.schema['key'].dataType.simpleString()}, ids binary, data binary"
    return narrow.mapInArrow(lean(run), schema).withColumnRenamed("key", id_column)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of ids and of decoded bytes of every document."""
    import public_tokenizers

    out = bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
