"""p6: encoding of a corpus with a public byte-level BPE vocabulary.

The merges are compiled, state by state and only where the data lead, into a deterministic
finite-state transducer. The compilation uses a property of BPE: a token sequence is the
encoding of its bytes exactly if each token alone encodes to itself and each two neighbours
encode to themselves. Reading a piece byte by byte, exactly one token can therefore end at
each position, and which one depends only on the *open starts*: positions from which the bytes
read so far are a prefix of some token, each with its node in the token trie and the token that
ends there. That list is the state; (state, byte) gives the next state and the token ending
here, and both are kept in a transition table. Where only one start is open, everything before
it is decided and leaves the transducer, so the lookahead is bounded by the longest token.

Finished pieces are memoised. Both tables are dropped when full, so memory is bounded.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import spread
from millrace.sources.tables import table

#: Folder of the public vocabularies; a parameter, never copied into the repository.
VOCABULARIES = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
#: Split of a text into pieces, published with the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the piece memo and of the transition table before they are dropped.
MEMO = 400_000
TRANSITIONS = 1_000_000
#: Longest piece (bytes) that is memoised.
LONG = 48


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Lazily determinised BPE transducer over bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.split = regex.compile(pattern)
        # token trie: node -> {byte: node}; node -> id of a token that encodes to itself, or -1
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, i in ranks.items():
            node = 0
            for c in word:
                child = self.next[node].get(c)
                if child is None:
                    child = self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = child
            self.token[node] = i
        self.alone: dict[int, bool] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}
        self._reset()

    def _reset(self) -> None:
        #: state -> its open starts: (trie node, token that ends at the start or -1, distance back)
        self.states: list[tuple[tuple[int, int, int], ...]] = [((0, -1, 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.table: dict[int, tuple[int, int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """BPE of a short byte string straight from the ranks (used to compile, and on odd input)."""
        parts = [bytes((c,)) for c in data]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, before: int, t: int) -> bool:
        """Whether token t stands as itself, alone (before = -1) or after the token ``before``."""
        ok = self.alone.get(t)
        if ok is None:
            ok = self.alone[t] = self.merge(self.bytes_of[t]) == [t]
        if not ok or before < 0:
            return ok
        pair = self.follows.get((before, t))
        if pair is None:
            if len(self.follows) > TRANSITIONS:
                self.follows.clear()
            pair = self.follows[before, t] = self.merge(self.bytes_of[before] + self.bytes_of[t]) == [before, t]
        return pair

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """Compiles one transition: (next state, token ending here)."""
        opened, ending = [], -1
        for node, before, back in self.states[state]:
            child = self.next[node].get(byte)
            if child is None:
                continue
            opened.append((child, before, back + 1))
            t = self.token[child]
            if ending < 0 and t >= 0 and self._fits(before, t):
                ending = t
        opened.append((0, ending, 0))
        key = tuple(opened)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        self.table[state << 8 | byte] = (to, ending)
        return to, ending

    def piece(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        if len(self.table) > TRANSITIONS:
            self._reset()
        table, step = self.table, self._step
        out: list[int] = []
        ends: list[int] = []  # tokens ending at each position since the last decided one
        state = 0
        for byte in data:
            to = table.get(state << 8 | byte)
            state, t = to if to is not None else step(state, byte)
            ends.append(t)
            if len(ends) > 512 and len(self.states[state]) == 1:  # one open start: all before is decided
                out += self._back(ends)
                state, ends = self._after(ends[-1]), []
        return out + self._back(ends)

    def _after(self, token: int) -> int:
        """The state at a decided position that ``token`` ends at."""
        key = ((0, token, 0),)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        return to

    def _back(self, ends: list[int]) -> list[int]:
        out, i = [], len(ends)
        while i > 0:
            t = ends[i - 1]
            out.append(t)
            i -= len(self.bytes_of[t])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text; null and empty texts have none."""
        if not text:
            return []
        memo, out = self.memo, []
        for p in self.split.findall(text):
            ids = memo.get(p)
            if ids is None:
                data = p.encode("utf-8", "replace")
                ids = self.piece(data)
                if len(data) <= LONG:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[p] = ids
            out += ids
        return out


class Utf8Stream:
    """Incremental UTF-8 state machine: bytes of tokens in, finished characters out.

    ``feed`` keeps the bytes of an unfinished character until the next call; a malformed byte
    gives U+FFFD and the machine starts again at that byte. ``end`` flushes.
    """

    def __init__(self) -> None:
        self.need = self.code = self.low = 0
        self.high = 0x10FFFF

    def feed(self, data: bytes) -> str:
        out = []
        for c in data:
            if self.need:
                code = self.code << 6 | c & 0x3F
                if c & 0xC0 == 0x80 and self._possible(code):
                    self.code, self.need = code, self.need - 1
                    if not self.need:
                        out.append(chr(code))
                    continue
                self.need = 0
                out.append("�")
            if c < 0x80:
                out.append(chr(c))
            elif 0xC2 <= c < 0xF5:
                self.need = 1 + (c >= 0xE0) + (c >= 0xF0)
                self.code = c & (0x3F >> self.need)
                self.low = (0, 0x80, 0x800, 0x10000)[self.need]
            else:
                out.append("�")
        return "".join(out)

    def _possible(self, code: int) -> bool:
        """Whether a code with the bits so far can become a legal character."""
        rest = 6 * (self.need - 1)
        least, most = code << rest, (code + 1 << rest) - 1
        return most >= self.low and least <= 0x10FFFF and not (least >= 0xD800 and most <= 0xDFFF)

    def end(self) -> str:
        left, self.need = self.need, 0
        return "�" if left else ""


def decode(ids: list[int], bytes_of: dict[int, bytes]) -> str:
    """Text of a token sequence, decoded as a stream."""
    stream = Utf8Stream()
    return "".join(stream.feed(bytes_of[i]) for i in ids) + stream.end()


_LOADED: dict[str, Transducer] = {}


def transducer(path: str, ranks: Callable[[], dict[bytes, int]] | None = None) -> Transducer:
    """The transducer of a vocabulary; one in each Python worker. ``ranks`` gives the tokens where the file is elsewhere."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(ranks() if ranks else ranks_of(path))
    return _LOADED[path]


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids): token ids of every row's text, without special tokens.

    Null and empty texts have the empty list; strings of special tokens in a text are ordinary
    text; texts of any length are read whole; repeated rows and null keys come out as they are;
    an empty table gives no row. Other columns are not read. No shuffle. The vocabulary (a file of
    fixed size) is read here and broadcast, so executors need no copy of it.
    """
    path = f"{folder or VOCABULARIES}/{vocabulary}.tiktoken"
    shared = df.sparkSession.sparkContext.broadcast(ranks_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path, lambda: shared.value)
        for b in batches:
            flat: list[int] = []
            offsets = [0]
            for x in b.column(1).to_pylist():
                flat += t.encode(x)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"), "doc_id", "text")


def p6_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each source and language."""
    docs = table(spark, d, "documents")
    return (
        encode_column(docs, "doc_id", "text")
        .join(docs.select("doc_id", "source", "lang"), "doc_id")
        .groupBy(F.lower("source").alias("source"), "lang")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("ids").cast("long")).alias("n_tokens"))
    )


QUERIES = {"p6_ids": p6_ids, "p6_lengths": p6_lengths}
ORACLES: dict[str, str] = {}
