"""Encoding and decoding with a merge-type SentencePiece vocabulary, by a score-ordered agenda.

A text is escaped (spaces become U+2581, one is put in front) and split into
characters.  An agenda holds every pair of adjacent symbols whose concatenation
is a piece, best score first and leftmost among equals; the pair on top is
merged, and the pairs it makes with its neighbours enter.  Characters outside
the vocabulary end as their UTF-8 bytes.

No piece of the vocabulary has U+2581 after another character, holds a line
feed, or joins one of certain marks to a letter (all read off the vocabulary),
so no merge crosses those places: a text is encoded chunk by chunk, and each
worker keeps a bounded memo of chunks.  In every Arrow batch the chunks that entered
the memo are encoded again by the sentencepiece library; a difference raises.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEPT, tidy, unpacked

SPACE = "▁"
MEMO = 600_000
MODEL = "piece_bpe_32k.model"
#: Characters of a chunk whose agenda is a list; longer ones have a heap. Of a pair that is no piece, after all ranks.
SHORT, NEVER = 24, 1 << 60


class Agenda:
    """Encoder and decoder of one model file; ``check`` compares with the library."""

    def __init__(self, model_file: str, memo: int = MEMO):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.library.vocab_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.bytes = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if self.library.is_byte(i)}
        self.decimal = [str(i) for i in range(n)]
        self.of_byte = {b: i for i, b in self.bytes.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not (i in self.bytes or self.library.is_control(i) or self.library.is_unknown(i))}
        scores = sorted({self.library.get_score(i) for i in self.ids.values()}, reverse=True)
        ranks = {score: r for r, score in enumerate(scores)}
        self.rank = {p: ranks[self.library.get_score(i)] for p, i in self.ids.items()}
        pairs = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        if any(b == SPACE != a for a, b in pairs) or any("\n" in p for p in self.ids) or len(self.of_byte) != 256:
            raise ValueError("not a merge vocabulary with byte fallback whose pieces keep to one chunk")
        # marks that share no piece with any other character than marks and U+2581
        marks = set(string.punctuation)
        while mixed := {c for a, b in pairs for c, d in ((a, b), (b, a)) if c in marks and d not in marks and d != SPACE}:
            marks -= mixed
        m = re.escape("".join(sorted(marks)))
        self.chunks = re.compile(f"\n|{SPACE}*[^{SPACE}\n{m}]+|{SPACE}*[{m}]+|{SPACE}+" if marks else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.size, self.fresh = memo // 2, []

    def merge(self, chunk: str) -> list[int]:
        """Ids of one chunk."""
        rank, sym, n = self.rank.get, list(chunk), len(chunk)
        if n <= SHORT:  # the agenda as a list by position: its first least entry is on top, and no entry is ever out of date
            agenda = [rank(pair, NEVER) for pair in map(add, sym, sym[1:])]
            while agenda and (top := min(agenda)) != NEVER:
                i = agenda.index(top)
                both = sym[i] = sym[i] + sym.pop(i + 1)
                del agenda[i]
                if i < len(agenda):
                    agenda[i] = rank(both + sym[i + 1], NEVER)
                if i:
                    agenda[i - 1] = rank(sym[i - 1] + both, NEVER)
        else:
            bits = n.bit_length()
            low = (1 << bits) - 1
            after, before = list(range(1, n + 2)), list(range(-1, n))
            # an entry is (rank, position, length) in one integer: integers compare faster than tuples
            agenda = [((r << bits | i) << bits) | 2 for i, r in enumerate(map(rank, map(add, sym, sym[1:]))) if r is not None]
            heapify(agenda)
            while agenda:
                top = heappop(agenda)
                i, length = top >> bits & low, top & low
                left, j = sym[i], after[i]
                if not left or j >= n:
                    continue
                both = left + sym[j]
                if len(both) != length:
                    continue  # one of the two has merged with another meanwhile
                sym[i], sym[j] = both, ""
                k = after[i] = after[j]
                before[k] = i
                if k < n:
                    right = sym[k]
                    r = rank(both + right)
                    if r is not None:
                        heappush(agenda, ((r << bits | i) << bits) | (length + len(right)))
                h = before[i]
                if h >= 0:
                    left = sym[h]
                    r = rank(left + both)
                    if r is not None:
                        heappush(agenda, ((r << bits | h) << bits) | (len(left) + length))
        ids = self.ids
        try:
            return [ids[s] for s in sym if s]
        except KeyError:  # a character outside the vocabulary
            return [i for s in sym if s for i in ([ids[s]] if s in ids else [self.of_byte[b] for b in s.encode("utf-8", "surrogatepass")])]

    def text_of(self, ids: list[int]) -> str:
        """The text of ids, U+2581 as spaces; bytes that are no UTF-8 become U+FFFD."""
        out, raw = [], bytearray()
        for i in chain(ids, [-1]):
            b = self.bytes.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i >= 0:
                out.append(self.pieces[i])
        return "".join(out).replace(SPACE, " ")

    def known(self, chunk: str) -> str:
        got = self.older.get(chunk)
        if got is None:
            ids = self.merge(chunk)
            decimal = self.decimal
            got = ",".join([decimal[i] for i in ids])
            # ids of pieces alone decode to the chunk, of which they are the parts
            if not self.bytes.keys().isdisjoint(ids) and (text := self.text_of(ids)) != chunk.replace(SPACE, " "):
                self.odd[chunk] = text
            self.fresh.append((chunk, ids))
        if len(chunk) <= 64:
            self.memo[chunk] = got
        return got

    def parts(self, text: str) -> tuple[list[str], list[str]]:
        """The chunks of a text, and the ids of each in decimal."""
        if not text:
            return [], []
        get, known = self.memo.get, self.known
        chunks = self.chunks(SPACE + text.replace(" ", SPACE))
        return chunks, [get(c) or known(c) for c in chunks]

    def decoded(self, chunks: list[str]) -> str:
        """What the ids of the chunks decode to: each chunk was compared with it when merged, and ``odd`` has those that differ."""
        if self.odd:
            return "".join([self.odd.get(c) or c.replace(SPACE, " ") for c in chunks]).removeprefix(" ")
        return "".join(chunks).replace(SPACE, " ").removeprefix(" ")

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids in self.parts(text)[1] for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode: the space that encoding put in front goes."""
        return self.text_of(ids).removeprefix(" ")

    def check(self) -> None:
        """Compares the chunks merged since the last call with the library's ids, and what they decode to with the library's decoding of these ids; raises on a difference."""
        if self.fresh:
            want = self.library.encode("".join("\n" + c.replace(SPACE, " ") for c, _ in self.fresh))
            mine = [*self.merge(SPACE), *chain.from_iterable((self.of_byte[10], *ids) for _, ids in self.fresh)]
            if want != mine:
                raise ValueError("the agenda and the sentencepiece library differ")
            if self.library.decode(want) != "".join("\n" + (self.odd.get(c) or c.replace(SPACE, " ")) for c, _ in self.fresh):
                raise ValueError("chunks and what the sentencepiece library decodes differ")
            self.fresh = []
        if len(self.memo) > self.size:  # two generations: what has been used lately stays
            self.memo, self.older = {}, self.memo


@lru_cache(maxsize=2)
def _agenda(model_file: str) -> Agenda:
    return Agenda(model_file)


KEPT["sentencepiece"] = _agenda.cache_clear  # its memo stays for the next tasks, until another operator needs the worker


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: Column: type, and how an agenda makes it of a text's chunks and their ids in decimal, comma-joined.
OUTPUTS = {
    "ids": ("array<int>", lambda agenda, chunks, ids: np.array(ids.split(",") if ids else [], np.int32)),
    "n_tokens": ("bigint", lambda agenda, chunks, ids: ids.count(",") + 1 if ids else 0),
    "ids_sha256": ("string", lambda agenda, chunks, ids: _sha256(ids)),
    "decoded": ("string", lambda agenda, chunks, ids: agenda.decoded(chunks)),
    "decoded_sha256": ("string", lambda agenda, chunks, ids: _sha256(agenda.decoded(chunks))),
}

#: Texts whose results leave a worker at once, and their code points at most (but for one text).
OUT_ROWS, OUT_CHARS = 256, 1 << 21


def encode_decode(docs: DataFrame, model_file: str, outputs: tuple[str, ...] = ("ids", "n_tokens", "decoded"), text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of ``docs`` with the chosen ``outputs`` of its whole texts.

    Null and empty texts have no ids; long ones are encoded whole, chunk by
    chunk.  Rows are independent: repeated rows, ties and empty tables need no
    rule.  Columns of the same names are
    replaced.  ``model_file`` must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = _agenda(model_file)
        for batch in batches:
            texts, first, cols, chars = batch.column(1), 0, [[] for _ in outputs], 0
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                chunks, parts = agenda.parts(text)
                ids = ",".join(parts)
                for col, name in zip(cols, outputs, strict=True):
                    col.append(OUTPUTS[name][1](agenda, chunks, ids))
                chars += len(text)
                if i - first + 1 == OUT_ROWS or chars > OUT_CHARS or i == len(texts) - 1:
                    agenda.check()
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i - first + 1), *[pa.array(c, type=t) for c, t in zip(cols, types, strict=True)]], names=["row", *outputs])
                    first, cols, chars = i + 1, [[] for _ in outputs], 0

    arrow = {"array<int>": pa.list_(pa.int32()), "bigint": pa.int64(), "string": pa.string()}
    types = [arrow[OUTPUTS[name][0]] for name in outputs]
    names = [c for c in docs.columns if keep is None or c in keep]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *[T.StructField(name, T._parse_datatype_string(OUTPUTS[name][0])) for name in outputs]])
    return unpacked(rows.mapInArrow(tidy(run, "sentencepiece"), schema), **{name: name for name in outputs})


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents")
    out = encode_decode(docs, public_tokenizers.path(MODEL), ("n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id",))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
