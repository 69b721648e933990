"""Operator 3, packing by power-of-two decomposition.

A document's tokens, an end token among them, are cut into as many full sequences as they fill and then into one piece
for each binary digit of the rest, longest first. Every piece is a sequence of its own whose length is a power of two, so
no sequence crosses documents and nothing is padded. Equal lengths form a bucket: a trainer draws each batch from one
bucket, and ``write_buckets`` lays the sequences out so.

Tokens come from a public tokenizer file. Its pre-tokenizer never puts a blank after other characters of one token, so a
text whose white space stands alone is cut before each blank or line end, and the pieces, which repeat a lot, are
tokenized once and kept in a table bounded in pieces, in characters of a piece and in ids; texts with longer pieces, such
as those of scripts without blanks, and texts with other white space go to the tokenizer whole, and give the same ids.

Defined results: a null or empty text is one end token; repeated rows are packed each for itself; an empty table gives
an empty table; columns other than doc_id and text do not matter. Sequence ids are unique within a result.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What keeps a text from being cut: blanks and line ends in a row, rarer white space, or what may start a special token.
IN_A_ROW = ("  ", "\n\n", " \n", "\n ")
ODD = re.compile(r"[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]|<\|")
#: Bounds of the table of pieces. When it is full, further pieces are kept for one chunk of texts only, and after some
#: multiple of its size of those it is begun anew.
KNOWN_MOST = 150_000
PIECE_CHARS = 64
IDS_MOST = 2_000_000
CHUNK_CHARS = 1_000_000


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class PieceTokenizer:
    """Texts to ids by a byte-level BPE file of ``tokenizers``, with a bounded table of the short pieces seen.

    New pieces are joined and encoded in one go by the same vocabulary; as every token stands for its bytes, the running
    byte lengths say which ids belong to which piece.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        byte = byte_of_character()
        ranks = {bytes(byte[c] for c in token): i for token, i in self.whole.get_vocab().items() if token not in special}
        self.pieces = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes[list(ranks.values())] = [len(x) for x in ranks]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int32)  # piece k has ids[starts[k] : starts[k + 1]]
        self.n_known = 0
        self.passing = 0

    def _learn(self, pieces: list[str]) -> None:
        # A first piece of a text has no blank before it; "\r" stands for that. It is encoded after a line end, whose id
        # is taken off. A piece with odd characters gets no ids; texts that hold it go to the tokenizer whole.
        for lone in ("", "\n"):  # white space alone would run into its neighbours
            if lone in pieces and len(pieces) > 1:
                self._learn([lone])
                pieces = [p for p in pieces if p != lone]
        for piece in [p for p in pieces if ODD.search(p, p[:1] == "\r")]:
            self.known[piece] = -2
        firsts, rest = [p for p in pieces if p[:1] == "\r" and p not in self.known], [p for p in pieces if p[:1] != "\r" and p not in self.known]
        pieces = firsts + rest
        if not pieces:
            return
        joined = [("\n" + p[1:]).encode() for p in firsts] + [(p if p[:1] == "\n" else " " + p).encode() for p in rest]
        ids = np.array(self.pieces.encode_ordinary(b"".join(joined).decode()), np.int64)
        last = np.searchsorted(self.bytes[ids].cumsum(), np.cumsum(list(map(len, joined)), dtype=np.int64)) + 1
        first = np.concatenate([np.zeros(1, np.int64), last[:-1]])[: len(last)]
        first[: len(firsts)] += 1  # their line end
        n = last - first
        ids = ids[np.repeat(first - (n.cumsum() - n), n) + np.arange(n.sum())]
        k = self.n_known
        at = int(self.starts[k])
        if at + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, max(2 * len(self.ids), at + len(ids)))
        if k + len(pieces) + 1 > len(self.starts):
            self.starts = np.resize(self.starts, max(2 * len(self.starts), k + len(pieces) + 1))
        self.ids[at : at + len(ids)] = ids
        self.starts[k + 1 : k + 1 + len(pieces)] = at + n.cumsum()
        self.known.update(zip(pieces, range(k, k + len(pieces)), strict=True))
        self.n_known += len(pieces)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size > CHUNK_CHARS:
                yield from self._some(some)
                some, size = [], 0
        yield from self._some(some)

    def _some(self, texts: list[str]) -> Iterator[np.ndarray]:
        out = self._cut([None if any(x in t for x in IN_A_ROW) else t for t in texts])
        rest = iter(self.whole.encode_batch([t for t, ids in zip(texts, out, strict=True) if ids is None], add_special_tokens=False))
        for ids in out:
            yield np.array(next(rest).ids, np.uint32) if ids is None else ids

    def _cut(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The ids of each text; None for None, and for texts with odd pieces."""
        pieces: list[str] = []
        upto = [0]
        for text in texts:
            if text:
                own = text.replace("\n", " \n").split(" ")
                if own[0]:
                    own[0] = "\r" + own[0]
                else:
                    del own[0]  # the text begins with a blank or a line end
                pieces += own
            upto.append(len(pieces))
        found = np.fromiter(map(self.known.get, pieces, itertools.repeat(-1)), np.int32, len(pieces))
        full = False
        if (found == -1).any():
            new = [p for p in dict.fromkeys([pieces[i] for i in np.flatnonzero(found == -1)]) if len(p) <= PIECE_CHARS]
            full = len(self.known) + len(new) > KNOWN_MOST or self.starts[self.n_known] > IDS_MOST
            if full and self.passing > 4 * KNOWN_MOST:
                self._forget()
                new, full = [p for p in dict.fromkeys(pieces) if len(p) <= PIECE_CHARS], False
            kept = self.n_known
            self._learn(new)
            if full:
                self.passing += len(new)
            found = np.fromiter(map(self.known.get, pieces, itertools.repeat(-2)), np.int32, len(pieces))  # longer ones are not kept
        start, n = self.starts[found], self.starts[found + 1] - self.starts[found]
        if full:
            for p in new:
                self.known.pop(p, None)
            self.n_known = kept
        odd = found == -2
        n[odd] = 0
        total = np.zeros(len(n) + 1, np.int32)
        n.cumsum(out=total[1:])
        shift = np.repeat(start - total[:-1], n)
        shift += np.arange(total[-1], dtype=np.int32)
        ids = self.ids[shift]
        odds = np.concatenate([[0], odd.cumsum()])[upto]
        ends = total[upto]
        return [None if t is None or o > p else ids[a:b] for t, p, o, a, b in zip(texts, odds[:-1], odds[1:], ends[:-1], ends[1:], strict=True)]


def decompose(n: int, longest: int = 2048) -> list[int]:
    """Piece lengths of ``n`` tokens: full sequences, then the binary digits of the rest, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def _packed(path: str, longest: int, end_id: int, with_tokens: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["tokens"] * with_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, tails = PieceTokenizer(path), {}
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            at: list[int] = []
            starts: list[np.ndarray] = []
            lengths: list[np.ndarray] = []
            crc: list[int] = []
            totals: list[int] = []
            tokens: list[np.ndarray] = []
            for row, ids in enumerate(tokenizer(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                rest = len(ids) % longest
                if rest not in tails:
                    tails[rest] = decompose(rest, longest)
                sizes = np.array([longest] * (len(ids) // longest) + tails[rest])
                ends = sizes.cumsum()
                view = memoryview(ids).cast("B")
                crc += [zlib.crc32(view[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                at.append(row)
                totals.append(len(sizes))
                starts.append(ends - sizes)
                lengths.append(sizes)
                if with_tokens:
                    tokens += np.split(ids.astype(np.int32), ends[:-1])
            if not at:
                continue
            rows = np.repeat(np.array(at), np.array(totals))
            docs = batch.column("doc_id").take(pa.array(rows))
            n = np.array([int(x.sum()) for x in lengths], np.int64)
            out = [docs, pa.array(np.concatenate(starts).astype(np.int64)), pa.array(np.concatenate(lengths).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(np.repeat(n, np.array(totals)))]
            yield pa.RecordBatch.from_arrays(out + [pa.array(tokens, pa.list_(pa.int32()))] * with_tokens, names=names)

    return run


def pack(docs: DataFrame, path: str, longest: int = 2048, end_id: int = 1, with_tokens: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with ``with_tokens``, tokens."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", tokens array<int>" * with_tokens
    pieces = kept.mapInArrow(_packed(path, longest, end_id, with_tokens), schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(docs: DataFrame, path: str, to: str, longest: int = 2048, end_id: int = 1) -> None:
    """The packed sequences as Parquet, one folder for each length."""
    pack(docs, path, longest, end_id).write.partitionBy("length").parquet(to)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_tokens=False)
