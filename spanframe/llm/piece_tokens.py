"""Token ids of whole texts through the sentencepiece library, with a memory of units already encoded; and the bytes behind token ids.

A text is cut before a run of blanks and before a line feed, where no piece of the vocabulary reaches across, so merges never do either and ids equal those
of the whole text. A vocabulary with pieces that reach across, or a text with the blank's own mark in it, is encoded whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from spanframe.llm import arrays as A
from spanframe.llm.tokens import MOST_WORDS, Encoder

# The mark that stands for a blank in pieces.
BLANK_MARK = "▁"
#: How a unit begins: at the start of a text, after a blank, with a line feed.
START, BLANK, LINE = 0, 1, 2
_WAY = np.array([0x3C6EF372FE94F82B, 0, 0xA54FF53A5F1D36F1], np.uint64)


class PieceEncoder(Encoder):
    """``encode(texts)`` gives one flat array of ids and the offsets of the texts in it."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        across = any(BLANK_MARK in p.lstrip(BLANK_MARK) for p in pieces)
        line = self._library(["\n", "\nn", "a", "a b"])
        self.blank = self.model.piece_to_id(BLANK_MARK)
        #: Whether texts can be cut at blanks, and at line feeds.
        self.cuts = not across and line[3][: len(line[2])] == line[2] and self._library([""]) == [[]]
        self.lines = self.cuts and not any("\n" in p for p in pieces) and len(line[0]) == 2 and line[0][0] == line[1][0] == self.blank
        self._start()

    def _library(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def _new_units(self, raw: bytes, keys: np.ndarray, starts: np.ndarray, stops: np.ndarray, ways: np.ndarray) -> None:
        for i in range(0, len(keys), 4000):
            spans = list(zip(starts[i : i + 4000].tolist(), stops[i : i + 4000].tolist(), ways[i : i + 4000].tolist()))
            ids = self._library([raw[a:b].decode() for a, b, _ in spans])
            ids = [[self.blank] if a == b else own[1:] if way == LINE else own for own, (a, b, way) in zip(ids, spans)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self._keep(keys[i : i + 4000], np.fromiter((x for one in ids for x in one), np.uint32, int(lengths.sum())), lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, ends = A.raw(texts)
        n, raw = len(ends) - 1, data.tobytes()
        whole = np.full(n, not self.cuts)
        at = raw.find(mark := BLANK_MARK.encode())
        while at >= 0:
            whole[np.searchsorted(ends, at, "right") - 1] = True
            at = raw.find(mark, at + 1)
        if self.size > MOST_WORDS:
            self._forget()
        first = np.zeros(len(data), bool)
        if len(data):
            blank = data == 0x20
            first[1:] = blank[1:] & ~blank[:-1]
            if self.lines:
                first |= data == 0x0A
            first[ends[:-1][ends[:-1] < ends[1:]]] = True
        starts = np.flatnonzero(first)
        docs = np.searchsorted(ends, starts, "right") - 1
        stops = np.append(starts[1:], len(data)) if len(starts) else starts
        keep = ~whole[docs]
        starts, stops, docs = starts[keep], stops[keep], docs[keep]
        ways = np.where(starts == ends[docs], START, np.where(data[starts] == 0x20, BLANK, LINE)) if len(starts) else np.zeros(0, np.int64)
        starts = starts + (ways == BLANK)
        sums = A.prefix_hash(data)
        keys = np.maximum(A.span_hash(sums, starts, stops) ^ _WAY[ways], np.uint64(1))
        found, known = self.table.find(keys), self.size
        if len(new := np.flatnonzero(found < 0)):
            some = new[np.unique(keys[new], return_index=True)[1]]
            self._new_units(raw, keys[some], starts[some], stops[some], ways[some])
            found[new] = self.table.find(keys[new])
        self.again[found[found < known]] = True
        flat, stops_ = self._gather(found)
        edges = np.concatenate([[0], stops_])[np.searchsorted(docs, np.arange(n + 1))]
        if whole.any():
            rows, lengths = np.split(flat, edges[1:-1]), np.diff(edges)
            own = np.flatnonzero(whole)
            for i, ids in zip(own, self._library([raw[ends[i] : ends[i + 1]].decode() for i in own])):
                rows[i], lengths[i] = np.asarray(ids, np.uint32), len(ids)
            flat, edges = np.concatenate(rows), np.concatenate([[0], np.cumsum(lengths)])
        return flat, edges


class TokenBytes:
    """The bytes behind the ids of a vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def __len__(self) -> int:
        return len(self.sizes)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.sizes[ids]
        ends = np.cumsum(n)
        return self.data[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def byte_level_bytes(tokenizer) -> TokenBytes:
    """Bytes of a byte-level vocabulary: printable characters stand for their own byte, the others follow from 256 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    char = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    entries = (tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size()))
    return TokenBytes([bytes(char[c] for c in e) if all(c in char for c in e) else e.encode() for e in entries])


def piece_bytes(model) -> TokenBytes:
    """Bytes of pieces: the blank's mark is a blank, byte pieces are their byte."""
    pieces = ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
    return TokenBytes([bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace(BLANK_MARK, " ").encode() for i, p in pieces])


@lru_cache(4)
def piece_encoder(path: str) -> tuple[PieceEncoder, TokenBytes]:
    """One for each worker process and file."""
    made = PieceEncoder(path)
    return made, piece_bytes(made.model)


@lru_cache(4)
def plain_byte_encoder(path: str) -> tuple[Encoder, TokenBytes]:
    """A byte-level encoder to which the strings of special tokens are plain text; one for each worker process and file."""
    made = Encoder(path)
    made.tokenizer.encode_special_tokens, made.marks = True, []
    return made, byte_level_bytes(made.tokenizer)
