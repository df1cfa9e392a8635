"""Vector bin packing of token sequences for training.

A sequence has three limits at once: tokens, segments (pieces of documents) and loss-bearing tokens.
Each task packs the documents of its partition as they stream by. Full sequences are cut from long
documents first. What is left is placed by the dot-product heuristic: into the open sequence goes
the piece, among those that fit in every dimension, whose demand has the largest product with the
room left; when nothing whole fits, the largest piece is cut to fill the sequence. Sequences that
cannot be filled are cut at a power of two, so that none needs padding.

Token ids come from a public tokenizer. Its splitting never joins a word to the white space after
it, so a text is cut before every single space between two words and between a letter and a mark, and
each different stretch is encoded once per worker.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meshlight.llm import words as W
from meshlight.llm.batches import text_of, without

MAX_TOKENS = 2048
MAX_SEGMENTS = 64
END_ID = 1
PIECE = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

# Bytes of text that are tokenized and pooled at a time, and ids sent on in one batch.
POOL_BYTES = 8 << 20
SENT_IDS = 1 << 20
JOINED = 20_000  # stretches encoded as one text
# Stretches that a worker remembers; beyond that it starts afresh, which changes no result.
REMEMBERED = 3_000_000


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(rb'!"#$%&()*+,-./:;<=>?@[\]^_`{|}~')] = True


class Encoder:
    """Token ids of runs of documents, remembering the ids of every stretch it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # The vocabulary writes one character for each byte of a token.
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.used = 0

    def _encoded(self, stretches: list[bytes], joinable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches, one after another, and how many each has; joinable ones come first.

        Those that begin at a cut and do not end in white space are encoded as one text, which splits
        at the same places; the tokens' lengths in bytes tell where the ids of each end.
        """
        ids, lengths = [], []
        together = [x for x, j in zip(stretches, joinable) if j]
        for k in range(0, len(together), JOINED):
            group = together[k : k + JOINED]
            found = np.array(self.tokenizer.encode_batch_fast([b"".join(group).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.token_bytes[found]), np.cumsum([len(x) for x in group])) + 1
            ids.append(found)
            lengths.append(np.diff(ends, prepend=0))
        alone = [x.decode() for x, j in zip(stretches, joinable) if not j]
        if alone:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
            ids.append(np.array([i for x in found for i in x], np.uint32))
            lengths.append(np.array([len(x) for x in found], np.int64))
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, hashes: np.ndarray, stretches: list[bytes], joinable: np.ndarray) -> None:
        ids, lengths = self._encoded(stretches, joinable)
        back = np.argsort(np.argsort(~joinable, kind="stable"), kind="stable")
        total = len(ids)
        if self.used + total > len(self.pool):
            self.pool = np.resize(self.pool, max(2 * len(self.pool), self.used + total))
        self.pool[self.used : self.used + total] = ids
        at = (self.used + np.cumsum(lengths) - lengths)[back]
        lengths = lengths[back]
        self.used += total
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.at = np.insert(self.at, place, at)
        self.lengths = np.insert(self.lengths, place, lengths)

    def ids(self, run: W.Run) -> list[np.ndarray]:
        """The ids of each document of the run."""
        starts, ends, joinable = _stretches(run)
        if not len(starts):
            return [np.zeros(0, np.uint32)] * run.n
        hashes, first, inverse = np.unique(run.hashes(starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != hashes[inside]
        if new.any():
            text = run.data.tobytes()
            f = first[new]
            # A stretch met both ways was hashed once; it is joined only if its first place allows it.
            self._learn(hashes[new], [text[a:b] for a, b in zip(starts[f].tolist(), ends[f].tolist())], joinable[f])
            place = np.searchsorted(self.known, hashes)
        entry = place[inverse]
        lengths = self.lengths[entry]
        closes = np.cumsum(lengths)
        ids = self.pool[np.repeat(self.at[entry] - (closes - lengths), lengths) + np.arange(closes[-1])]
        per_document = np.bincount(run.documents(starts), weights=lengths, minlength=run.n).astype(np.int64)
        return np.split(ids, np.cumsum(per_document)[:-1])


def _stretches(run: W.Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut before each single space between two characters that are surely not white space, and
    between an ASCII letter and an ASCII mark other than the apostrophe.

    Also tells which stretches begin at such a space and do not end in white space.

    White space outside ASCII begins with one of four bytes; next to those nothing is cut.
    """
    data = run.data
    n = len(data)
    cut = np.zeros(n, bool)
    lead = (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
    doubtful = np.zeros(n, bool)
    if n > 2:
        before, after = data[:-2], data[2:]
        doubtful[1:] |= data[:-1] == 0xC2
        doubtful[2:] |= lead[:-2]
        doubtful &= data >= 0x80
        cut[1:-1] = (
            (data[1:-1] == 0x20) & (before > 0x20) & ~doubtful[:-2]
            & (after > 0x20) & (after != 0xC2) & ~lead[2:]
        )
    begins = run.bounds[:-1][run.bounds[1:] > run.bounds[:-1]]
    # A space that opens a document is no cut of the document before.
    last = run.bounds[1:-1] - 1
    cut[last[last >= 0]] = False
    certain = cut.copy()
    if n > 1:  # a mark after a letter starts anew, but may join a mark before it
        cut[1:] |= _ASCII_LETTER[data[:-1]] & _MARK[data[1:]]
    cut[begins] = True
    certain[begins] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    joinable = certain[starts]
    if n:
        joinable &= (data[ends - 1] > 0x20) & ~doubtful[ends - 1]
    return starts, ends, joinable


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Pool:
    """Open documents of a task and the sequences made from them."""

    def __init__(self, tokens: int, segments: int, loss: int, first_sequence: int):
        self.limits = (tokens, segments, loss)
        self.next = first_sequence
        self.ids: list[np.ndarray] = []
        self.prompt: list[int] = []  # leading ids that bear no loss
        self.start: list[int] = []  # ids already placed
        self.pieces: list[tuple[int, int, int, int, int]] = []  # document, start, length, sequence, offset

    def add(self, ids: np.ndarray, prompt: int) -> None:
        self.ids.append(ids)
        self.prompt.append(prompt)
        self.start.append(0)

    def _loss(self, i: int, length: int) -> int:
        begin = self.start[i]
        return begin + length - max(begin, min(self.prompt[i], begin + length))

    def _fitting(self, i: int, tokens: int, loss: int) -> int:
        """How many of the document's next ids fit."""
        free = max(0, self.prompt[i] - self.start[i])
        return min(len(self.ids[i]) - self.start[i], tokens, free + loss)

    def _close(self, chosen: list[tuple[int, int]]) -> None:
        """Place the chosen (document, ids) as one sequence, shortened to a power of two unless full."""
        total = sum(n for _, n in chosen)
        if total < self.limits[0]:
            total = 1 << (total.bit_length() - 1)
        offset = 0
        for i, n in chosen:
            n = min(n, total - offset)
            if n <= 0:
                break
            self.pieces.append((i, self.start[i], n, self.next, offset))
            self.start[i] += n
            offset += n
        self.next += 1

    def pack(self, final: bool) -> None:
        tokens, segments, loss = self.limits
        for i in range(len(self.ids)):
            while len(self.ids[i]) - self.start[i] >= tokens and self._fitting(i, tokens, loss) == tokens:
                self._close([(i, tokens)])
        while True:
            left = np.array([len(x) for x in self.ids], np.int64) - np.array(self.start, np.int64)
            open_ = np.flatnonzero(left)
            if not len(open_) or (not final and left.sum() < 4 * tokens):
                return
            self._fill(open_, left[open_], final)

    def _fill(self, open_: np.ndarray, left: np.ndarray, final: bool) -> None:
        """Fill sequences from the open documents until too little is left for another."""
        tokens, segments, loss = self.limits
        bears = np.array([self._loss(i, n) for i, n in zip(open_.tolist(), left.tolist())], np.int64)
        free = np.ones(len(open_), bool)
        weight = np.array([left.mean() / tokens, 1 / segments, bears.mean() / max(1, loss)])
        by_tokens, by_loss = weight[0] * left / tokens, weight[2] * bears / max(1, loss)
        rest = int(left.sum())
        while rest >= tokens or (final and rest):
            room, room_loss, chosen = tokens, loss, []
            while room and len(chosen) < segments:
                fits = free & (left <= room) & (bears <= room_loss)
                score = np.where(fits, by_tokens * (room / tokens) + by_loss * (room_loss / max(1, loss)), -1.0)
                best = int(np.argmax(score))
                if not fits[best]:
                    # Nothing whole fits: cut the largest document that is left.
                    best = int(np.argmax(np.where(free, left, -1)))
                    part = self._fitting(int(open_[best]), room, room_loss) if free[best] else 0
                    if part:
                        chosen.append((best, part))
                        free[best] = False
                    break
                chosen.append((best, int(left[best])))
                free[best] = False
                room -= int(left[best])
                room_loss -= int(bears[best])
            if not chosen:
                raise ValueError("a limit leaves no room for a single token")
            self._close([(int(open_[k]), n) for k, n in chosen])
            for k, _ in chosen:  # what was cut off stays open
                i = int(open_[k])
                now = len(self.ids[i]) - self.start[i]
                rest -= int(left[k]) - now
                left[k], bears[k], free[k] = now, self._loss(i, now), now > 0
                by_tokens[k], by_loss[k] = weight[0] * now / tokens, weight[2] * bears[k] / max(1, loss)

    def drop_placed(self) -> np.ndarray:
        """Forget the documents that are placed; returns the positions of those kept."""
        kept = [i for i in range(len(self.ids)) if self.start[i] < len(self.ids[i])]
        self.ids = [self.ids[i] for i in kept]
        self.prompt = [self.prompt[i] for i in kept]
        self.start = [self.start[i] for i in kept]
        self.pieces = []
        return np.array(kept, np.int64)


def packed(
    df: DataFrame,
    tokenizer: str,
    text: str = "text",
    prompt: str | None = None,
    keep: list[str] | None = None,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss_tokens: int | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: the kept columns, ``start``, ``length``, ``ids`` (little-endian 32-bit),
    ``doc_tokens``, ``sequence_id`` and ``offset``.

    A document's ids are those of ``prompt`` (no loss), then those of ``text`` and ``end_id`` (loss).
    Null texts are empty and have the end id alone; repeated rows are packed each for itself; an input
    column with the name of a computed one is replaced. ``df`` should be a table: sequence ids carry
    the number of the partition, which a table reads alike when a task is run again.
    """
    added = StructType.fromDDL(PIECE)
    carried = without(df.select(*[f"`{c}`" for c in keep]) if keep is not None else df, added.fieldNames())
    kept = df.select(*[f"`{c}`" for c in carried])
    schema = StructType([*kept.schema.fields, *added.fields])
    rows = df.select(
        *[F.col(f"`{c}`") for c in carried],
        (text_of(prompt) if prompt else F.lit("")).alias("__llm_prompt"),
        text_of(text).alias("__llm_text"),
    )
    loss = max_tokens if max_loss_tokens is None else max_loss_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        pool = _Pool(max_tokens, max_segments, loss, TaskContext.get().partitionId() << 32)
        known = kept_schema = None

        def sent() -> Iterator[pa.RecordBatch]:
            """The pieces made so far, in batches of about SENT_IDS ids."""
            nonlocal known
            size, group = 0, []
            for piece in pool.pieces:
                group.append(piece)
                size += piece[2]
                if size >= SENT_IDS:
                    yield made(group)
                    size, group = 0, []
            if group:
                yield made(group)
            known = known.take(pa.array(pool.drop_placed()))

        def made(group: list) -> pa.RecordBatch:
            of, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*group))
            rows = known.take(pa.array(of)).combine_chunks()
            ids = [pool.ids[i][s : s + n].astype("<u4").tobytes() for i, s, n in zip(of, start, length)]
            totals = np.array([len(pool.ids[i]) for i in of], np.int64)
            columns = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in rows.columns]
            columns += [pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array(totals)]
            columns += [pa.array(sequence), pa.array(offset)]
            return pa.RecordBatch.from_arrays(columns, [*kept_schema.names, *added.fieldNames()])

        for batch in batches:
            names = batch.schema.names[:-2]
            prompts, texts = batch.column(len(names)), batch.column(len(names) + 1)
            if known is None:
                kept_schema = pa.schema([batch.schema.field(i) for i in range(len(names))])
                known = kept_schema.empty_table() if names else None
            before = {}
            if prompt:
                for part in W.runs(prompts):
                    for k, ids in enumerate(encode.ids(part)):
                        before[part.first + k] = ids
            pooled = 0
            for part in W.runs(texts):
                rows_ = batch.slice(part.first, part.n).select(names)
                known = pa.concat_tables([known, pa.Table.from_batches([rows_], kept_schema)])
                for k, ids in enumerate(encode.ids(part)):
                    head = before.get(part.first + k, np.zeros(0, np.uint32))
                    pool.add(np.concatenate([head, ids, np.array([end_id], np.uint32)]), len(head))
                pooled += len(part.data)
                if pooled >= POOL_BYTES:
                    pool.pack(final=False)
                    yield from sent()
                    pooled = 0
        if known is not None:
            pool.pack(final=True)
            yield from sent()

    return rows.mapInArrow(run, schema)
