"""How the tokens of two tokenizers lie over the same text, scored by corpus-wide pair counts.

Both tokenizers encode a space and the text. Where a token of A and one of B share bytes they are
linked; where both end at one byte, a group of tokens closes. The index is inverted: each pair of ids
that is linked anywhere has, for every block of at most ``BLOCK_DOCS`` documents, bitmaps over the
block's documents. Plane k holds the documents whose number of links of the pair has bit k set. The
planes OR-merged tell which documents hold the pair, and their population count how many; the planes'
own counts, weighted by 2^k, tell the links. Blocks hold disjoint documents, so that counts of blocks
add up with map-side combine, and a pair that a third of all documents hold is one row a block. The
pairs' counts then meet the postings again, and each block's postings return the scores of its
documents.

A bitmap is compressed: below ``BLOCK_DOCS / 16`` documents it lists their numbers in 16 bits each,
otherwise it has one bit a document; the length tells which.

Rows: a null text counts as empty. Empty texts, and texts that either tokenizer does not give back
byte for byte, have no tokens: all numbers are 0 and the groups' text is empty. Very long texts are
encoded in stretches that encode alike alone, but are one document of one block. Equal texts have equal
results and repeated rows count once each; ties for the highest count are all best. An input column
that has the name of a computed one is replaced. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meshlight.llm import words as W
from meshlight.llm.batches import text_of, without
from meshlight.llm.packing import encoder
from meshlight.session import written

BLOCK_DOCS = 4096
BLOCK_BYTES = 4 << 20  # of text in a block; the document that passes it is the block's last
DENSE = BLOCK_DOCS // 8  # bytes of a bitmap with one bit a document
SPACE_MARK = "▁"  # the model's sign for a space
PIECE_BYTES = 1 << 16  # longer texts reach tokenizer B in stretches of about this size

DOCUMENT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_PLACE = "__block bigint, __slot int"
_POSTING = "__a int, __b int, __documents bigint, __links bigint, __planes array<binary>"
SCORES = "n_best bigint, count_sum bigint"

_CHARACTER_BYTES = {
    chr(c): b
    for b, c in zip(
        [*range(33, 127), *range(161, 173), *range(174, 256), *range(33), *range(127, 161), 173],
        [*range(33, 127), *range(161, 173), *range(174, 256), *range(256, 324)],
    )
}


class PieceEncoder:
    """Token ids of the sentence-piece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = SPACE_MARK
        self.bytes = []
        self.cuttable = True  # no piece goes on from a letter to a space
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(piece.replace(mark, " ").encode())
                self.cuttable &= mark not in piece.lstrip(mark)

    def _parts(self, text: bytes) -> Iterator[str]:
        """Stretches that begin at a space after something else; merges never cross such a place."""
        begin = 0
        while self.cuttable and len(text) - begin > PIECE_BYTES:
            cut = text.find(b" ", begin + PIECE_BYTES)
            while cut > 0 and text[max(0, cut - 3) : cut].endswith((b" ", SPACE_MARK.encode())):
                cut = text.find(b" ", cut + 1)
            if cut < 0 or not text[cut:].strip(b" "):
                break
            yield text[begin:cut].decode()
            begin = cut + 1  # the model puts this space back
        yield text[begin:].decode()

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, given without the space that the model adds."""
        parts = [list(self._parts(t)) for t in texts]
        found = iter(self.model.encode([p for own in parts for p in own], num_threads=1))
        return [np.array([i for _ in own for i in next(found)], np.int64) for own in parts]


class Aligner:
    """Two tokenizers and the tables that a worker needs to compare them."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = encoder(a_path), PieceEncoder(b_path)
        vocabulary = sorted((i, t) for t, i in self.a.tokenizer.get_vocab().items())
        a_bytes = [b""] * (vocabulary[-1][0] + 1)
        for i, token in vocabulary:
            known = all(c in _CHARACTER_BYTES for c in token)
            a_bytes[i] = bytes(_CHARACTER_BYTES[c] for c in token) if known else token.encode()
        self.a_pieces, self.b_pieces = pa.array(a_bytes, pa.large_binary()), pa.array(self.b.bytes, pa.large_binary())
        self.a_lengths = np.array([len(x) for x in a_bytes])
        self.b_lengths = np.array([len(x) for x in self.b.bytes])
        # What a token writes into the groups' text: its id, and the mark after it.
        self.items = pa.array(
            [f"{i}{m}" for i in range(len(a_bytes)) for m in ",|"] + [f"{i}{m}" for i in range(len(self.b.bytes)) for m in ",;"],
            pa.large_string(),
        )
        self.slot_bits = (BLOCK_DOCS - 1).bit_length()
        self.b_bits = len(self.b.bytes).bit_length()

    def compared(self, run: W.Run, slots: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The document columns of a run (each text after its space), and (a, b, slot) keys of all links."""
        text = run.data.tobytes()
        cuts = run.bounds.tolist()
        own = [text[x:y] for x, y in zip(cuts, cuts[1:])]
        a_ids = self.a.ids(run)
        b_ids = self.b.ids([x[1:] for x in own])
        given_back = [
            len(x) > 1 and _joined(self.a_pieces, a) == x and _joined(self.b_pieces, b) == x
            for x, a, b in zip(own, a_ids, b_ids)
        ]
        kept = np.flatnonzero(given_back)
        n_a, n_b, n_groups, n_links = np.zeros((4, run.n), np.int64)
        digests = [""] * run.n
        columns = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests}
        if not len(kept):
            return columns, np.zeros(0, np.int64)
        a = np.concatenate([a_ids[d] for d in kept]).astype(np.int64)
        b = np.concatenate([b_ids[d] for d in kept])
        edges = np.cumsum(np.diff(run.bounds)[kept])
        ends = np.zeros((2, edges[-1] + 1), bool)
        ends[0, np.cumsum(self.a_lengths[a])] = True
        ends[1, np.cumsum(self.b_lengths[b])] = True
        # Bytes between two neighbouring token ends lie in one token of each: they are one link.
        at = np.flatnonzero(ends[0] | ends[1])
        a_ends, b_ends = ends[0, at], ends[1, at]
        both = a_ends & b_ends
        a_of, b_of, group = (np.cumsum(x) - x for x in (a_ends, b_ends, both))
        document = np.searchsorted(edges, at)
        for column, flags in ((n_links, slice(None)), (n_groups, both), (n_a, a_ends), (n_b, b_ends)):
            column[kept] = np.bincount(document[flags], minlength=len(kept))
        for d, digest in zip(kept, self._digests(a, b, group[a_ends], group[b_ends], n_a[kept] + n_b[kept])):
            digests[d] = digest
        keys = ((a[a_of] << self.b_bits | b[b_of]) << self.slot_bits) | slots[kept][document]
        return columns, keys

    def _digests(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, items: np.ndarray) -> list[str]:
        """SHA-256 of each document's groups, written as a1,a2|b1;a3|b2,b3."""
        n = a_group[-1] + 1
        a_in, b_in = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        sequence = np.empty(len(a) + len(b), np.int64)
        last = np.append(a_group[1:] != a_group[:-1], True)
        sequence[np.arange(len(a)) + (np.cumsum(b_in) - b_in)[a_group]] = 2 * a + last
        last = np.append(b_group[1:] != b_group[:-1], True)
        sequence[np.arange(len(b)) + np.cumsum(a_in)[b_group]] = 2 * (len(self.a_lengths) + b) + last
        text = self.items.take(pa.array(sequence))
        offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(sequence) + 1]
        data = memoryview(text.buffers()[2])
        cuts = offsets[np.concatenate([[0], np.cumsum(items)])].tolist()
        return [hashlib.sha256(data[x : y - 1]).hexdigest() for x, y in zip(cuts, cuts[1:])]

    def postings(self, keys: np.ndarray) -> dict[str, object]:
        """The pairs of a block: ids, documents, links and planes."""
        keys, links = np.unique(keys, return_counts=True)
        slots = keys & (BLOCK_DOCS - 1)
        pairs = keys >> self.slot_bits
        firsts = np.flatnonzero(np.diff(pairs, prepend=-1))
        pair = np.cumsum(np.diff(pairs, prepend=-1) != 0) - 1
        # Planes of each pair: as many as its largest number of links has bits.
        n_planes = np.frexp(np.maximum.reduceat(links, firsts).astype(np.float64))[1].astype(np.int64)
        base = np.concatenate([[0], np.cumsum(n_planes)])
        bitmap, member = [], []
        for k in range(int(n_planes.max())):
            set_ = np.flatnonzero(links >> k & 1)
            bitmap.append(base[pair[set_]] + k)
            member.append(slots[set_])
        bitmap, member = np.concatenate(bitmap), np.concatenate(member)
        order = np.argsort(bitmap, kind="stable")
        planes = _compressed(bitmap[order], member[order], int(base[-1]))
        ids = pairs[firsts]
        return {
            "__a": (ids >> self.b_bits).astype(np.int32),
            "__b": (ids & ((1 << self.b_bits) - 1)).astype(np.int32),
            # A document of the pair has a bit in some plane, and one entry among the distinct keys.
            "__documents": np.diff(np.append(firsts, len(keys))).astype(np.int64),
            "__links": np.add.reduceat(links, firsts),
            "__planes": pa.ListArray.from_arrays(pa.array(base, pa.int32()), planes),
        }


def _joined(pieces: pa.Array, ids: np.ndarray) -> bytes:
    found = pieces.take(pa.array(ids, pa.int64()))
    data = found.buffers()[2]
    return data.to_pybytes() if len(ids) and data is not None else b""


def _compressed(bitmap: np.ndarray, member: np.ndarray, n: int) -> pa.Array:
    """n bitmaps from (bitmap, member) entries sorted by both, as a binary array."""
    counts = np.bincount(bitmap, minlength=n)
    dense = np.flatnonzero(2 * counts >= DENSE)
    lengths = 2 * counts
    lengths[dense] = DENSE
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    listed = np.ones(n, bool)
    listed[dense] = False
    data = np.zeros(offsets[-1], np.uint8)
    is_listed = np.ones(offsets[-1], bool)
    begins = np.concatenate([[0], np.cumsum(counts)])
    for i in dense:
        bits = np.zeros(BLOCK_DOCS, bool)
        bits[member[begins[i] : begins[i + 1]]] = True
        data[offsets[i] : offsets[i + 1]] = np.packbits(bits, bitorder="little")
        is_listed[offsets[i] : offsets[i + 1]] = False
    data[is_listed] = member[listed[bitmap]].astype("<u2").view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def members(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap, member) entries of a binary array of bitmaps, in no fixed order."""
    n = len(bitmaps)
    _, offsets, data = bitmaps.buffers()
    offsets = np.frombuffer(offsets, np.int32)[bitmaps.offset : bitmaps.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    dense = np.flatnonzero(lengths == DENSE)
    is_listed = np.repeat(lengths != DENSE, lengths)
    at, slots = [np.repeat(np.arange(n), np.where(lengths == DENSE, 0, lengths // 2))], [data[is_listed].view("<u2").astype(np.int64)]
    for k in range(0, len(dense), 256):
        some = dense[k : k + 256]
        bits = np.unpackbits(data[offsets[some][:, None] + np.arange(DENSE)], axis=1, bitorder="little")
        row, slot = np.nonzero(bits)
        at.append(some[row])
        slots.append(slot)
    return np.concatenate(at), np.concatenate(slots)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def indexed(df: DataFrame, a_path: str, b_path: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """One written table of document rows (``__a`` is null) and posting rows, from one reading of the texts."""
    added = StructType.fromDDL(f"{DOCUMENT}, {_PLACE}, {_POSTING}")
    carried = without(
        df.select(*[f"`{c}`" for c in keep]) if keep is not None else df,
        [*added.fieldNames(), *StructType.fromDDL(SCORES).fieldNames()],
    )
    spaced = F.concat(F.lit(" "), text_of(text))
    rows = df.select(*[F.col(f"`{c}`") for c in carried], spaced.alias("__text"))
    fields = [*df.select(*[f"`{c}`" for c in carried]).schema.fields, *added.fields]
    for f in fields:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(a_path, b_path)
        kinds = None
        block, slot, size, keys = TaskContext.get().partitionId() << 33, 0, 0, []

        def rows_of(columns: dict[str, object], n: int) -> pa.RecordBatch:
            arrays = []
            for name, kind in kinds.items():
                x = columns.get(name)
                x = pa.nulls(n, kind) if x is None else x if isinstance(x, pa.Array) else pa.array(x)
                arrays.append(x if x.type == kind else x.cast(kind))
            return pa.RecordBatch.from_arrays(arrays, list(kinds))

        def closed() -> Iterator[pa.RecordBatch]:
            links = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            if len(links):
                posted = made.postings(links)
                n = len(posted["__a"])
                yield rows_of(posted | {"__block": np.full(n, block)}, n)

        for batch in batches:
            if kinds is None:
                kinds = {f.name: f.type for f in list(batch.schema)[:-1]}
                kinds |= {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
                          "__block": pa.int64(), "__slot": pa.int32(), "__a": pa.int32(), "__b": pa.int32(), "__documents": pa.int64(),
                          "__links": pa.int64(), "__planes": pa.list_(pa.binary())}
            texts = batch.column(batch.num_columns - 1)
            for part in W.runs(texts):
                first = 0
                while first < part.n:  # a block ends within a run where it is full
                    n = min(part.n - first, BLOCK_DOCS - slot)
                    piece = W.Run(
                        part.first + first, n, part.data[part.bounds[first] : part.bounds[first + n]],
                        part.bounds[first : first + n + 1] - part.bounds[first],
                    )
                    slots = np.arange(slot, slot + n)
                    columns, links = made.compared(piece, slots)
                    keys.append(links)
                    columns |= {"__block": np.full(n, block), "__slot": slots}
                    for i, name in enumerate(batch.schema.names[:-1]):
                        columns[name] = batch.column(i).slice(piece.first, n)
                    yield rows_of(columns, n)
                    first, slot, size = first + n, slot + n, size + len(piece.data)
                    if slot == BLOCK_DOCS or size >= BLOCK_BYTES:
                        yield from closed()
                        block, slot, size, keys = block + 1, 0, 0, []
        yield from closed()

    return written(rows.mapInArrow(run, StructType(fields)), "alignment")


def pair_counts(index: DataFrame) -> DataFrame:
    """(a, b, documents, links, best) of every linked pair; best: no pair of this a is in more documents."""
    postings = index.where("__a IS NOT NULL")
    counts = postings.groupBy(F.col("__a").alias("a"), F.col("__b").alias("b")).agg(
        F.sum("__documents").alias("documents"), F.sum("__links").alias("links")
    )
    # At most as many rows an id as the other vocabulary has entries.
    return counts.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy("a")))


def _scored(postings: pa.Table) -> pa.Table:
    """Per document of one block: best links, and the sum of counts over its links."""
    postings = postings.combine_chunks()
    counts = postings["documents"].to_numpy()
    best = postings["best"].to_numpy().astype(np.int64)
    planes = pa.concat_arrays(postings["__planes"].chunks)
    sizes = pc.list_value_length(planes).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    plane = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bitmap, slot = members(planes.flatten())
    sums = np.zeros((2, BLOCK_DOCS), np.int64)
    for total, weight in zip(sums, (best, counts)):
        np.add.at(total, slot, (weight[row] << plane)[bitmap])
    slots = np.unique(slot)
    return pa.table({
        "__block": np.full(len(slots), postings["__block"][0].as_py()), "__slot": slots.astype(np.int32),
        "n_best": sums[0, slots], "count_sum": sums[1, slots],
    })


def scored(index: DataFrame) -> DataFrame:
    """Every document of ``indexed`` with its numbers and scores.

    The join on the pair is one that Spark splits where a pair's postings fill a partition; the
    postings of a block then meet in one group, which a block's size bounds.
    """
    documents = index.where("__a IS NULL").drop("__a", "__b", "__documents", "__links", "__planes")
    postings = index.where("__a IS NOT NULL").select("__block", "__a", "__b", "__planes")
    pairs = pair_counts(index).select(F.col("a").alias("__a"), F.col("b").alias("__b"), "documents", "best")
    met = postings.join(pairs, ["__a", "__b"]).select("__block", "documents", "best", "__planes")
    scores = met.groupBy("__block").applyInArrow(_scored, f"{_PLACE}, {SCORES}")
    names = StructType.fromDDL(SCORES).fieldNames()
    out = documents.join(scores, ["__block", "__slot"], "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})
    return out.drop("__block", "__slot")


def aligned(df: DataFrame, a_path: str, b_path: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (its ``keep`` columns) with n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum."""
    return scored(indexed(df, a_path, b_path, text, keep))
