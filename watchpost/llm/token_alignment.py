"""Which tokens of one tokenizer stand where tokens of another do, counted over a corpus.

A text is encoded by a byte-level tokenizer (A) and by a sentence piece model (B). Both spell the
same bytes; where tokens of both end, they are cut into groups, and every pair of occurrences whose
bytes overlap is a link.

The index is inverted: for each pair of ids a compressed bitmap of the documents that hold it
linked, and bitmaps of the binary digits of how often (its multiplicity planes). Documents are
numbered within segments of at most 65,536. A batch of documents makes bitmaps of its own, those
of a segment are OR-merged, and popcounts give the documents and links of a pair. Scores come back
through the postings: every bitmap adds its pair's count to the documents in it.

Contract for odd input. Texts that are null, empty, or whose tokens do not spell a space and the
text (B writes U+2581 as a space) have no tokens: zeros and an empty group string. Every row is a
document, whatever its id: null and repeated ids stay. Very long texts are encoded whole and their
links are counted in slices. No documents, no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored
from .encode import SPELLING

#: a pair of ids as one number
PAIR_BITS = 20
DOC_BITS = 16
#: links that are counted in one go, links of a batch of documents, and postings of a segment
SLICE, BATCH_LINKS, SEGMENT_POSTINGS = 2_000_000, 2_000_000, 6_000_000
#: remembered parts of texts
PARTS = 500_000
# A text is cut where neither tokenizer can join: before a space or a line end that follows
# something else than white space, between a line end and what is no white space, and after a
# letter or digit before anything else. A takes these apart by its pattern; that B has no piece
# across them is read from its vocabulary.
SPACE = "▁"
LETTERS = "A-Za-z0-9À-ÖØ-öø-ÿ"
BREAKS = "(?<=[^\\s▁])(?=[ \n])|(?<=\n)(?=\\S)"
CUT = re.compile(BREAKS)
FINE_CUT = re.compile(f"{BREAKS}|(?<=[{LETTERS}])(?=[^\\w\\s])")
ACROSS = re.compile(f"[{LETTERS}][^\\w\\s]")


def piece_bytes(piece: str) -> bytes:
    """What a piece of B spells."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE, " ").encode()


def linked(a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int], a_text, b_text):
    """The links of two token lists over the same bytes, as codes, and the groups as texts."""
    codes, groups, i, j = [], [], 0, 0
    a_end, b_end = a_sizes[0], b_sizes[0]
    a_shown, b_shown = a_text[a[0]], b_text[b[0]]
    while True:
        codes.append(a[i] << PAIR_BITS | b[j])
        if a_end == b_end:
            groups.append(f"{a_shown}|{b_shown}")
            i += 1
            j += 1
            if i == len(a):
                return codes, groups
            a_end += a_sizes[i]
            b_end += b_sizes[j]
            a_shown, b_shown = a_text[a[i]], b_text[b[j]]
        elif a_end < b_end:
            i += 1
            a_end += a_sizes[i]
            a_shown += f",{a_text[a[i]]}"
        else:
            j += 1
            b_end += b_sizes[j]
            b_shown += f",{b_text[b[j]]}"


class Aligner:
    """Two tokenizers, and the aligned parts of texts that a worker has met.

    ``find`` gives each part a number; ``counts`` holds, by number, whether both spell it and its
    tokens of A, tokens of B, groups and links; ``codes`` holds all links, part after part.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        # the strings of special tokens are ordinary text in a document
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: b for b, c in SPELLING.items() if b != 10}
        byte[chr(256 + 10)] = 10
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, n in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[n] = bytes(byte[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << PAIR_BITS:
            raise ValueError(f"vocabularies must have at most {1 << PAIR_BITS} ids")
        plain = [p for p in pieces if not self.b.is_byte(self.b.piece_to_id(p))]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in plain):
            raise ValueError("the sentence piece model has pieces with a space inside")
        self.cut = CUT if any(ACROSS.search(p) for p in plain[3:]) else FINE_CUT
        self.a_sizes, self.b_sizes = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        self.a_text, self.b_text = [[str(i) for i in range(len(x))] for x in (self.a_bytes, self.b_bytes)]
        self.lone_space = self.b.piece_to_id(SPACE)
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 5), np.int64)
        self.starts = np.zeros(0, np.int64)
        self.codes = np.zeros(0, np.int64)

    def _learn(self, missing: list[str]) -> None:
        encoded = self.a.encode_batch_fast(missing, add_special_tokens=False)
        # B puts a space before a text: it stands for the part's own, or for a line end that is
        # put there and whose two ids are dropped again
        inside = [p[0] != " " for p in missing]
        sent = [f"\n{p}" if own else p[1:] for p, own in zip(missing, inside)]
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        counts, codes, none = [], [], (0, 0, 0, 0, 0)
        for part, found, b, own in zip(missing, encoded, self.b.encode(sent, num_threads=1), inside):
            a = found.ids
            if own:
                b = b[2:]
            elif part == " ":
                b = [self.lone_space]
            self.numbers[part] = len(self.groups)
            whole = part.encode()
            if b"".join([a_bytes[i] for i in a]) != whole or b"".join([b_bytes[i] for i in b]) != whole:
                self.groups.append("")
                counts.append(none)
                continue
            links, groups = linked(
                a, b, [self.a_sizes[i] for i in a], [self.b_sizes[i] for i in b], self.a_text, self.b_text
            )
            codes += links
            self.groups.append(";".join(groups))
            counts.append((1, len(a), len(b), len(groups), len(links)))
        fresh = np.array(counts, np.int64)
        ends = np.cumsum(fresh[:, 4]) + len(self.codes)
        self.starts = np.concatenate([self.starts, ends - fresh[:, 4]])
        self.counts = np.concatenate([self.counts, fresh])
        self.codes = np.concatenate([self.codes, np.array(codes, np.int64)])

    def find(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of each text's parts; none for a null or empty text."""
        if len(self.numbers) > PARTS:
            self.clear()
        split, known = self.cut.split, self.numbers
        cut = [split(f" {t}") if t else [] for t in texts]
        missing = set().union(*cut).difference(known)
        if missing:
            self._learn(list(missing))
        return [[known[p] for p in parts] for parts in cut]

    def links(self, numbers: np.ndarray) -> np.ndarray:
        """The links of some parts, part after part."""
        many = self.counts[numbers, 4]
        ends = np.cumsum(many)
        at = np.repeat(self.starts[numbers] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
        return self.codes[at]


class Plane:
    """Sets of documents for some pairs: 16-bit numbers where they are few, else bits.

    ``index`` says which pairs of a segment have a set here and ``many`` how large it is.
    """

    def __init__(self, index: np.ndarray, many: np.ndarray, few: np.ndarray, bits: np.ndarray, docs: int):
        self.index, self.many, self.few, self.bits, self.docs = index, many, few, bits, docs

    @classmethod
    def of(cls, index: np.ndarray, doc: np.ndarray, docs: int) -> Plane:
        """From (pair, document) rows in ascending order."""
        first = np.flatnonzero(np.diff(index, prepend=-1))
        many = np.diff(np.append(first, len(index)))
        dense = many * 16 > docs
        few = doc[~np.repeat(dense, many)].astype("<u2")
        width = -(-docs // 8)
        bits = np.zeros((int(dense.sum()), width), np.uint8)
        flags = np.zeros(width * 8, np.uint8)
        for k, (low, n) in enumerate(zip(first[dense].tolist(), many[dense].tolist())):
            flags[:] = 0
            flags[doc[low : low + n]] = 1
            bits[k] = np.packbits(flags)
        return cls(index[first], many, few, bits, docs)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The (pair, document) rows again, in no order."""
        dense = self.many * 16 > self.docs
        at, doc = np.nonzero(np.unpackbits(self.bits, axis=1)) if len(self.bits) else (np.zeros(0, np.int64),) * 2
        index = np.concatenate([np.repeat(self.index[~dense], self.many[~dense]), self.index[dense][at]])
        return index, np.concatenate([self.few.astype(np.int64), doc])

    def add_to(self, totals: np.ndarray, values: np.ndarray) -> None:
        """Adds each pair's row of ``values`` to the documents in its set."""
        dense = self.many * 16 > self.docs
        sparse = np.repeat(self.index[~dense], self.many[~dense])
        for column in range(values.shape[1]):
            # whole numbers, exact in doubles far beyond any count of links
            sums = np.bincount(self.few, values[sparse, column].astype(float), self.docs)
            totals[:, column] += sums.astype(np.int64)
        for pair, bits in zip(self.index[dense].tolist(), self.bits):
            totals[np.unpackbits(bits)[: self.docs].view(bool)] += values[pair]


class PairBitmaps:
    """The inverted index of a segment: pairs, a plane of presence, and planes of digits.

    Plane 0 holds who has a pair at all, plane k + 1 who has digit k of the number of links less one.
    """

    def __init__(self, pairs: np.ndarray, planes: list[Plane], docs: int):
        self.pairs, self.planes, self.docs = pairs, planes, docs

    @classmethod
    def count(cls, keys: np.ndarray, times: np.ndarray, docs: int) -> PairBitmaps:
        """From distinct (pair, document) keys in ascending order and how often each is linked."""
        pair, doc = keys >> DOC_BITS, keys & ((1 << DOC_BITS) - 1)
        new = np.diff(pair, prepend=-1) != 0
        index = np.cumsum(new) - 1
        planes, more = [Plane.of(index, doc, docs)], times - 1
        while (live := more > 0).any():
            index, doc, more = index[live], doc[live], more[live]
            odd = more & 1 == 1
            planes.append(Plane.of(index[odd], doc[odd], docs))
            more = more >> 1
        return cls(pair[new], planes, docs)

    @classmethod
    def merged(cls, parts: list[PairBitmaps], docs: int) -> PairBitmaps:
        """The parts' bitmaps of each pair and plane, OR-ed."""
        pairs = np.unique(np.concatenate([p.pairs for p in parts]))
        planes = []
        for k in range(max(len(p.planes) for p in parts)):
            rows = []
            for p in parts:
                if k < len(p.planes):
                    index, doc = p.planes[k].rows()
                    rows.append(np.searchsorted(pairs, p.pairs)[index] << DOC_BITS | doc)
            keys = np.unique(np.concatenate(rows))
            planes.append(Plane.of(keys >> DOC_BITS, keys & ((1 << DOC_BITS) - 1), docs))
        return cls(pairs, planes, docs)

    def links(self) -> np.ndarray:
        """Each pair's links: popcounts of the planes, weighted by their digits."""
        out = np.zeros(len(self.pairs), np.int64)
        for k, plane in enumerate(self.planes):
            out[plane.index] += plane.many << max(k - 1, 0)
        return out

    def scores(self, values: np.ndarray) -> np.ndarray:
        """For each document the sum over its links of their pair's row of ``values``."""
        totals = np.zeros((self.docs, values.shape[1]), np.int64)
        for k, plane in enumerate(self.planes):
            plane.add_to(totals, values << max(k - 1, 0))
        return totals

    def packed(self) -> bytes:
        out = [np.array([self.docs, len(self.planes)], "<i8").tobytes()]
        for p in self.planes:
            parts = (p.index.astype("<i4"), p.many.astype("<i4"), p.few, p.bits)
            out.append(np.array([x.nbytes for x in parts], "<i8").tobytes())
            out += [x.tobytes() for x in parts]
        return b"".join(out)

    @classmethod
    def unpacked(cls, pairs: np.ndarray, data: bytes) -> PairBitmaps:
        docs, many = np.frombuffer(data, "<i8", 2).tolist()
        at, planes = 16, []
        for _ in range(many):
            sizes = np.frombuffer(data, "<i8", 4, at).tolist()
            at += 32
            parts = []
            for size, kind in zip(sizes, ("<i4", "<i4", "<u2", "u1")):
                parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
                at += size
            index, number, few, bits = parts
            planes.append(
                Plane(index.astype(np.int64), number.astype(np.int64), few, bits.reshape(-1, -(-docs // 8)), docs)
            )
        return cls(pairs, planes, docs)


def count_links(codes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, times = np.unique(codes << DOC_BITS | docs, return_counts=True)
    return keys, times


class Segment:
    """Documents gathered in a task until their postings are enough for a row of the index."""

    FIELDS = ("ids", "n_a", "n_b", "n_groups", "groups_sha256")

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.rows: dict[str, list] = {f: [] for f in self.FIELDS}
        self.parts: list[PairBitmaps] = []
        self.postings = 0
        self.open_links = 0
        self.open_parts: list[list[int]] = []
        self.first = 0

    def add(self, doc_id, numbers: list[int]) -> None:
        found = np.array(numbers, np.int64)
        counts = self.aligner.counts[found]
        if not len(found) or not counts[:, 0].all():
            found, counts = found[:0], counts[:0]
        _, n_a, n_b, n_groups, n_links = counts.sum(0).tolist()
        groups = self.aligner.groups
        digest = hashlib.sha256(";".join([groups[i] for i in found.tolist()]).encode()).hexdigest()
        row = (doc_id, n_a, n_b, n_groups, digest if n_a else "")
        for field, value in zip(self.FIELDS, row):
            self.rows[field].append(value)
        self.open_parts.append(found)
        self.open_links += n_links
        if self.open_links > BATCH_LINKS:
            self.close_batch()

    def close_batch(self) -> None:
        """Bitmaps of the documents since the last batch; their links counted in slices."""
        if self.open_parts:
            sizes = [len(p) for p in self.open_parts]
            docs = np.repeat(np.arange(self.first, self.first + len(sizes)), sizes)
            numbers = np.concatenate(self.open_parts)
            ends = np.cumsum(self.aligner.counts[numbers, 4])
            keys = times = np.zeros(0, np.int64)
            low = 0
            while low < len(numbers):
                base = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, base + SLICE, "right")))
                part = numbers[low:high]
                more, often = count_links(
                    self.aligner.links(part), np.repeat(docs[low:high], self.aligner.counts[part, 4])
                )
                if len(keys):
                    both = np.concatenate([keys, more])
                    keys, where = np.unique(both, return_inverse=True)
                    times = np.bincount(where, np.concatenate([times, often]), len(keys)).astype(np.int64)
                else:
                    keys, times = more, often
                low = high
            if len(keys):
                self.parts.append(PairBitmaps.count(keys, times, self.first + len(sizes)))
                self.postings += len(keys)
            self.first += len(sizes)
        self.open_parts, self.open_links = [], 0

    def full(self) -> bool:
        return self.first + len(self.open_parts) == 1 << DOC_BITS or self.postings > SEGMENT_POSTINGS

    def record(self, name: str, id_type: pa.DataType) -> pa.RecordBatch:
        self.close_batch()
        docs = len(self.rows["ids"])
        if self.parts:
            index = PairBitmaps.merged(self.parts, docs)
        else:
            index = PairBitmaps(np.zeros(0, np.int64), [], docs)
        present = np.zeros(0, np.int64) if not index.planes else index.planes[0].many
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_pydict(
            {
                "segment": pa.array([name]),
                "ids": pa.array([self.rows["ids"]], pa.list_(id_type)),
                "n_a": pa.array([self.rows["n_a"]], longs),
                "n_b": pa.array([self.rows["n_b"]], longs),
                "n_groups": pa.array([self.rows["n_groups"]], longs),
                "groups_sha256": pa.array([self.rows["groups_sha256"]], pa.list_(pa.string())),
                "pair": pa.array([index.pairs], longs),
                "docs": pa.array([present], longs),
                "links": pa.array([index.links()], longs),
                "bitmaps": pa.array([index.packed()], pa.binary()),
            }
        )


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner for two tokenizer files."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def index_links(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The inverted index of all documents, a row for each segment, in the shared folder."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"segment string, ids array<{kind}>, n_a array<long>, n_b array<long>,"
        " n_groups array<long>, groups_sha256 array<string>, pair array<long>, docs array<long>,"
        " links array<long>, bitmaps binary"
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        task = TaskContext.get().partitionId()
        segment, count, id_type = None, 0, None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                # remembered parts keep their numbers while a batch of documents is open
                if segment is not None and len(own.numbers) > PARTS:
                    segment.close_batch()
                found = own.find(part.column("text").to_pylist())
                for doc_id, numbers in zip(part.column("id").to_pylist(), found):
                    if segment is None:
                        segment = Segment(own)
                    segment.add(doc_id, numbers)
                    if segment.full():
                        yield segment.record(f"{task}-{count}", id_type)
                        segment, count = None, count + 1
        if segment is not None:
            yield segment.record(f"{task}-{count}", id_type)

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(chosen.mapInArrow(build, schema), "pair-bitmaps")


def _postings(index: DataFrame) -> DataFrame:
    held = index.select("segment", F.explode(F.arrays_zip("pair", "docs", "links")).alias("p"))
    return held.select("segment", "p.pair", "p.docs", "p.links")


def count_pairs(index: DataFrame) -> DataFrame:
    """(pair, a, b, docs, links, best): over the corpus, and whether no pair of its A id is in more."""
    counted = _postings(index).groupBy("pair").agg(
        F.sum("docs").alias("docs"), F.sum("links").alias("links")
    )
    named = counted.withColumns(
        {
            "a": F.shiftright("pair", PAIR_BITS).cast("int"),
            "b": F.expr(f"CAST(pair & {(1 << PAIR_BITS) - 1} AS INT)"),
        }
    )
    # an A id has at most as many pairs as B has ids
    most = F.max("docs").over(Window.partitionBy("a"))
    return named.select("pair", "a", "b", "docs", "links", (F.col("docs") == most).alias("best"))


def score_documents(index: DataFrame, pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each document, its link counts summed through the postings of its segment.

    Every segment gets the counts of its own pairs, so a task holds one segment at a time.
    """
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = (
        f"{id_col} {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long,"
        " count_sum long, groups_sha256 string"
    )
    wanted = _postings(index).select(F.col("segment").alias("of"), "pair").join(
        pairs.select("pair", "docs", "best"), "pair"
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], schema=_arrow_schema(left, id_col))
        row = {c: left.column(c)[0] for c in left.column_names}
        own = np.asarray(row["pair"].values)
        order = np.argsort(right.column("pair").to_numpy())
        docs = right.column("docs").to_numpy()[order]
        best = right.column("best").to_numpy()[order].astype(np.int64)
        index = PairBitmaps.unpacked(own, row["bitmaps"].as_py())
        sums = index.scores(np.stack([np.ones_like(docs), best, docs], 1))
        return pa.Table.from_arrays(
            [
                row["ids"].values, row["n_a"].values, row["n_b"].values, row["n_groups"].values,
                *(pa.array(sums[:, c]) for c in range(3)), row["groups_sha256"].values,
            ],
            schema=_arrow_schema(left, id_col),
        )

    needed = index.select("segment", "ids", "n_a", "n_b", "n_groups", "groups_sha256", "pair", "bitmaps")
    return needed.groupBy("segment").cogroup(wanted.groupBy("of")).applyInArrow(score, schema)


def _arrow_schema(left: pa.Table, id_col: str) -> pa.Schema:
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return pa.schema(
        [
            (id_col, left.schema.field("ids").type.value_type),
            *((n, pa.int64()) for n in names),
            ("groups_sha256", pa.string()),
        ]
    )


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Index, count and score all documents."""
    index = index_links(docs, path_a, path_b)
    return score_documents(index, count_pairs(index))
