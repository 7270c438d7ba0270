"""Cross-tokenizer alignment: which tokens of one tokenizer go with which of another.

Method: both tokenizers read the same bytes.  Where tokens of both end, the
text is cut into groups; all pairs across a group are linked.  How many documents
link a pair of ids is counted in dense matrices: the ids of the first tokenizer
are dealt to ``STRIPES`` stripes, tasks add the pairs of a stripe into its block
(``np.add.at``), blocks of one stripe are added up, and row maxima give the best
partners of each id.  The links of a document are scored where the stripe's
counts are, co-partitioned by stripe and by a salt of the batches, so that a
stripe of frequent ids lies in as many parts as its links need.

Pairs are counted once a batch of documents before they are moved.  In a group
of very many tokens (neither tokenizer ends where the other does) equal ids are
counted first, so its pairs are never written out one by one.

Defined results: texts that are null, empty, or whose tokens do not spell the
text have no tokens, zeros and an empty digest; special tokens' strings in a
text are plain text; very long texts are encoded in parts that end before a
blank, which changes no token; equal rows are documents of their own and count
each; ties are all best; an empty table gives an empty one; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import partitions, texts, written
from .textbytes import texts_of

STRIPES = 256
SLICE = 1 << 20
#: Characters of a text that are encoded at once.
LONG = 1 << 20
#: Links of a stripe in one part.
PART = 4_000_000
#: Groups of more links than this are counted by distinct ids.
WIDE = 4096
_DOUBLE_SPACE = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=[!-~])(?= [!-~])")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE tokenizer from its JSON file's text.

    If ids follow the merges, a faster reader of the same merges does texts
    without neighbouring blanks, where the pattern needs no look-ahead.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(file)
        self.own.encode_special_tokens = True
        model, letters = json.loads(file)["model"], byte_letters()
        vocabulary = self.own.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in model["vocab"].items():
            self.pieces[i] = bytes(letters[c] for c in piece)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.fast = None
        if [model["vocab"][m] for m in merged] == list(range(256, 256 + len(merged))):
            import tiktoken

            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
            self.fast = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks={self.pieces[i]: i for i in model["vocab"].values()}, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or _DOUBLE_SPACE.search(text):
            return self.own.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces:
    """A sentence-piece tokenizer from its model's bytes; it puts a blank before each text."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = []
        for i in range(self.own.get_piece_size()):
            piece = self.own.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece) if self.own.is_byte(i) else None
            self.pieces.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        #: No piece holds a blank after something else, so no token crosses from a letter to a blank.
        self.cuts = not any(b" " in p.lstrip(b" ") for p in self.pieces)

    def encode(self, text: str) -> list[int]:
        return self.own.encode(text, num_threads=1)


def parts_of(text: str, long: int) -> list[str]:
    """A text in parts of about ``long`` characters, which end before a blank between two visible ones."""
    out, at = [], 0
    while len(text) - at > long:
        cut = _CUT.search(text, at + long)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


class Bytes:
    """The bytes of a vocabulary's tokens, one after another."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)]


def digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of numbers below n, left in rows with room for one sign more, and how many there are."""
    text = [str(i).encode() for i in range(n)]
    width = len(text[-1]) + 1
    return np.frombuffer(b"".join(t.ljust(width) for t in text), np.uint8).reshape(n, width), np.array([len(t) for t in text])


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as hold them; the first byte says how many."""
    top = int(x.max()) if len(x) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.append(values, 0), off[:-1]) * (np.diff(off) > 0) if len(off) > 1 else np.zeros(0, np.int64)


class Aligner:
    """Groups and links of some texts."""

    def __init__(self, a: ByteLevel, b: Pieces, stripes: int):
        self.a, self.b = a, b
        self.a_bytes, self.b_bytes = Bytes(a.pieces), Bytes(b.pieces)
        self.digits, self.n_digits = digits(max(len(a.pieces), len(b.pieces)))
        self.stripes, self.rows, self.width = stripes, -(-len(a.pieces) // stripes), len(b.pieces)
        ids = np.arange(len(a.pieces))
        #: Ids in the order of their stripe and row.
        self.place = ids % stripes * self.rows + ids // stripes

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        if len(text) <= LONG:
            return self.a.encode(" " + text), self.b.encode(text)
        a = [x for part in parts_of(" " + text, LONG) for x in self.a.encode(part)]
        return a, [x for part in (parts_of(" " + text, LONG) if self.b.cuts else [" " + text]) for x in self.b.encode(part[1:])]

    def align(self, given: list[bytes]):
        """n_a, n_b, n_groups, n_links and digest of each text; and place * width + b, text and number of each distinct link, sorted."""
        n = len(given)
        of = [self.tokens(t.decode()) if t else ([], []) for t in given]
        ok = np.array([bool(t) for t in given], bool)
        for k in range(2):  # first texts whose lengths differ go, then those whose bytes do
            kept = np.flatnonzero(ok)
            a = np.array([x for i in kept for x in of[i][0]], np.int64)
            b = np.array([x for i in kept for x in of[i][1]], np.int64)
            a_off = np.cumsum([0, *(len(of[i][0]) for i in kept)])
            b_off = np.cumsum([0, *(len(of[i][1]) for i in kept)])
            size = np.array([1 + len(given[i]) for i in kept], np.int64)
            if not k:
                fit = (_per_text(self.a_bytes.size[a], a_off) == size) & (_per_text(self.b_bytes.size[b], b_off) == size)
            else:
                data = np.frombuffer(b"".join(b" " + given[i] for i in kept), np.uint8)
                wrong = (self.a_bytes.spell(a) != data) | (self.b_bytes.spell(b) != data)
                fit = _per_text(wrong.astype(np.int64), np.cumsum([0, *size])) == 0
            if k and fit.all():
                break
            ok[kept[~fit]] = False
        else:
            return self.align([t if o else b"" for t, o in zip(given, ok, strict=True)])
        counts = np.zeros((4, n), np.int64)
        digest = [""] * n
        if not len(kept):
            return counts, digest, np.zeros((3, 0), np.int64)
        a_end, b_end = np.cumsum(self.a_bytes.size[a]), np.cumsum(self.b_bytes.size[b])
        ends = np.zeros(len(data) + 1, np.uint8)
        ends[a_end] = 1
        ends[b_end] += 2
        a_last, b_last = ends[a_end] == 3, ends[b_end] == 3
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        doc = np.repeat(np.arange(len(kept)), np.diff(a_off))[a_last]
        a_n, b_n = np.bincount(a_group, minlength=len(doc)), np.bincount(b_group, minlength=len(doc))
        counts[0, kept], counts[1, kept] = np.diff(a_off), np.diff(b_off)
        counts[2, kept] = np.bincount(doc, minlength=len(kept))
        np.add.at(counts[3], kept[doc], a_n * b_n)
        for i, text in zip(kept, self._written(a, b, a_last, b_last, a_group, b_group, a_n, b_n, a_off, b_off), strict=True):
            digest[i] = hashlib.sha256(text).hexdigest()
        return counts, digest, self._links(a, b, a_group, a_n, b_n, kept[doc], n)

    def _written(self, a, b, a_last, b_last, a_group, b_group, a_n, b_n, a_off, b_off):
        """Ids in the order of their groups, with their signs: `a1,a2|b1;a3|b2,b3`."""
        a_at = np.arange(len(a)) + (np.cumsum(b_n) - b_n)[a_group]
        b_at = np.arange(len(b)) + np.cumsum(a_n)[b_group]
        ids, sign = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[a_at], ids[b_at] = a, b
        sign[a_at], sign[b_at] = np.where(a_last, ord("|"), ord(",")), np.where(b_last, ord(";"), ord(","))
        size = self.n_digits[ids]
        cells = self.digits[ids]
        cells[np.arange(len(ids)), size] = sign
        flat = cells[np.arange(cells.shape[1]) <= size[:, None]]
        off = np.append(0, np.cumsum(size + 1))[a_off + b_off]
        data = flat.tobytes()
        return [data[s : e - 1] for s, e in zip(off[:-1], off[1:], strict=True)]

    def _links(self, a, b, a_group, a_n, b_n, doc, n):
        wide = a_n * b_n > WIDE
        b_start, a_start = np.cumsum(b_n) - b_n, np.cumsum(a_n) - a_n
        of = ~wide[a_group]
        group = a_group[of]
        times = b_n[group]
        end = np.cumsum(times)
        inner = np.arange(end[-1] if len(end) else 0) - np.repeat(end - times, times)
        cell = self.place[a[of]] * self.width
        key = (np.repeat(cell, times) + b[np.repeat(b_start[group], times) + inner]) * n + np.repeat(doc[group], times)
        key.sort()
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
        key, many = key[head], np.diff(np.append(head, len(key)))
        keys, numbers = [key], [many]
        for g in np.flatnonzero(wide):
            x, x_n = np.unique(self.place[a[a_start[g] : a_start[g] + a_n[g]]], return_counts=True)
            y, y_n = np.unique(b[b_start[g] : b_start[g] + b_n[g]], return_counts=True)
            keys.append(((x[:, None] * self.width + y) * n + doc[g]).ravel())
            numbers.append((x_n[:, None] * y_n).ravel())
        if len(keys) > 1:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            many = np.zeros(len(key), np.int64)
            np.add.at(many, at, np.concatenate(numbers))
        return np.stack((key // n, key % n, many))


_META = "array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>"
_LINKS = f"batch long, stripe int, links long, cell binary, n binary, doc binary, many binary, docs {_META}"


def _linked(a_file, b_file, stripes: int):
    """A row of digests for each slice of texts (stripe -1), and one of its links for each stripe."""

    def work(batches):
        aligner = Aligner(ByteLevel(a_file.value), Pieces(b_file.value), stripes)
        block = aligner.rows * aligner.width
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for t in texts_of(b.column("text"), SLICE):
                counts, digest, (cell, doc, many) = aligner.align([t.bytes(i) for i in range(len(t))])
                docs = [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), (ids[t.first + i], *counts[:, i].tolist(), digest[i]), strict=True)) for i in range(len(t))]
                rows = [(number, -1, 0, None, None, None, None, docs)]
                edge = np.searchsorted(cell, np.arange(stripes + 1) * block)
                for s in np.flatnonzero(np.diff(edge)):
                    own = slice(edge[s], edge[s + 1])
                    c = cell[own] - s * block
                    head = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
                    rows.append((number, int(s), len(c), packed(c[head]), packed(np.diff(np.append(head, len(c)))), packed(doc[own]), packed(many[own]), None))
                number += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["batch", "stripe", "links", "cell", "n", "doc", "many", "docs"])

    return work


def _counted(rows: int, width: int, best: bool):
    """Add the pairs of each stripe into its block; rows come sorted by stripe.  ``best``: say which are their row's maximum."""

    def work(batches):
        block, last, out = np.zeros(rows * width, np.int64), None, []

        def end() -> pa.RecordBatch:
            cell = np.flatnonzero(block)
            n = block[cell]
            columns = [pa.array([last], pa.int32()), pa.array([packed(cell)], pa.binary()), pa.array([packed(n)], pa.binary())]
            if best:
                most = block.reshape(rows, width).max(axis=1)
                columns.append(pa.array([packed((n == most[cell // width]).astype(np.uint8))], pa.binary()))
            block[cell] = 0
            return pa.RecordBatch.from_arrays(columns, ["stripe", "cell", "n", "best"][: len(columns)])

        for b in batches:
            for stripe, cell, n in zip(b.column("stripe").to_pylist(), b.column("cell").to_pylist(), b.column("n").to_pylist(), strict=True):
                if stripe != last:
                    if last is not None:
                        yield end()
                    last = stripe
                np.add.at(block, unpacked(cell), unpacked(n))
        if last is not None:
            yield end()

    return work


def _scored(key, links: pa.Table, counts: pa.Table) -> pa.Table:
    """Of each slice's links in this part: how many are best, and the sum of their counts, by document."""
    out = []
    if counts.num_rows:
        cells, n, best = (unpacked(counts[c][0].as_py()) for c in ("cell", "n", "best"))
        for i in range(links.num_rows):
            at = np.searchsorted(cells, unpacked(links["cell"][i].as_py()))
            at = np.repeat(at, unpacked(links["n"][i].as_py()))
            doc, many = unpacked(links["doc"][i].as_py()), unpacked(links["many"][i].as_py())
            sums = np.zeros((2, int(doc.max()) + 1), np.int64)
            np.add.at(sums[0], doc, many * best[at])
            np.add.at(sums[1], doc, many * n[at])
            some = np.flatnonzero(sums[1])
            out.append((links["batch"][i].as_py(), packed(some), packed(sums[0, some]), packed(sums[1, some])))
    return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), *[pa.binary()] * 3))], ["batch", "doc", "n_best", "sum"])


def _gathered(key, docs: pa.Table, scores: pa.Table) -> pa.Table:
    """The documents of a slice with the sums of their scores over all stripes."""
    rows = docs["docs"][0].as_py()
    sums = np.zeros((2, len(rows)), np.int64)
    for doc, n_best, total in zip(*(scores[c].to_pylist() for c in ("doc", "n_best", "sum")), strict=True):
        at = unpacked(doc)
        sums[0, at] += unpacked(n_best)
        sums[1, at] += unpacked(total)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
    columns = [pa.array([r[c] for r in rows], pa.int64()) for c in names]
    return pa.Table.from_arrays([*columns, pa.array(sums[0]), pa.array(sums[1]), pa.array([r["groups_sha256"] for r in rows], pa.string())], [*names, "n_best", "count_sum", "groups_sha256"])


def _files(docs: DataFrame, a_path: str | None, b_path: str | None):
    """Both vocabularies' files, broadcast: a few MB whatever the corpus."""
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        a, b = f.read(), g.read()
    spark = docs.sparkSession.sparkContext
    return len(ByteLevel(a).pieces), len(Pieces(b).pieces), spark.broadcast(a), spark.broadcast(b)


def _counts(docs: DataFrame, a_path: str | None, b_path: str | None, stripes: int, part: int):
    n_a, n_b, a_file, b_file = _files(docs, a_path, b_path)
    rows, shuffles = -(-n_a // stripes), partitions(docs)
    links = written(texts(docs).mapInArrow(_linked(a_file, b_file, stripes), _LINKS))
    total = links.where("stripe >= 0").agg(F.sum("links")).first()[0] or 0
    salts = max(1, math.ceil(total / (part * stripes)))
    own = links.where("stripe >= 0").withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int"))
    some = own.select("stripe", "salt", "cell", "n").repartition(shuffles, "stripe", "salt").sortWithinPartitions("stripe").select("stripe", "cell", "n").mapInArrow(_counted(rows, n_b, False), "stripe int, cell binary, n binary")
    counts = written(some.repartition(shuffles, "stripe").sortWithinPartitions("stripe").mapInArrow(_counted(rows, n_b, True), "stripe int, cell binary, n binary, best binary"))
    return links, own, counts, salts, rows, n_b


def token_alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, stripes: int = STRIPES, part: int = PART) -> DataFrame:
    """Per document its tokens, groups, links, links whose pair is its first id's most frequent, the sum of the pairs' counts, and a digest of the groups."""
    links, own, counts, salts, _, _ = _counts(docs, a_path, b_path, stripes, part)
    spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    scores = own.select("stripe", "salt", "batch", "cell", "n", "doc", "many").groupBy("stripe", "salt").cogroup(spread.groupBy("stripe", "salt")).applyInArrow(lambda k, x, y: _scored(k, x, y), "batch long, doc binary, n_best binary, sum binary")
    meta = links.where("stripe = -1").select("batch", "docs")
    return meta.groupBy("batch").cogroup(scores.groupBy("batch")).applyInArrow(lambda k, x, y: _gathered(k, x, y), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def best_partners(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, stripes: int = STRIPES, part: int = PART) -> DataFrame:
    """a_id, b_id and n of the pairs that most documents link for their a_id, ties included."""
    _, _, counts, _, _, width = _counts(docs, a_path, b_path, stripes, part)

    def pairs(batches):
        for b in batches:
            for stripe, cell, n, best in zip(*(b.column(c).to_pylist() for c in ("stripe", "cell", "n", "best")), strict=True):
                top = unpacked(best) == 1
                cell, n = unpacked(cell)[top], unpacked(n)[top]
                yield pa.RecordBatch.from_arrays([pa.array(cell // width * stripes + stripe), pa.array(cell % width), pa.array(n)], ["a_id", "b_id", "n"])

    return counts.mapInArrow(pairs, "a_id long, b_id long, n long")
