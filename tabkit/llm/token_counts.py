"""Token counts under a unigram model, by dynamic programming over shared prefixes.

Method: distinct pre-tokens are inserted in a trie that a task keeps.  A node
stores the forward score of its prefix (the least cost of cutting it into
pieces, and the number of pieces then), which is computed once, when the node
is made, for all pre-tokens that share the prefix; the count at a pre-token's
end is stored and summed over its documents.

Pieces are the byte strings of a public vocabulary.  It gives ranks only, so
unless costs are given, piece r costs -log of a Zipf weight 1 / (r + 2.7), in
whole millionths; equal costs go to fewer pieces.  Every byte is a piece, so
every text can be cut.

Defined results: a null or empty text has no pre-tokens and no tokens; a very
long text is one row, whose pre-tokens a task holds; repeated rows are counted
each; an empty table gives an empty one; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .frames import texts
from .textbytes import texts_of

SLICE = 4 << 20
#: Pre-tokens and trie nodes that a task keeps; beyond, it forgets and starts again.
REMEMBERED, NODES = 400_000, 1_000_000
_UNIT = 1 << 24  # a cost in its high bits, pieces in its low ones


def vocabulary(path: str) -> list[bytes]:
    """Pieces by rank, of a file with lines of a base64 string and a rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return sorted(ranks, key=ranks.__getitem__)


class Counter:
    """Counts of pre-tokens, from a trie of them and one of reversed pieces."""

    def __init__(self, pieces: list[bytes], costs: Sequence[int] | None = None):
        total = math.log(sum(1 / (r + 2.7) for r in range(len(pieces))))
        self.root: dict = {}
        for r, piece in enumerate(pieces):  # a trie of reversed pieces; the cost is at -1
            node = self.root
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[-1] = (costs[r] if costs is not None else round(1e6 * (math.log(r + 2.7) + total))) * _UNIT + 1
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.child: dict[int, int] = {}  # node * 256 + byte: node
        self.score = [0]

    def learn(self, tokens: set[str]) -> None:
        """Insert new pre-tokens; only nodes that are new are scored."""
        if len(self.known) + len(tokens) > REMEMBERED or len(self.score) > NODES:
            self.forget()
        known, child, score, root = self.known, self.child, self.score, self.root
        for text in tokens:
            if text in known:
                continue
            token, node, path = text.encode(), 0, [0]
            for end, c in enumerate(token):
                to = child.get(node << 8 | c)
                if to is None:
                    piece, at, best = root, end, None
                    while at >= 0:
                        piece = piece.get(token[at])
                        if piece is None:
                            break
                        cost = piece.get(-1)
                        if cost is not None:
                            cost += path[at]
                            if best is None or cost < best:
                                best = cost
                        at -= 1
                    to = child[node << 8 | c] = len(score)
                    score.append(best)
                node = to
                path.append(score[node])
            known[text] = score[node] % _UNIT


def _counted(pieces, pattern: str, costs: Sequence[int] | None):
    def work(batches):
        counter, split = Counter(pieces.value, costs), regex.compile(pattern).findall
        for b in batches:
            for t in texts_of(b.column("text"), SLICE):
                tokens = [split(t.bytes(i).decode()) for i in range(len(t))]
                counter.learn(set().union(*tokens))
                of = counter.known.__getitem__
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(t.first, len(t)), pa.array([len(x) for x in tokens], pa.int64()), pa.array([sum(map(of, x)) for x in tokens], pa.int64())],
                    ["doc_id", "n_pretokens", "n_tokens"],
                )

    return work


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None, costs: Sequence[int] | None = None) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of each row; ``costs`` of the pieces by rank, in whole millionths, take the place of Zipf's."""
    known = default_vocabulary()
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path or known[0]))
    return texts(docs).mapInArrow(_counted(pieces, pattern or known[1], costs), "doc_id long, n_pretokens long, n_tokens long")
