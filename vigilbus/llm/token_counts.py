"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

A text is cut at white space; every piece of it, with a leading word mark, is a pre-token. The
distinct pre-tokens of a chunk of documents are walked as a trie, depth first: sorted, each one
shares its path with the one before up to their longest common prefix, and the forward scores of
that prefix are kept. A node's score is the best sum of piece scores over all ways to cut its
prefix, carried forward together with the pieces that are still being matched. The count at the end
of a pre-token is stored, and a document adds up the counts of its pre-tokens. Nothing is shuffled.

The vocabulary is a file of a public tokenizer, given by path and read on the driver only; a piece
scores minus the logarithm of two plus its rank. A character that no piece covers is spelt in bytes:
it counts its UTF-8 bytes, at ten less than the lowest score. Equal scores go to fewer tokens.

Defined cases: a null or empty text, or white space only, has no pre-tokens and no tokens; rows are
counted one by one; input columns called like an added one are replaced.
"""

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilbus.llm.columns import without

WORD_MARK = "▁"
UNKNOWN_BELOW = 10.0
#: Characters of text whose distinct pre-tokens make one trie.
CHUNK_CHARS = 4 << 20
#: Pre-tokens whose counts a task remembers between chunks; forgetting them costs time only.
REMEMBERED = 200_000
ADDED = ("n_pretokens", "n_tokens")
_COUNTS = pa.struct([("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])


def unigram_scores(path: str) -> dict[str, float]:
    """Piece scores from a sentencepiece file, by rank among its ordinary pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (i for i in range(model.get_piece_size()) if not (
        model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return {model.id_to_piece(i): -math.log(2 + rank) for rank, i in enumerate(ordinary)}


class PieceTrie:
    """Vocabulary as nested dictionaries: node -> (children, score or None)."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_BELOW
        self.root: list = [{}, None]
        for piece, score in scores.items():
            node = self.root
            for char in piece:
                node = node[0].setdefault(char, [{}, None])
            if piece:
                node[1] = score

    def counts(self, pretokens: list[str]) -> Iterator[tuple[str, int]]:
        """(pre-token, tokens of its best segmentation) of sorted distinct pre-tokens."""
        root = self.root
        best, many, open_pieces = [0.0], [0], [[]]
        before = ""
        for word in pretokens:
            depth = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                depth += 1
            del best[depth + 1:], many[depth + 1:], open_pieces[depth + 1:]
            for char in word[depth:]:
                score, count, going = -math.inf, 0, []
                single = root[0].get(char)
                if single is None or single[1] is None:
                    score = best[-1] + self.unknown
                    count = many[-1] + len(char.encode("utf-8", "surrogatepass"))
                for node, base, held in open_pieces[-1]:
                    after = node[0].get(char)
                    if after is not None:
                        if after[1] is not None:
                            total = base + after[1]
                            if total > score or (total == score and held + 1 < count):
                                score, count = total, held + 1
                        if after[0]:
                            going.append((after, base, held))
                if single is not None:
                    if single[1] is not None:
                        total = best[-1] + single[1]
                        if total > score or (total == score and many[-1] + 1 < count):
                            score, count = total, many[-1] + 1
                    if single[0]:
                        going.append((single, best[-1], many[-1]))
                best.append(score)
                many.append(count)
                open_pieces.append(going)
            before = word
            yield word, many[-1]


def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > CHUNK_CHARS:
            yield held
            held, size = [], 0
        held.append(text or "")
        size += len(text or "")
    if held:
        yield held


def _counter(scores: Broadcast):
    @F.arrow_udf("n_pretokens long, n_tokens long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie, known = PieceTrie(scores.value), {}
        for batch in batches:
            out = []
            for texts in _chunks(batch.to_pylist()):
                if len(known) > REMEMBERED:
                    known.clear()
                new = set()
                for text in texts:
                    new.update(text.split())
                for word, tokens in trie.counts(sorted(
                        WORD_MARK + w for w in new.difference(known))):
                    known[word[1:]] = tokens
                for text in texts:
                    words = text.split()
                    out.append({"n_pretokens": len(words),
                                "n_tokens": sum(map(known.__getitem__, words))})
            yield pa.array(out, _COUNTS)

    return count


def count_tokens(
    spark: SparkSession, docs: DataFrame, vocabulary: dict[str, float], text: str = "text"
) -> DataFrame:
    """``docs`` with n_pretokens and n_tokens. The vocabulary is broadcast: a file's pieces."""
    shared = spark.sparkContext.broadcast(vocabulary)
    docs = without(docs, *ADDED)
    return docs.withColumn("counted", _counter(shared)(F.col(text))).select(
        *docs.columns, "counted.*")
