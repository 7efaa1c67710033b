"""Token counts under a unigram model, by dynamic programming over a trie.

A text's pre-tokens are its words behind a marker.  Each task inserts the
distinct pre-tokens that it meets in a trie.  A node stands for a prefix and
keeps the prefix's forward score, the best sum of piece scores over all ways to
cut it, with that cut's number of tokens; it is computed once, from the nodes
above it, however many pre-tokens share the prefix.  A pre-token's count is
stored at its terminal node, and a text's count is the sum over its words.

The vocabulary is that of a SentencePiece file.  Its merge ranks stand in for
frequencies, since tokenizers are never trained here: the piece of rank r gets
the score -ln(r + 2) - ln(ln(V)), a Zipf distribution over V pieces.  A
character that no piece covers costs its UTF-8 bytes, one byte piece each.

A trie that would have more than ``most_nodes`` nodes is dropped and begun anew.
A pre-token of over ``long_word`` characters shares little with others and stays
out of the trie: the same recurrence runs over it with the scores of the last
places alone, as many as the longest piece has characters.  Both bounds limit
memory, whatever the texts, and change no count.

Defined results
---------------
* Null, empty and white-space texts: 0 tokens, 0 pre-tokens.
* Words are split at ASCII white space and keep their case.
* Of cuts with equal scores the one with fewer tokens counts.
* Repeated rows give equal results; an empty table gives an empty result.
* Further columns pass through; ValueError is raised if one is named like an output.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WORD

MARK = "▁"
WORDS = re.compile(WORD)


def vocabulary(model_file: str) -> tuple[dict[str, float], float]:
    """Piece scores, and the score of one byte piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = {}
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = model.get_score(i)
    order = sorted(pieces, key=lambda p: (-pieces[p], p))
    norm = math.log(math.log(len(order) + 2))
    scores = {p: -math.log(r + 2) - norm for r, p in enumerate(order)}
    return scores, -math.log(len(order) + 2) - norm


class Trie:
    """Edges as one table from (node, character) to node; each node's forward score and tokens in arrays."""

    def __init__(self, scores: dict[str, float], byte_score: float, most_nodes: int, long_word: int = 1_000):
        # Every end of a piece, with the piece's score or None: once a string isn't among them, no longer piece ends so.
        self.ends: dict[str, float | None] = {p[i:]: None for p in scores for i in range(1, len(p))}
        self.ends.update(scores)
        self.longest = max(map(len, scores), default=1)
        self.byte_score, self.most, self.long = byte_score, most_nodes, long_word
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.forward, self.tokens = array("d", [0.0]), array("q", [0])
        self.terminal: dict[str, int] = {}

    def count(self, token: str) -> int:
        """Tokens of a pre-token; inserted if new."""
        if len(token) > self.long:
            return self._passed(token)
        found = self.terminal.get(token)
        return self._insert(token) if found is None else found

    def _passed(self, token: str) -> int:
        """Tokens of a long pre-token, with the forward scores and tokens of the last ``longest`` places."""
        size, ends = self.longest, self.ends
        forward, tokens = [0.0] * size, [0] * size  # of place i at i % size
        best, fewest = 0.0, 0
        for end, char in enumerate(token, 1):
            width = len(char.encode("utf-8", "surrogatepass"))
            best, fewest = best + width * self.byte_score, fewest + width
            for start in range(end - 1, max(-1, end - size - 1), -1):
                score = ends.get(token[start:end], False)
                if score is False:
                    break
                if score is not None:
                    way, n = forward[start % size] + score, tokens[start % size] + 1
                    if way > best or way == best and n < fewest:
                        best, fewest = way, n
            forward[end % size], tokens[end % size] = best, fewest
        return fewest

    def _insert(self, token: str) -> int:
        if len(self.forward) + len(token) > self.most:
            self.clear()
        node, path, edges, ends, forward, tokens = 0, [0], self.edges, self.ends, self.forward, self.tokens
        for end, char in enumerate(token, 1):
            edge = node << 21 | ord(char)
            below = edges.get(edge)
            if below is None:
                width = len(char.encode("utf-8", "surrogatepass"))
                best, fewest = forward[node] + width * self.byte_score, tokens[node] + width
                for start in range(end - 1, -1, -1):
                    score = ends.get(token[start:end], False)
                    if score is False:
                        break
                    if score is not None:
                        at = path[start]
                        way, n = forward[at] + score, tokens[at] + 1
                        if way > best or way == best and n < fewest:
                            best, fewest = way, n
                below = edges[edge] = len(forward)
                forward.append(best)
                tokens.append(fewest)
            node = below
            path.append(node)
        if len(token) <= 64:
            self.terminal[token] = tokens[node]
        return tokens[node]


def count(docs: DataFrame, model_file: str, text_col: str = "text", most_nodes: int = 1_000_000, long_word: int = 1_000) -> DataFrame:
    """The input with n_pretokens and n_tokens (long)."""
    if clash := {"n_pretokens", "n_tokens"} & set(docs.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*vocabulary(model_file), most_nodes, long_word)
        known = trie.terminal
        for batch in batches:
            words, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(at)):
                found = total = 0
                for place in WORDS.finditer(text.as_py() or ""):
                    word = MARK + place[0]
                    n = known.get(word)
                    if n is None:
                        n = trie.count(word)
                        known = trie.terminal
                    found += 1
                    total += n
                words[i], sums[i] = found, total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words), pa.array(sums)], names=[*batch.schema.names, "n_pretokens", "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())]))
