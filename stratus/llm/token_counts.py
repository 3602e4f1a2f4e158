"""Token counts by trie-shared dynamic programming.

Method: the distinct pre-tokens of a task go into a trie.  The best unigram score of a prefix,
and the number of tokens on the way to it, depend on the prefix only, so each trie node computes
them once for all pre-tokens below it; a terminal node holds the count of its pre-token.  A
document's count is the sum over its pre-tokens.  Equal scores: the longer last piece wins.

Scale: a narrow map over the texts, no shuffle.  The trie of a task is begun anew when it has
``TRIE_NODES`` nodes, which bounds its memory and changes no count.  A pre-token of more than
``LONG_TOKEN`` characters (text without spaces) goes through the same programme over a window of
the longest piece's length, without nodes; its count is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import map_rows, ship_by_value
from stratus.llm.pieces import DEFAULT_MODEL, SPACE, Pieces, load_pieces

ship_by_value(__name__)

TRIE_NODES = 1_000_000
LONG_TOKEN = 4096


class CountTrie:
    def __init__(self, pieces: Pieces, most_nodes: int = TRIE_NODES):
        self.pieces, self.most_nodes = pieces, most_nodes
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]  # of each node's prefix; node 0 is the root
        self.terminal: dict[str, int] = {SPACE: len(SPACE.encode())}  # the mark itself is no space: bytes

    def insert(self, token: str) -> int:
        """Tokens of a pre-token; adds the nodes that its prefixes lack."""
        if len(self.score) >= self.most_nodes:
            self.clear()
        marked = token.replace(" ", SPACE)
        child, score, tokens, known, longest = self.child, self.score, self.tokens, self.pieces.score, self.pieces.longest
        path = [0]
        for end, char in enumerate(marked, 1):
            node = child.get((path[-1], char))
            if node is None:
                best, count = float("-inf"), 0
                for start in range(max(0, end - longest), end):
                    value = known.get(marked[start:end])
                    if value is not None and score[path[start]] + value > best:
                        best, count = score[path[start]] + value, tokens[path[start]] + 1
                if char not in known and score[path[-1]] + self.pieces.unknown > best:
                    best, count = score[path[-1]] + self.pieces.unknown, tokens[path[-1]] + len(char.encode())
                node = child[path[-1], char] = len(score)
                score.append(best)
                tokens.append(count)
            path.append(node)
        self.terminal[token] = count = tokens[path[-1]]
        return count

    def count_long(self, token: str) -> int:
        """As :meth:`insert`, but of the prefixes only those that a piece can reach back to are held."""
        known, longest = self.pieces.score, self.pieces.longest
        marked = token.replace(" ", SPACE)
        size = longest + 1
        score, tokens = [0.0] * size, [0] * size  # of the prefix of each length, by its remainder
        for end, char in enumerate(marked, 1):
            best, count = float("-inf"), 0
            for start in range(max(0, end - longest), end):
                value = known.get(marked[start:end])
                if value is not None and score[start % size] + value > best:
                    best, count = score[start % size] + value, tokens[start % size] + 1
            if char not in known and score[(end - 1) % size] + self.pieces.unknown > best:
                best, count = score[(end - 1) % size] + self.pieces.unknown, tokens[(end - 1) % size] + len(char.encode())
            score[end % size], tokens[end % size] = best, count
        return tokens[len(marked) % size]

    def count(self, pre_tokens: list[str]) -> int:
        found = 0
        for token in pre_tokens:
            if len(token) > LONG_TOKEN:
                found += self.count_long(token)
                continue
            n = self.terminal.get(token)
            found += self.insert(token) if n is None else n
        return found


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = DEFAULT_MODEL) -> DataFrame:
    """``(doc_id, n_chars, n_pre_tokens, n_tokens)`` for every row, repeated rows included.

    Null texts have null counts, empty texts zero.  Other columns are not looked at.
    """
    pieces = load_pieces(model_file)

    def make():
        trie = CountTrie(pieces)

        def fn(columns):
            chars, pre, tokens = [], [], []
            for text in columns[1]:
                found = None if text is None else pieces.pre_tokens(text)
                chars.append(None if text is None else len(text))
                pre.append(None if found is None else len(found))
                tokens.append(None if found is None else trie.count(found))
            return [columns[0], chars, pre, tokens]

        return fn

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, make, "doc_id long, n_chars long, n_pre_tokens long, n_tokens long")
