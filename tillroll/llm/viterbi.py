"""Token counts of a unigram tokenizer, without making the tokens.

For every word an Aho-Corasick automaton enumerates the vocabulary's matches by their end;
dynamic programming over the ends carries the best score and the number of pieces on its path.
The tie rules are those of the `tokenizers` library's unigram model: at an end the longest match
is tried first and only a strictly better score replaces it; a character that is no piece of its
own may be unknown at 10 below the lowest score, and unknown characters become one piece for
each UTF-8 byte. Words start at each space, which is replaced by U+2581.

The public vocabulary file here is of a pair-merging tokenizer, which has an order but no
probabilities; scores are those of Zipf's law over this order. Another file is a parameter.

Defined results: a null or empty text has no tokens and the score 0; repeated rows each count;
an empty table gives an empty result; extra columns are ignored. Words are counted once a task,
in a cache of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.columns import text_of

SPACE = "▁"
UNKNOWN = 10.0
#: Words after which a task's cache starts anew; longer words aren't kept.
CACHE, LONGEST = 500_000, 64


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file in their order, with -ln(place * H) as scores."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    total = math.log(math.fsum(1 / i for i in range(1, n + 1)))
    return [(model.id_to_piece(i), -math.log(i + 1) - total) for i in range(n)]


class PieceCounter:
    """Pieces and best scores of words and texts."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN
        self.cache: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        best, counts = [0.0], [0]
        matches = self.automaton.iter(word)
        end, match = next(matches, (-1, (0, 0.0)))
        for at, char in enumerate(word):
            top, count, single = -math.inf, 0, False
            while end == at:  # longest first
                length, score = match
                if (now := score + best[at + 1 - length]) > top:
                    top, count = now, counts[at + 1 - length] + 1
                single |= length == 1
                end, match = next(matches, (-1, match))
            if not single and (now := self.unknown + best[at]) > top:
                top, count = now, counts[at] + len(char.encode("utf-8", "surrogatepass"))
            best.append(top)
            counts.append(count)
        return counts[-1], best[-1]

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(" ", SPACE)
        words = (text[1:] if text[0] == SPACE else text).split(SPACE)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        count, total = 0, 0.0
        for word in words:
            found = cache.get(word)
            if found is None:
                found = self.word(SPACE + word)
                if len(word) <= LONGEST:
                    cache[word] = found
            count += found[0]
            total += found[1]
        return count, total


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_chars, n_tokens, score, counted where the rows lie."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = PieceCounter(zipf_vocabulary(vocabulary))
        for frame in frames:
            found = [counter.text(t) for t in frame["text"]]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64"), "n_chars": [len(t) for t in frame["text"]],
                "n_tokens": [n for n, _ in found], "score": [s for _, s in found],
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInPandas(count, "doc_id long, n_chars long, n_tokens long, score double")
