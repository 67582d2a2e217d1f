"""Token counts by count-only Viterbi over a unigram vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = re.compile("▁+[^▁]*|^[^▁]+")
UNKNOWN_PENALTY = 10.0
#: Units whose counts a task remembers; beyond it starts anew.
MEMO = 400_000


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """Aho-Corasick automaton of the normal pieces with their scores, and the score of an unknown character.

    Control, unknown and byte pieces match no text. Pieces must hold word-start marks only
    at their start; then the best path of a text is made of the best paths of its units
    (runs of marks with what follows), and the units can be counted one by one.
    """
    import ahocorasick
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found, least = ahocorasick.Automaton(), 0.0
    for i in range(model.get_piece_size()):
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"a piece spans units: {piece!r}")
            found.add_word(piece, (len(piece), score))
            least = min(least, score)
    found.make_automaton()
    return found, least - UNKNOWN_PENALTY


def count_unit(unit: str, automaton, unknown: float) -> tuple[int, int]:
    """Pieces on the best path, and bytes of them that stand for unknown characters.

    Of paths with equal scores to a place the one whose last piece starts first wins, as
    a left-to-right search that only replaces on a larger score decides. A character that
    is no piece itself may be unknown: it costs ``unknown`` and counts as its UTF-8 bytes.
    """
    n = len(unit)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for end, (length, score) in automaton.iter(unit):
        ends[end].append((length, score))
    best, pieces, spare = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for end in range(n):
        top, take, single = None, None, False
        for length, score in sorted(ends[end], reverse=True):  # from the earliest start
            start = end + 1 - length
            single |= length == 1
            if top is None or best[start] + score > top:
                top, take = best[start] + score, (start, 1, 0)
        if not single and (top is None or best[end] + unknown > top):
            size = len(unit[end].encode("utf-8", "surrogatepass"))
            top, take = best[end] + unknown, (end, size, size)
        best[end + 1], (start, add, lost) = top, take
        pieces[end + 1], spare[end + 1] = pieces[start] + add, spare[start] + lost
    return pieces[n], spare[n]


def counter(path: str):
    """For ``mapInPandas``: texts' counts with a bounded memory of units."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, unknown = vocabulary(path)
        memo: dict[str, tuple[int, int]] = {}
        for batch in batches:
            pieces, spare = [], []
            for text in batch["_text"]:
                p = s = 0
                if text:
                    for unit in UNITS.findall("▁" + text.replace(" ", "▁")):
                        got = memo.get(unit)
                        if got is None:
                            if len(memo) >= MEMO:
                                memo.clear()
                            got = count_unit(unit, automaton, unknown)
                            if len(unit) <= 64:
                                memo[unit] = got
                        p, s = p + got[0], s + got[1]
                pieces.append(p)
                spare.append(s)
            yield pd.DataFrame({"_id": batch["_id"], "n_chars": batch["n_chars"], "n_tokens": pieces, "n_fallback": spare}).astype({"n_tokens": "int64", "n_fallback": "int64"})

    return run


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text under a unigram vocabulary, without making the tokens.

    Returns ``doc_id, n_chars, n_tokens, n_fallback``, one row per input row: code points,
    tokens, and those among the tokens that are bytes of unknown characters. Spaces become
    word-start marks and a mark is put before a text that isn't empty. Null and empty
    texts have 0 tokens. Rows may repeat; nothing is shuffled; an empty table gives an
    empty result. ``vocabulary_path`` is a SentencePiece model file on every machine.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.char_length(text).cast("long").alias("n_chars"))
    kind = dict(docs.dtypes)[id_col]
    out = rows.mapInPandas(counter(vocabulary_path), f"_id {kind}, n_chars long, n_tokens long, n_fallback long")
    return out.withColumnRenamed("_id", id_col)
