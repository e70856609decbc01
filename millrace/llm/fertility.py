"""Quality rules: fixed text rules, and tokeniser fertility with bands per language.

Two public vocabularies are applied to every word of a text: one with byte fallback, one of bytes for
many languages. Characters per token of both, the share of byte-fallback tokens and token entropy (over
windows of like length) are compared with bands that all documents of the same
language give.
"""

from __future__ import annotations

import base64
from collections import Counter
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A band reaches so many interquartile ranges beyond the quartiles.
WIDTH = 3.0
#: Tokens over which entropy is taken: entropy grows with length, so only windows of like length compare.
WINDOW = 64
#: Up to so many tokens bands are wider, as readings of short texts scatter more.
STEADY = 400
#: Decimals of a reading in the histogram that quartiles are taken from: exact, whatever the partitions, and bounded.
DECIMALS = 5
VOCABULARY, BYTES = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
#: Words remembered by each worker process, in each of two generations, and bytes of the longest such word.
REMEMBERED, LONGEST = 300_000, 64

MEASURES = ["chars_per_token", "byte_share", "entropy", "chars_per_byte_token"]
_FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("entropy", pa.float64()),
    ("n_byte_tokens", pa.int64()),
]
_KIND = pa.struct(_FIELDS)
READINGS = "struct<" + ",".join(f"{n}:{'double' if t == pa.float64() else 'bigint'}" for n, t in _FIELDS) + ">"


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    total = covered = 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


class WordPieces:
    """Token ids of single words, and how many tokens they are in the vocabulary of bytes, remembered while they fit."""

    def __init__(self, path: str, bytes_path: str):
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        with open(bytes_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.bytes_model = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.new: tuple[dict[bytes, list[int]], dict[bytes, int]] = {}, {}
        self.old = self.new

    def learn(self, words: set[bytes]) -> list[bytes]:
        """Makes ids ready for words; those of the last two generations are kept. Returns the words met first."""
        if len(self.new[0]) > REMEMBERED:
            self.old, self.new = self.new, ({}, {})
        (ids, sizes), (old_ids, old_sizes) = self.new, self.old
        missing = []
        # Word by word: a set less the keys of a dict walks through the dict.
        for w in words:
            if w in ids:
                continue
            if w in old_ids:
                ids[w], sizes[w] = old_ids[w], old_sizes[w]
            else:
                missing.append(w)
        if missing:
            texts = [w.decode("utf-8", "replace") for w in missing]
            ids.update(zip(missing, self.model.encode(texts, num_threads=1)))
            # As they stand in a text, behind a space.
            sizes.update(zip(missing, map(len, map(self.bytes_model.encode_ordinary, [" " + t for t in texts]))))
        return missing

    def ids(self, words: list[bytes]) -> tuple[list[int], int]:
        """The ids of all words, and how many tokens of bytes they are. Long words are not remembered."""
        met = self.learn(set(words))
        ids, sizes = self.new
        out = list(chain.from_iterable(map(ids.__getitem__, words))), sum(map(sizes.__getitem__, words))
        for w in met:
            if len(w) > LONGEST:
                del ids[w], sizes[w]
        return out


_pieces: dict[tuple[str, str], WordPieces] = {}


def windowed_entropy(ids: np.ndarray) -> float:
    """Mean entropy of the windows of WINDOW tokens, as a share of the most possible; the last window overlaps its neighbour.

    Texts with fewer tokens are one window.
    """
    size = min(len(ids), WINDOW)
    if size < 2:
        return 0.0
    windows = ids[: len(ids) // size * size].reshape(-1, size)
    if len(ids) % size:
        windows = np.vstack([windows, ids[-size:]])
    windows = np.sort(windows, axis=1)
    first = np.ones(windows.shape, dtype=bool)
    first[:, 1:] = windows[:, 1:] != windows[:, :-1]
    # Each window starts a run, so runs do not cross windows.
    runs = np.diff(np.r_[np.flatnonzero(first), windows.size])
    return float(1 - (runs * np.log2(runs)).sum() / (windows.size * np.log2(size)))


def reading(text: str, pieces: WordPieces) -> dict:
    """The base counts of a text and its tokens under a vocabulary."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    ids, byte_tokens = pieces.ids(words)
    ids = np.array(ids, dtype=np.int64)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, BLANKS)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_tokens": len(ids),
        "n_bytes": int(pieces.is_byte[ids].sum()),
        "entropy": windowed_entropy(ids),
        "n_byte_tokens": byte_tokens,
    }


def readings(text: Column, vocabulary: str | None = None, bytes_vocabulary: str | None = None) -> Column:
    """The counts of `reading` for each text, as a struct; null counts as empty."""
    paths = vocabulary or public_tokenizers.path(VOCABULARY), bytes_vocabulary or public_tokenizers.path(BYTES)

    @F.arrow_udf(READINGS)
    def read(texts: pa.Array) -> pa.Array:
        if paths not in _pieces:
            _pieces[paths] = WordPieces(*paths)
        return pa.array([reading(t.as_py() or "", _pieces[paths]) for t in texts], type=_KIND)

    return read(text)


def base_failed() -> Column:
    few = F.col("n_words") < LEAST_WORDS
    return few | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def bands(measured: DataFrame) -> DataFrame:
    """Quartiles of each measure by language and how far a band reaches, from all documents that pass the base rules.

    Quartiles are exact for readings of DECIMALS decimals. Equal readings are counted by (language, measure, reading),
    summed up within tasks first; what meets for one language are its distinct readings, whose number DECIMALS
    bounds, whatever the number of documents.
    """
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(m, DECIMALS).alias("value")) for m in MEASURES]))
    good = measured.where(~F.col("base_failed")).select("band", each).where("value IS NOT NULL")
    counted = good.groupBy("band", "measure", "value").agg(F.count("*").alias("n"))
    of = Window.partitionBy("band", "measure")
    upto = counted.withColumns({"upto": F.sum("n").over(of.orderBy("value")), "all": F.sum("n").over(of)})
    # The first reading that a quarter, or three quarters, do not exceed.
    reached = lambda quarters: F.min(F.when(F.col("upto") * 4 >= F.col("all") * quarters, F.col("value")))
    quartiles = upto.groupBy("band", "measure").agg(reached(1).alias("low"), reached(3).alias("high"))
    sides = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("low", "high")]
    out = quartiles.groupBy("band").agg(*sides)
    return out.withColumns({f"{m}_wide": WIDTH * F.greatest(F.col(f"{m}_high") - F.col(f"{m}_low"), F.lit(1e-3)) for m in MEASURES})


def quality(documents: DataFrame, vocabulary: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document's doc_id, base counts, fertility readings and verdict.

    Columns in `carry` stay with their row in a struct `carried`.

    Null text counts as empty (no words: base_failed). Documents without lang
    share the band of the empty language. Bands are wider for texts of few tokens. Repeated rows give
    repeated results; a document outside any band of its language is not kept. An empty table gives no rows;
    columns of other names are not read.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in documents.columns else F.lit("")
    also = [F.struct(*carry).alias("carried")] if carry else []
    kept_with = ["carried"] * bool(carry)
    read = documents.select("doc_id", *also, lang.alias("band"), readings(F.col("text"), vocabulary).alias("r"))
    measured = read.select("doc_id", *kept_with, "band", "r.*").select(
        "*",
        F.try_divide(F.col("word_chars"), F.col("n_tokens")).alias("chars_per_token"),
        F.try_divide(F.col("n_bytes"), F.col("n_tokens")).alias("byte_share"),
        F.try_divide(F.col("word_chars"), F.col("n_byte_tokens")).alias("chars_per_byte_token"),
        base_failed().alias("base_failed"),
    )
    measured = written(measured)
    # A row for each language: Spark broadcasts it while it is small, else it splits the skewed side.
    judged = measured.join(written(bands(measured)), "band", "left")
    within, scatter = F.lit(True), F.greatest(F.lit(1.0), F.sqrt(F.try_divide(F.lit(STEADY), F.col("n_tokens"))))
    for m in MEASURES:
        reach = F.col(f"{m}_wide") * scatter
        within &= F.col(m).between(F.col(f"{m}_low") - reach, F.col(f"{m}_high") + reach)
    verdict = F.coalesce(within, F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & verdict).alias("kept"),
        "n_tokens", *MEASURES, F.col("band").alias("lang"), *kept_with,
    )
