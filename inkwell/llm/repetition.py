"""Quality rules from repetition coverage.

Rolling hashes of several n-gram lengths are computed in numpy over each whole
text; a rule fails when the characters inside repeated n-grams, or inside
repeated lines, are too large a share of the characters in words, or repeated
lines of all lines.  The limits are the published ones of the Gopher rules (Rae
et al. 2021), at any length of text.  The characters counted are those in words;
an n-gram of 5 to 10 words or a line counts from its second occurrence on, and a
character that several n-grams cover counts once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .common import small_batches, text_bytes

#: Largest share of word characters in the most frequent n-gram.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest share of word characters inside n-grams equal to an earlier one.
DUPLICATE_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters inside lines equal to an earlier line, and largest
#: share of such lines among all lines that hold a word.
LINE_LIMIT, LINES_LIMIT = 0.20, 0.30
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT_WINDOW = 3
SYMBOLS = b"#*$%&|<>"
BASE = np.uint64(0x9E3779B97F4A7C15)

_OTHER, _CONTINUED, _SPACE, _SYMBOL = range(4)
_CLASS = np.zeros(256, dtype=np.int8)
_CLASS[0x80:0xC0] = _CONTINUED
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[list(SYMBOLS)] = _SYMBOL

SCHEMA = StructType(
    [StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [StructField("base_failed", BooleanType()), StructField("kept", BooleanType())]
    + [StructField(n, DoubleType()) for n in ("top_share", "duplicate_share", "line_share")]
)


def _covered(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Words inside a window of ``width`` that begins at a true entry of ``starts``."""
    step = np.zeros(n + 1, dtype=np.int32)
    step[: len(starts)] += starts
    step[width : width + len(starts)] -= starts
    return np.cumsum(step[:n]) > 0


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which keys occur twice or more, the number of each, the counts by number and
    the first place of each number."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return counts[inverse] > 1, inverse, counts, first


def measure(text: bytes | None) -> tuple:
    """The values of ``SCHEMA`` for one text; null counts as a text without words."""
    if not text:
        return (0, 0, 0, 0, 0, True, False, 0.0, 0.0, 0.0)
    kinds = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=4)
    word_chars = len(text) - int(kinds[_CONTINUED]) - int(kinds[_SPACE])
    words = text.split()
    n = len(words)
    seen: set[bytes] = set()
    lines = dup_lines = line_chars = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup_lines += 1
                line_chars += len(line.decode("utf-8", "replace"))
            else:
                seen.add(line)
    if n == 0:
        return (0, word_chars, int(kinds[_SYMBOL]), dup_lines, 0, True, False, 0.0, 0.0, 0.0)
    ids: dict[bytes, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    repeat_words = 0
    if n >= REPEAT_WINDOW:
        # exact: pairs are numbered before the third word is added
        pairs = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)[1]
        again = _repeats(pairs[:-1] * len(ids) + seq[2:])[0]
        if again.any():
            repeat_words = int(_covered(again, n, REPEAT_WINDOW).sum())
    base_failed = n < MIN_WORDS or 100 * repeat_words > MAX_REPEAT_PERCENT * n
    chars = np.array([len(w) for w in ids], dtype=np.int64) if kinds[_CONTINUED] == 0 else np.array([len(w.decode("utf-8", "replace")) for w in ids], dtype=np.int64)
    sizes = chars[seq]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    total = max(1, int(ends[-1]))
    mixed = (seq.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    mixed ^= mixed >> np.uint64(31)
    rolled, top, duplicate, fails = mixed, 0.0, 0.0, False
    for width in range(2, max(DUPLICATE_LIMITS) + 1):
        if n < width:
            break
        rolled = rolled[:-1] * BASE + mixed[width - 1 :]
        again, inverse, counts, first = _repeats(rolled)
        if not again.any():
            break  # longer n-grams repeat only where shorter ones do
        if width in TOP_LIMITS:
            most = int(counts.argmax())
            chars_in = int(sizes[_covered(inverse == most, n, width)].sum())
            top = max(top, chars_in / total)
            fails |= chars_in > TOP_LIMITS[width] * total
        elif width in DUPLICATE_LIMITS:
            again[first] = False  # what is said once is no repetition
            chars_in = int(sizes[_covered(again, n, width)].sum())
            duplicate = max(duplicate, chars_in / total)
            fails |= chars_in > DUPLICATE_LIMITS[width] * total
    line_share = line_chars / max(1, len(text) - int(kinds[_CONTINUED]))
    fails |= line_share > LINE_LIMIT or dup_lines > LINES_LIMIT * lines
    return (n, word_chars, int(kinds[_SYMBOL]), dup_lines, repeat_words, bool(base_failed), not (base_failed or fails), top, duplicate, line_share)


@F.pandas_udf(SCHEMA)
def _measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(x) for x in texts], columns=SCHEMA.names)


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns of ``SCHEMA``, one row for each row of ``docs``.

    Null, empty and blank texts have no words, fail the base rule and are not
    kept.  Repeated rows give repeated rows; ids may be null; an empty table
    gives no rows; other columns are not read.  Texts of any length are read whole.
    """
    small_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), _measures(text_bytes(F.col(text_col))).alias("m"))
    return found.select("doc_id", "m.*")


def keep_varied(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes every rule.

    Rows with a null, empty or short text go (the base rule); repeated rows stay or
    go together; an empty table gives an empty one; a column may have any name.
    """
    small_batches(docs.sparkSession)
    return docs.filter(_measures(text_bytes(F.col(text_col)))["kept"])
