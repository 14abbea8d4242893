"""Edit distance between two normalised texts, over words or characters.

``levenshtein`` counts characters only and its work grows with the product of
both lengths. It is used for short texts, where it is two to four times faster.
Words and long texts go to an Arrow-batched function that keeps a column of the
distance matrix in the bits of one integer (Myers 1999; Hyyro 2003) and advances
by one whole column per step. The choice is made per row from the lengths alone,
both ways are exact, and whole texts are always compared.

Between long texts the matrix is filled only where bounds leave a doubt: an
alignment word by word costs at least the distance, symbols without a partner
cost at most that, and where both agree they are the distance. Between words the
first alignment tried reads the shorter text off the longer one in order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Rows of the distance matrix held in one integer; bounds memory on long texts.
STRIP_ROWS = 4_096

# Largest product of lengths for which the built-in function is the faster one
# (measured: break-even near 200 by 200 characters).
NATIVE_CELLS = 40_000

# Most words on either side of an edited stretch before an alignment meets again,
# and the stretches in the order in which they are tried.
REACH = 6

# Words whose stretches are solved together, while the bounds disagree.
GROUPS = (0, 64, 512)
_STRETCHES = [
    stretch
    for most in range(1, REACH + 1)
    for stretch in [*((most, b) for b in range(most, -1, -1)), *((a, most) for a in range(most - 1, -1, -1))]
]


def edit_distance(left: Sequence, right: Sequence) -> int:
    """Fewest insertions, deletions and substitutions turning one sequence into the other."""
    start, left_end, right_end = 0, len(left), len(right)
    shared = min(left_end, right_end)
    while start < shared and left[start] == right[start]:
        start += 1
    while left_end > start and right_end > start and left[left_end - 1] == right[right_end - 1]:
        left_end -= 1
        right_end -= 1
    rows, columns = left[start:left_end], right[start:right_end]
    if len(rows) < len(columns):
        rows, columns = columns, rows
    if not columns:
        return len(rows)
    if len(rows) <= STRIP_ROWS:
        return _distance_in_strip(rows, columns)

    # An alignment with d edits never leaves the strip between the first and the
    # last diagonal by more than half of what d is above their distance, so a
    # band as wide as its own result is exact. What a band finds is the cost of
    # a real alignment, hence wide enough for the next attempt.
    band = max(_unmatched(rows, columns) * 5 // 4, STRIP_ROWS // 8, 1)
    while True:
        distance = _distance_in_band(rows, columns, band)
        if distance <= band:
            return distance
        band = min(2 * band, distance)


def _unmatched(rows: Sequence, columns: Sequence) -> int:
    """Symbols that find no partner whatever their order: a lower bound of the distance."""
    ours, theirs = Counter(rows), Counter(columns)
    return max((ours - theirs).total(), (theirs - ours).total())


def _distance_in_band(rows: Sequence, columns: Sequence, band: int) -> int:
    """Distance over alignments that stay where ``band`` edits can lead, strip by strip."""
    first, last, value, edge = 0, 0, 0, []
    longer = len(rows) - len(columns)
    slack = max(band - longer, 0) // 2 + 1
    for low in range(0, len(rows), STRIP_ROWS):
        high = min(low + STRIP_ROWS, len(rows))
        begin, end = max(0, low - longer - slack), min(len(columns), high + slack)
        value += sum(edge[: begin - first]) + high - low
        above = edge[begin - first :] + [1] * (end - last)
        edge = _advance_strip(rows[low:high], columns[begin:end], above)
        first, last = begin, end
    return value + sum(edge)


def _places(rows: Sequence) -> dict:
    """For each symbol the rows that hold it, as bits of one integer."""
    where: dict = {}
    for index, symbol in enumerate(rows):
        where[symbol] = where.get(symbol, 0) | (1 << index)
    return where


def _distance_in_strip(rows: Sequence, columns: Sequence) -> int:
    """Distance where one strip holds all rows: nothing but its last column is needed.

    ``level`` marks the rows where the matrix row does not go up from the last
    column to the next one. Bits above the rows never reach those below.
    """
    where = _places(rows)
    full = (1 << len(rows)) - 1
    rising, falling = full, 0
    for symbol in columns:
        match = where.get(symbol, 0)
        diagonal = ((((match & rising) + rising) ^ rising) | match | falling) if match else falling
        level = ((diagonal | rising) ^ falling) << 1
        either = diagonal | level
        rising = (((rising & diagonal) << 1) | (either ^ diagonal)) & full
        falling = (either ^ level) & full
    return len(columns) + rising.bit_count() - falling.bit_count()


def _advance_strip(rows: Sequence, columns: Sequence, above: list[int]) -> list[int]:
    """Steps along the lower edge of a strip from the steps along its upper edge.

    ``rising`` and ``falling`` mark the rows where the current matrix column goes
    up or down by one.
    """
    where = _places(rows)
    height = len(rows)
    full = (1 << height) - 1
    wide = (1 << (height + 3)) - 1
    bottom = height - 1
    rising, falling = full, 0
    below = []
    for symbol, step in zip(columns, above):
        match = where.get(symbol, 0)
        vertical = match | falling
        if step < 0:
            match |= 1
        diagonal = (((match & rising) + rising) ^ rising) | match
        up = falling | (wide ^ (diagonal | rising))
        down = rising & diagonal
        below.append(((up >> bottom) & 1) - ((down >> bottom) & 1))
        up <<= 1
        down <<= 1
        if step > 0:
            up |= 1
        elif step < 0:
            down |= 1
        rising = (down | (wide ^ ((vertical | up) & wide))) & full
        falling = up & vertical
    return below


def _stretches(left: list[str], right: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """Bounds of the stretches where an alignment of two word lists finds no equal words.

    It meets again at the nearest two equal words in a row, else at the nearest one.
    """
    i, j, left_end, right_end = 0, 0, len(left), len(right)
    while i < left_end and j < right_end:
        if left[i] == right[j]:
            i += 1
            j += 1
            continue
        single = None
        for a, b in _STRETCHES:
            if i + a < left_end and j + b < right_end and left[i + a] == right[j + b]:
                if left[i + a : i + a + 2] == right[j + b : j + b + 2]:
                    break
                single = single or (a, b)
        else:
            a, b = single or (1, 1)
        yield i, i + a, j, j + b
        i += a
        j += b
    if i < left_end or j < right_end:
        yield i, left_end, j, right_end


def _aligned_cost(ours: list[str], theirs: list[str], stretches: list[tuple[int, int, int, int]], size: int) -> int:
    """Character edits of an alignment word by word, its stretches solved in groups
    of about ``size`` words: an upper bound of the distance.
    """
    cost, group = 0, None
    for i, i_end, j, j_end in [*stretches, (len(ours),) * 2 + (len(theirs),) * 2]:
        if group is None or i - group[0] >= size or i == len(ours):
            cost += 0 if group is None else _group_cost(ours[group[0] : group[1]], theirs[group[2] : group[3]])
            group = i, i_end, j, j_end
        else:
            group = group[0], i_end, group[2], j_end
    return cost + _group_cost(ours[group[0] : group[1]], theirs[group[2] : group[3]])


def _group_cost(ours: list[str], theirs: list[str]) -> int:
    """Character edits between words that each have a space behind them.

    One more space at the end of both texts changes no distance.
    """
    gone, come = " ".join(ours), " ".join(theirs)
    if not ours or not theirs:
        return len(gone or come) + bool(ours or theirs)
    return max(len(gone), len(come)) if set(come).isdisjoint(gone) else edit_distance(gone, come)


def text_distance(left: str, right: str) -> int:
    """``edit_distance`` of the characters of two texts that hold words."""
    ours, theirs = left.split(" "), right.split(" ")
    least = _unmatched(left, right)
    stretches = list(_stretches(ours, theirs))
    for size in GROUPS:
        if size >= len(ours):
            break
        if _aligned_cost(ours, theirs, stretches, size) == least:
            return least
    return edit_distance(left, right)


def _edits_in_order(longer: list[str], shorter: list[str]) -> int | None:
    """Distance of two word lists, if the shorter one can be read off the longer in
    order, a word foreign to the longer standing for any one word; else None.

    Each foreign word needs an edit of its own and the lengths need one per word
    missing, so no alignment costs less than this one.
    """
    known, ahead, foreign = set(longer), iter(longer), 0
    for word in shorter:
        if word in known:
            if word not in ahead:
                return None
        else:
            foreign += 1
            if next(ahead, None) is None:
                return None
    return len(longer) - len(shorter) + foreign


def word_distance(left: str, right: str) -> int:
    """``edit_distance`` of the words of two texts."""
    if left == right:
        return 0
    longer, shorter = _words(left), _words(right)
    if len(longer) < len(shorter):
        longer, shorter = shorter, longer
    found = _edits_in_order(longer, shorter)
    return edit_distance(longer, shorter) if found is None else found


def _distances(left: pa.Array, right: pa.Array, distance: Callable[[str, str], int]) -> pa.Array:
    """Text by text, so that no more than one pair of a batch is held as Python objects."""
    found = (
        distance(a.as_py(), b.as_py()) if a.is_valid and b.is_valid else None
        for a, b in zip(left, right, strict=True)
    )
    return pa.array(found, pa.int64(), size=len(left))


def _words(text: str) -> list[str]:
    pieces = text.split(" ")
    return [word for word in pieces if word] if "" in pieces else pieces


@F.arrow_udf(LongType())
def _word_edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return _distances(ref, hyp, word_distance)


@F.arrow_udf(LongType())
def _long_char_edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return _distances(ref, hyp, text_distance)


def word_edits(ref: Column, hyp: Column) -> Column:
    """Word edits between two normalised texts; null when either is null.

    Equal texts are told apart in Python too: a comparison outside would carry
    both texts past the function once more, through Spark's row buffer.
    """
    return _word_edits(ref, hyp)


def char_edits(ref: Column, hyp: Column) -> Column:
    """Character edits (code points, spaces included); null when either is null."""
    short = F.length(ref).cast("bigint") * F.length(hyp) <= NATIVE_CELLS
    long_ref = F.when(~short, ref)
    long_hyp = F.when(~short, hyp)
    return F.when(short, F.levenshtein(ref, hyp).cast("bigint")).otherwise(
        _long_char_edits(long_ref, long_hyp)
    )
