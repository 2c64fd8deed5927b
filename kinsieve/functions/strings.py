"""String similarity: Jaro-Winkler by Arrow batches, one-edit tests as expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fixed values of the measure: weight of a shared leading character, their greatest number, the least Jaro that is raised.
PREFIX_WEIGHT, PREFIX_MOST, BOOST_ABOVE = 0.1, 4, 0.7


def _codes(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, padded with 0, and their lengths."""
    size = np.array([len(v) for v in values], np.int64)
    out = np.zeros((len(values), max(1, int(size.max(initial=0)))), np.int64)
    flat = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(values)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def _jaro_winkler_block(left: list[str], right: list[str]) -> np.ndarray:
    a, na = _codes(left)
    b, nb = _codes(right)
    rows, la, lb = len(left), a.shape[1], b.shape[1]
    reach = np.maximum(np.maximum(na, nb) // 2 - 1, 0)
    hit_a, hit_b = np.zeros((rows, la), bool), np.zeros((rows, lb), bool)
    place = np.arange(lb)
    for i in range(la):
        near = (np.abs(place - i)[None, :] <= reach[:, None]) & (b == a[:, i : i + 1]) & ~hit_b & (place[None, :] < nb[:, None]) & (i < na)[:, None]
        found = near.any(axis=1)
        first = near.argmax(axis=1)
        hit_a[found, i] = True
        hit_b[found, first[found]] = True
    m = hit_a.sum(axis=1)
    # the matched characters of both, in order
    order_a, order_b = np.argsort(~hit_a, axis=1, kind="stable"), np.argsort(~hit_b, axis=1, kind="stable")
    n = min(la, lb)
    sa, sb = np.take_along_axis(a, order_a, axis=1)[:, :n], np.take_along_axis(b, order_b, axis=1)[:, :n]
    turned = ((sa != sb) & (np.arange(n)[None, :] < m[:, None])).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / na + m / nb + (m - turned) / m) / 3, 0.0)
    same = (a[:, : min(n, PREFIX_MOST)] == b[:, : min(n, PREFIX_MOST)]) & (a[:, : min(n, PREFIX_MOST)] > 0)
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    return np.where(jaro > BOOST_ABOVE, jaro + prefix * PREFIX_WEIGHT * (1 - jaro), jaro)


def _reaches(na: int) -> np.ndarray:
    """Bits of the places that each character of a string of ``na`` may match, by the other's length (0 to 64)."""
    full = (1 << 64) - 1
    reach = [max(max(na, nb) // 2 - 1, 0) for nb in range(65)]
    return np.array([[((1 << (i + r + 1)) - 1) & full & ~((1 << max(i - r, 0)) - 1) for r in reach] for i in range(na)], np.uint64).reshape(na, 65)


class Places:
    """Strings to compare others with: the places of each character in those of up to 64 characters are the bits of one number."""

    def __init__(self, texts: Sequence[str]):
        self.texts = np.empty(len(texts), object)
        self.texts[:] = texts
        is_short = np.array([len(v) <= 64 for v in texts], bool)
        self.short, self.long = np.flatnonzero(is_short), np.flatnonzero(~is_short)
        self.sizes = np.array([len(texts[k]) for k in self.short], np.int64)
        word = _word(self.sizes)
        places: dict[str, np.ndarray] = {}
        for j, k in enumerate(self.short.tolist()):
            for p, ch in enumerate(texts[k]):
                if ch not in places:
                    places[ch] = np.zeros(len(self.short), word)
                places[ch][j] |= word(1 << p)
        self.letter = {ch: k for k, ch in enumerate(places)}
        self.bits = np.stack([*places.values(), np.zeros(len(self.short), word)])  # the last: characters that none of them has

    def take(self, at: np.ndarray) -> Places:
        """Those at ``at``."""
        out = object.__new__(Places)
        row = np.searchsorted(self.short, at)
        is_short = np.append(self.short, -1)[row] == at
        out.texts, out.short, out.long, out.letter = self.texts[at], np.flatnonzero(is_short), np.flatnonzero(~is_short), self.letter
        out.sizes = self.sizes[row[is_short]]
        out.bits = self.bits[:, row[is_short]].astype(_word(out.sizes))
        return out


def _word(sizes: np.ndarray) -> type:
    return np.uint32 if sizes.max(initial=0) <= 32 else np.uint64  # half the bytes where they are enough


def _matched(left: list[str], right: Places) -> Iterator[tuple]:
    """Rows of ``left`` by their length, some at a time, with their characters' numbers, the matched places of the right strings of up to 64 characters and which characters found one."""
    word = right.bits.dtype.type
    one = word(1)
    by_size: dict[int, list[int]] = {}
    for i, a in enumerate(left):
        if a and len(a) <= 64 and len(right.short):
            by_size.setdefault(len(a), []).append(i)
    most = max(1, (1 << 12) // max(1, len(right.short)))  # strings of one length go together, so that a step has some thousand numbers
    for na, members in by_size.items():
        near = _reaches(na)[:, right.sizes].astype(word)
        for lo in range(0, len(members), most):
            some = members[lo : lo + most]
            at = np.array([[right.letter.get(ch, -1) for ch in left[i]] for i in some])
            taken, hits = np.zeros((len(some), len(right.short)), word), []
            for k in range(na):
                free = right.bits[at[:, k]] & near[k] & ~taken
                low = free & (~free + one)
                taken |= low
                hits.append(low != 0)
            yield na, some, at, taken, hits


def _similarity(m: np.ndarray, turned: np.ndarray, prefix: np.ndarray, na: int, nb: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / na + m / nb + (m - turned) / m) / 3, 0.0)
        return np.where(jaro > BOOST_ABOVE, jaro + prefix * PREFIX_WEIGHT * (1 - jaro), jaro)


def jaro_winkler_cross(left: list[str], right: list[str] | Places) -> np.ndarray:
    """(left, right) similarity of each string with each."""
    right = right if isinstance(right, Places) else Places(right)
    out = np.zeros((len(left), len(right.texts)))
    for i, a in enumerate(left):
        if len(a) > 64:
            out[i] = _jaro_winkler_block([a] * len(right.texts), right.texts.tolist())
        elif len(right.long):
            out[i, right.long] = _jaro_winkler_block([a] * len(right.long), [right.texts[k] for k in right.long.tolist()])
    bits, word = right.bits, right.bits.dtype.type
    one, signed = word(1), np.int32 if word is np.uint32 else np.int64
    for na, some, at, taken, hits in _matched(left, right):
        m, left_over, turned = np.bitwise_count(taken).astype(np.int64), taken.copy(), np.zeros(taken.shape, np.uint8)
        for k, hit in enumerate(hits):
            low = left_over & (~left_over + one)
            low *= hit
            turned += hit > (bits[at[:, k]] & low).view(signed).astype(bool)  # 64 at most
            left_over ^= low
        same, prefix = np.ones(taken.shape, bool), np.zeros(taken.shape, np.int64)
        for k in range(min(na, PREFIX_MOST)):
            same &= (bits[at[:, k]] >> word(k)) & one == 1
            prefix += same
        out[np.ix_(some, right.short)] = _similarity(m, (turned // 2).astype(np.int64), prefix, na, right.sizes)
    return out


#: Writes every digit as 0: strings that differ in digits only have one template.
TEMPLATE = str.maketrans("123456789", "000000000")


#: Digits of a string that are told apart pair by pair.
MOST_DIGITS = 8


@dataclass
class Spans:
    """Of each left template with each right one. ``by_digits``: similarity hangs on ``x``, how many digits match, and ``y``, how many of these meet another digit
    in order; then ``letters`` other characters match, ``apart[x]`` matched ones certainly meet others, ``prefix`` leading ones are shared, and matched letters
    before the digits are ``shift`` more on the left."""

    least: np.ndarray
    most: np.ndarray
    by_digits: np.ndarray
    letters: np.ndarray
    prefix: np.ndarray
    shift: np.ndarray
    apart: np.ndarray


def jaro_winkler_bounds(left: list[str], right: list[str]) -> Spans:
    """(left, right) least and greatest similarity of strings of one template with those of another, whatever their digits are.

    Characters match equal ones only, so matches of all but digits are those of the templates; of the digits between none and as many match as if
    all were equal. For each such number, where the digits of a string stand together, it is known which matched characters meet in order, but for
    digits that meet digits. Bounds are wide by 1e-9, for rounding; strings of more than 64 characters have 0 and 1.
    """
    to = Places(right)
    least, most = np.zeros((len(left), len(right))), np.ones((len(left), len(right)))
    bits, word = to.bits, to.bits.dtype.type
    one, zero = word(1), to.letter.get("0", -1)
    shape = least.shape
    out = Spans(least, most, np.zeros(shape, bool), np.zeros(shape, np.uint8), np.zeros(shape, np.uint8), np.zeros(shape, np.int8), np.zeros((MOST_DIGITS + 1, *shape), np.uint8))
    before = (bits[zero] & (~bits[zero] + one)) - one  # places before the first digit
    few = np.bitwise_count(bits[zero]) <= MOST_DIGITS
    few &= bits[zero] > 0
    together = np.array([re.fullmatch("[^0]*0*[^0]*", to.texts[k]) is not None for k in to.short.tolist()], bool)
    for k, a in enumerate(left):
        if not a:
            most[k, to.short] = 1e-9
    for na, some, at, taken, hits in _matched(left, to):
        digit = (at == zero) & (zero >= 0)
        own = bits[zero] & taken if zero >= 0 else np.zeros_like(taken)
        n_digits, letters = np.bitwise_count(own).astype(np.int64), taken & ~own
        n_letters = np.bitwise_count(letters).astype(np.int64)
        joined = together[None, :] & np.array([re.fullmatch("[^0]*0*[^0]*", left[i]) is not None for i in some])[:, None]
        alike, prefix, known = np.ones(taken.shape, bool), np.zeros(taken.shape, np.int64), np.zeros(taken.shape, np.int64)
        sure = alike.copy()
        for k in range(min(na, PREFIX_MOST)):
            alike &= (bits[at[:, k]] >> word(k)) & one == 1
            sure &= alike & ~digit[:, k : k + 1]
            prefix += alike
            known += sure
        where = np.ix_(some, to.short)
        n_own, first = digit.sum(axis=1), digit.argmax(axis=1)
        ahead = sum((hit & (k < first)[:, None] for k, hit in enumerate(hits)), np.zeros(taken.shape, np.int64))
        out.by_digits[where] = joined & (prefix == known) & few[None, :] & ((n_own > 0) & (n_own <= MOST_DIGITS))[:, None]
        out.letters[where], out.prefix[where], out.shift[where] = n_letters, known, ahead - np.bitwise_count(letters & before)
        low_all, high_all, chosen, rest_digits = np.ones(taken.shape), np.zeros(taken.shape), letters.copy(), own
        for x in range(int(n_digits.max(initial=0)) + 1):
            if x:
                low = rest_digits & (~rest_digits + one)
                chosen, rest_digits = chosen | low, rest_digits ^ low
            m, rest = n_letters + x, chosen.copy()
            apart, open_, count = np.zeros(taken.shape, np.uint8), np.zeros(taken.shape, np.uint8), np.zeros(taken.shape, np.uint8)
            for k, hit in enumerate(hits):
                if digit[:, k].any():
                    count += hit & digit[:, k : k + 1]
                    hit = hit & ~(digit[:, k : k + 1] & (count > x))
                low = (rest & (~rest + one)) * hit
                meet = (bits[at[:, k]] & low) != 0
                apart += hit & ~meet
                open_ += meet & digit[:, k : k + 1]
                rest ^= low
            if x <= MOST_DIGITS:
                out.apart[x][where] = apart
            fewest, greatest = apart // 2, (apart + (open_ if x > 1 else np.uint8(0))) // 2  # one matched digit meets its equal
            if x:
                fewest, greatest = np.where(joined, fewest, 0), np.where(joined, greatest, m // 2)
            here = n_digits >= x
            low_all = np.where(here, np.minimum(low_all, _similarity(m, greatest, known, na, to.sizes)), low_all)
            high_all = np.where(here, np.maximum(high_all, _similarity(m, fewest, prefix, na, to.sizes)), high_all)
        least[where], most[where] = low_all - 1e-9, high_all + 1e-9
    return out


class DigitPairs:
    """Similarities of pairs of strings whose templates' ``Spans`` are ``by_digits``: pair ``u`` of templates is the left one at ``gi[u]`` with the right one at ``gj[u]``."""

    def __init__(self, spans: Spans, left: Sequence[str], right: Sequence[str], gi: np.ndarray, gj: np.ndarray):
        at = lambda texts, f, g: np.array([f(t) for t in texts], np.int64)[g]
        na, nb = at(left, len, gi), at(right, len, gj)
        start = at(right, lambda t: t.find("0"), gj) - at(left, lambda t: t.find("0"), gi)
        reach = np.maximum(np.maximum(na, nb) // 2 - 1, 0)
        place = np.arange(MOST_DIGITS)
        near = np.abs(start[:, None, None] + place[None, None, :] - place[None, :, None]) <= reach[:, None, None]
        self.near = (near << place.astype(np.uint8)).sum(axis=2).astype(np.uint8)  # by the left digit: the right ones that it may match
        self.shift = spans.shift[gi, gj]
        letters, prefix = spans.letters[gi, gj].astype(np.int64), spans.prefix[gi, gj].astype(np.int64)
        self.similarity = np.zeros((len(gi), MOST_DIGITS + 1, MOST_DIGITS + 1))
        for x in range(MOST_DIGITS + 1):
            for y in range(x + 1):
                turned = (spans.apart[x][gi, gj].astype(np.int64) + y) // 2
                self.similarity[:, x, y] = _similarity(letters + x, turned, prefix, na, nb)

    def matches(self, u: np.ndarray, digits: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x and y of pairs of strings, by their pair of templates: ``digits`` of the left one, MOST_DIGITS columns filled up with 10, ``places`` a function of
        a digit column that gives the places of these digits in the right one as bits."""
        taken, hits, found = np.zeros(len(u), np.uint8), [], []
        for p, digit in enumerate(digits):
            own = places(digit)
            free = own & self.near[u, p] & ~taken
            low = free & (~free + np.uint8(1))
            taken |= low
            hits.append(low != 0)
            found.append(own)
        shift, rest, y, seen = self.shift[u], taken.copy(), np.zeros(len(u), np.uint8), np.zeros(len(u), np.int8)
        for k in range(min(MOST_DIGITS, int(shift.max(initial=0)))):
            rest = np.where(shift > k, rest & (rest - np.uint8(1)), rest)
        for hit, own in zip(hits, found, strict=True):
            seen += hit
            low = (rest & (~rest + np.uint8(1))) * (hit & (seen > -shift))
            y += (low != 0) & ((own & low) == 0)
            rest ^= low
        return np.bitwise_count(taken), y


def digits_of(texts: Sequence[str | None], most: int = MOST_DIGITS) -> np.ndarray:
    """(most, texts) the first digits of each, filled up with 10."""
    out = np.full((most, len(texts)), 10, np.uint8)
    for k, v in enumerate(texts):
        for p, ch in enumerate([c for c in v or "" if c in "0123456789"][:most]):
            out[p, k] = ord(ch) - 48
    return out


def jaro_winkler_values(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of each pair, 0 to 1; null if either is null, 0 if either is empty. Case counts. Equal pairs of a batch are measured once."""
    out = np.full(len(left), np.nan)
    go = np.flatnonzero(left.notna().to_numpy() & right.notna().to_numpy())
    if len(go):
        pairs = pd.DataFrame({"l": left.to_numpy(object)[go], "r": right.to_numpy(object)[go]})
        code = pairs.groupby(["l", "r"], sort=False).ngroup().to_numpy()
        first = np.unique(code, return_index=True)[1]
        one = pairs.iloc[first]
        # pairs of like length together, so that padding stays small
        order = np.argsort(one["l"].str.len().to_numpy() + one["r"].str.len().to_numpy(), kind="stable")
        got = np.empty(len(one))
        for lo in range(0, len(order), 2048):
            k = order[lo : lo + 2048]
            got[k] = _jaro_winkler_block(one["l"].iloc[k].tolist(), one["r"].iloc[k].tolist())
        out[go] = got[code]
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


@F.pandas_udf(DoubleType())
def jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    return jaro_winkler_values(left, right)


#: The same, which plans neither repeat nor move: a filter on what is computed from it would otherwise be pushed below and measure every pair twice.
jaro_winkler_once = F.pandas_udf(jaro_winkler_values, DoubleType()).asNondeterministic()


def register(spark: SparkSession) -> None:
    """Make ``jaro_winkler`` known to SQL."""
    spark.udf.register("jaro_winkler", jaro_winkler)


def damerau_within_one(left: Column, right: Column) -> Column:
    """Whether one edit at most (insertion, deletion, change or swap of neighbours) makes the strings equal; null if either is null."""

    def swapped(i: Column) -> Column:
        return F.concat(F.substring(left, 1, i - 1), F.substring(left, i + 1, F.lit(1)), F.substring(left, i, F.lit(1)), F.substring(left, i + 2, F.length(left)))

    swap = (F.length(left) == F.length(right)) & (F.length(left) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(left) - 1, F.lit(1))), lambda i: swapped(i) == right)
    return (F.levenshtein(left, right) <= 1) | swap


def email_user(email: Column) -> Column:
    """What stands before the first @; null if nothing does."""
    user = F.regexp_extract(email, r"^[^@]+", 0)
    return F.when(user != "", user)


def swap_last(text: Column) -> Column:
    """The last two characters exchanged; a text of fewer than two stays."""
    n = F.length(text)
    return F.when(n < 2, text).otherwise(F.concat(F.substring(text, F.lit(1), n - 2), F.substring(text, n, F.lit(1)), F.substring(text, n - 1, F.lit(1))))
