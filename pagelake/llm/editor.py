"""A character editor: an averaged structured perceptron over keep, replace, delete, insert and line-join operations.

A reading of a word is a sequence of operations on its characters and the gaps after them; its margin is the score of the
sequence over that of keeping every character. Features are the characters around an operation and the evidence that the
corpus gives for the reading (how much more frequent it is, in how many books, as what kind of word). Joins at a line end and
furniture lines are told by the same learner from their own features. Training: words of the corpus under a noise channel
of scanner confusions, real pairs of words as examples of keeping, real line ends and lines; all bounded samples.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict
from collections.abc import Iterable, Iterator

#: What scanners take for what, as true > read.
CONFUSIONS = (
    "e>c c>e a>o o>0 O>0 l>1 i>1 I>1 1>l 1>i 1>I 0>o 0>O s>5 S>5 5>s 5>S g>9 9>g b>6 6>b B>8 8>B z>2 Z>2 2>Z t>f f>t h>b i>! l>! l>| i>| 1>! 1>| q>9 n>u u>n i>l l>i i>j rn>m m>rn n>ri ri>n u>ii ii>u d>cl cl>d in>m m>in li>h h>li "
    "w>vv vv>w nn>rm ni>m m>ni y>v v>y c>o G>6 D>0 T>7 7>T A>4 é>6 о>0 О>0 з>3 З>3 3>з б>6 6>б и>н н>и п>л л>п е>с с>е ш>щ щ>ш м>ім ы>ьі ы>ьi ь>ъ т>г г>т ц>ц, ю>іо ж>лс ч>4 4>ч в>8 у>y н>п п>н и>п а>о о>а ё>е й>и"
)
PAIRS = [tuple(x.split(">")) for x in CONFUSIONS.split()]
#: Parameters: training words, passes, the most edits of one reading, and the margin up to which a case of the training is learnt from.
WORDS, PASSES, EDITS, SAFE = 4_000, 5, 2, 1.0
KEEP, DELETE, JOIN, STAY = "K", "D", "J", "H"

Operation = tuple[int, str]
BY_TRUE: dict[str, list[tuple[str, str]]] = defaultdict(list)
BY_READ: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _t, _r in PAIRS:
    BY_TRUE[_t[0]].append((_t, _r))
    BY_READ[_r[0]].append((_t, _r))


def operations(true: str, read: str, at: int = 0) -> list[Operation]:
    """What turns ``read``, which begins at ``at``, into ``true``: replacements from the left, then deletions, or insertions after the last character."""
    n = min(len(true), len(read))
    out = [(at + i, f"R{t}") for i, (t, r) in enumerate(zip(true, read)) if t != r]
    out += [(at + i, DELETE) for i in range(n, len(read))]
    return out + [(at + len(read) - 1, f"I{t}") for t in true[n:]]


def apply(text: str, ops: Iterable[Operation]) -> str:
    """``text`` after the operations."""
    out = list(text)
    for i, o in ops:
        if o[0] == "R":
            out[i] = o[1:] + out[i][1:]
        elif o == DELETE:
            out[i] = out[i][1:]
        elif o[0] == "I":
            out[i] += o[1:]
    return "".join(out)


def around(text: str, i: int) -> list[str]:
    """The character with its neighbours, and what kinds of characters stand around it."""
    at = lambda j: text[j] if 0 <= j < len(text) else "#"
    c, p, n, pp, nn = at(i), at(i - 1), at(i + 1), at(i - 2), at(i + 2)
    kind = lambda x: "d" if x.isdigit() else "a" if x.isalpha() else x
    return [f"c{c}", f"p{p}{c}", f"n{c}{n}", f"b{p}{c}{n}", f"P{pp}{p}{c}", f"N{c}{n}{nn}", f"k{kind(pp)}{kind(p)}{c}{kind(n)}{kind(nn)}"]


def step(x: float, low: int = -3, high: int = 12) -> int:
    """The binary logarithm in whole steps."""
    return max(low, min(high, math.floor(math.log2(x)))) if x > 0 else low


def evidence(n: int, lower: int, odd: bool, edits: int, known: int, known_lower: int, books: int, there: int, most: int) -> list[str]:
    """What the corpus says of a word (n times, lower of them small) as a form of a reading (known times).

    there: how often the book with most of the word's occurrences (most) has the reading.
    """
    ratio = step(known / max(n, 1))
    kind = "o" if odd else "n" if not lower else "w"
    reading = "n" if 2 * known_lower < known else "w"
    more = [f"r{kind}{k}" for k in range(ratio + 1)] + [f"e{edits}{kind}{k}" for k in range(0, ratio + 1, 2)]
    return [*more, f"e{edits}{kind}", f"b{kind}{min(books, 4)}", f"k{kind}{step(known, 0, 6)}", f"t{kind}{reading}", f"h{kind}{step(there / max(most, 1)) if there else 'x'}"]


class Perceptron:
    """Averaged weights of features; a case is taken if its features' weights sum to more than zero."""

    def __init__(self):
        self.weights: dict[str, float] = {}

    def fit(self, cases: list[tuple[list[str], bool]], passes: int = PASSES, seed: int = 3) -> Perceptron:
        rng, order = random.Random(seed), list(range(len(cases)))
        weights: dict[str, float] = defaultdict(float)
        sums: dict[str, float] = defaultdict(float)
        n = 0
        for _ in range(passes):
            rng.shuffle(order)
            for k in order:
                fs, right = cases[k]
                n += 1
                by = 1.0 if right else -1.0
                if by * sum(weights[f] for f in fs) <= SAFE:
                    for f in fs:
                        weights[f] += by
                        sums[f] += by * n
        # the average over all steps of what the weights were
        self.weights = {f: w - sums[f] / (n + 1) for f, w in weights.items() if w or sums[f]}
        return self

    def score(self, fs: Iterable[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in fs)


def reading_features(word: str, ops: Iterable[Operation], told: list[str]) -> list[str]:
    """Features of a sequence of operations over keeping: the characters around each, and the evidence."""
    return [f"{f}>{o}" for i, o in ops for f in around(word, i)] + told


def readings(word: str, edits: int = EDITS) -> Iterator[tuple[str, int, tuple]]:
    """(reading, number of confusions, their places as (place, true, read)) for up to ``edits`` confusions read back: what the editor chooses from."""
    spots = [(i, t, r) for i in range(len(word)) for t, r in BY_READ.get(word[i], ()) if word.startswith(r, i)]
    for a, (i, t, r) in enumerate(spots):
        head, rest = word[:i] + t, i + len(r)
        yield head + word[rest:], 1, ((i, t, r),)
        if edits > 1:
            for j, u, q in spots[a + 1 :]:
                if j >= rest:
                    yield head + word[rest:j] + u + word[j + len(q) :], 2, ((i, t, r), (j, u, q))


def restoring(word: str, reading: str, edits: int) -> list[Operation]:
    """The operations of the first way of ``edits`` confusions that makes ``reading`` of ``word``."""
    for v, n, spots in readings(word, edits):
        if v == reading and n == edits:
            return [o for i, t, r in spots for o in operations(t, r, i)]
    return []


def noise(word: str, rng: random.Random, edits: int) -> tuple[str, list[Operation]] | None:
    """``word`` as a scanner might read it, and the operations that restore it."""
    spots = [(i, t, r) for i in range(len(word)) for t, r in BY_TRUE.get(word[i], ()) if word.startswith(t, i)]
    rng.shuffle(spots)
    taken: list[tuple[int, str, str]] = []
    for i, t, r in spots:
        if len(taken) < edits and all(i >= j + len(u) or j >= i + len(t) for j, u, _ in taken):
            taken.append((i, t, r))
    if len(taken) < edits:
        return None
    read, ops, last = "", [], 0
    for i, t, r in sorted(taken):
        read += word[last:i]
        ops += operations(t, r, len(read))
        read += r
        last = i + len(t)
    read += word[last:]
    return (read, ops) if read != word and apply(read, ops) == word else None


class Editor:
    """Margins of readings, joins and furniture lines; without training every margin is zero and nothing is taken."""

    def __init__(self):
        self.words, self.joins, self.lines = Perceptron(), Perceptron(), Perceptron()

    def margin(self, word: str, ops: Iterable[Operation], told: list[str]) -> float:
        return self.words.score(reading_features(word, ops, told))

    def fit_words(self, known: list[tuple[str, int, int, int]], kept: list[tuple], seed: int = 5) -> Editor:
        """known: frequent words (word, n, lower, books), corrupted here; kept: pairs (word, operations, evidence) that are two words."""
        rng = random.Random(seed)
        cases = []
        for w, n, lower, books in known:
            small = 2 * lower >= n
            for edits in (1, 2) if len(w) >= 6 else (1,):
                made = noise(w, rng, edits)
                if not made:
                    continue
                read, ops = made
                odd = not read.isalpha()
                times = max(1, n >> rng.randrange(2 if odd else 4 if edits == 1 else 6, 13))
                most = max(1, times // rng.choice((1, 2)))
                there = most * rng.choice((0, 8, 16, 32, 64, 128))
                cases.append((reading_features(read, ops, evidence(times, times if small else 0, odd, edits, n, lower, books, there, most)), True))
        cases += [(reading_features(w, ops, told), False) for w, ops, told in kept]
        self.words.fit(cases)
        return self

    def join_margin(self, left: str, mark: str, right: str, told: list[str]) -> float:
        return self.joins.score(self._join(left, mark, right, told))

    @staticmethod
    def _join(left: str, mark: str, right: str, told: list[str]) -> list[str]:
        text = f"{left}{mark}\n{right}"
        return [f"{f}>{JOIN}" for f in around(text, len(left))] + [f"l{left[-3:]}", f"r{right[:3]}", f"s{min(len(left), 4)}{min(len(right), 4)}", *told]

    def fit_joins(self, cases: list[tuple[str, str, str, list[str], list[str], bool]]) -> Editor:
        """cases: (left, mark, right, what the corpus says of the whole, of the parts, joined); each is seen with and without the first."""
        self.joins.fit([(self._join(a, m, b, parts + more), j) for a, m, b, whole, parts, j in cases for more in (whole, ["?"])])
        return self

    def fit_lines(self, cases: list[tuple[list[str], bool]]) -> Editor:
        self.lines.fit(cases)
        return self
