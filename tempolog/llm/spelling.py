"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

One inserted, deleted or replaced letter changes the counts of a word's letters by one or two in all (L1 distance). Words
of one length are cut into cells by a k-d tree; each word is sent to the cells of its own length and of the lengths next to it
whose box is near enough, searched there in a k-d tree of the cell's words, and what is left is compared letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolog.llm.common import durable, map_partitions

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
SHORTEST, FEWEST = 5, 3
DELETION, RATIO = 97, 2
# Words that the cells are drawn from (those of up to DRAWN letters); all words are indexed, and cells are exact for any sample.
SAMPLE, DRAWN = 60_000, 64
# Words of a cell that a task holds, and the number of cells that are sent to all tasks; a larger cell is dealt over several tasks.
CELL, CELLS = 20_000, 4096
# Words of a leaf of the tree inside a cell, and letters compared at once.
LEAF, COMPARED = 128, 1 << 22
# Different words a counting task keeps before it hands on what it has.
HELD = 400_000
_SIZE = 90
_LATIN = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))
_DIMENSION = np.array([c - 0x61 if 0x61 <= c <= 0x7A else c - 0xC0 + 26 if c >= 0xC0 else 0 for c in range(256)], np.int64)


def words_of(text: str) -> list[bytes]:
    """The letter runs of a text with A-Z in lower case, one byte (Latin-1) a letter."""
    return text.encode("latin-1", "replace").translate(_LATIN).split()


def varied(word: bytes, start: int) -> bytes:
    """The word as it counts in a document whose checksum of ``<doc_id>:`` is ``start``: some lose a letter."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    if h % DELETION:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def vocabulary(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of all words of at least ``SHORTEST`` letters with ``FEWEST`` or more occurrences in ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in found], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column("doc_id"), batch.column("text")):
                i = i.as_py()
                start = zlib.crc32(b":" if i is None else b"%d:" % i)
                for word, n in Counter(words_of(text.as_py() or "")).items():
                    if len(word) >= SHORTEST and len(word := varied(word, start)) >= SHORTEST:
                        found[word] += n
                if len(found) >= HELD:
                    yield out()
                    found.clear()
        if found:
            yield out()

    parts = map_partitions(docs.select("doc_id", "text"), run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)


# --- trees ----------------------------------------------------------------------------------------------------------

def letters(words: list[bytes]) -> np.ndarray:
    """Words of one length as a matrix of letters."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), len(words[0]))


def counts(matrix: np.ndarray) -> np.ndarray:
    """How often each letter is in each word."""
    places = _DIMENSION[matrix] + _SIZE * np.arange(len(matrix))[:, None]
    kind = np.int16 if matrix.shape[1] < 1 << 14 else np.int64
    return np.bincount(places.ravel(), minlength=_SIZE * len(matrix)).reshape(-1, _SIZE).astype(kind)


@dataclass
class Node:
    """A box of letter counts; an inner node splits it where ``letter`` occurs ``most`` times or less, or more often."""

    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray | None = None      # of a leaf
    letter: int = -1
    most: int = 0
    below: Node | None = None
    above: Node | None = None
    name: int = 0


def _best_split(points: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that part the points most evenly; None if all are equal."""
    low, high = points.min(axis=0), points.max(axis=0)
    best = None
    for most in range(int(low.min()), min(int(high.max()), int(low.min()) + 4)):
        off = np.abs((points <= most).mean(axis=0) - 0.5)
        off[(low > most) | (high <= most)] = 1.0
        letter = int(off.argmin())
        if off[letter] < 0.5 and (best is None or off[letter] < best[0]):
            best = (off[letter], letter, most)
    if best is None:
        letter = int((high - low).argmax())
        if high[letter] == low[letter]:
            return None
        return letter, int(low[letter] + high[letter]) // 2
    return best[1:]


def grow(points: np.ndarray, limit: int, box: tuple[np.ndarray, np.ndarray] | None = None, rows: np.ndarray | None = None) -> Node:
    """A k-d tree with leaves of at most ``limit`` points (more only if they are equal).

    With a ``box`` the nodes part it among them, so that any point has its leaf; without, boxes fit their points tightly.
    """
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows]
    low, high = box or (own.min(axis=0), own.max(axis=0))
    split = _best_split(own) if len(rows) > limit else None
    if split is None:
        return Node(low, high, rows)
    letter, most = split
    under = own[:, letter] <= most
    boxes = [None, None]
    if box:
        boxes = [(low, high.copy()), (low.copy(), high)]
        boxes[0][1][letter], boxes[1][0][letter] = most, most + 1
    return Node(low, high, None, letter, most, grow(points, limit, boxes[0], rows[under]), grow(points, limit, boxes[1], rows[~under]))


def leaves(node: Node) -> list[Node]:
    return [node] if node.rows is not None else leaves(node.below) + leaves(node.above)


def home(node: Node, points: np.ndarray) -> np.ndarray:
    """The name of each point's leaf."""
    names = np.zeros(len(points), np.int64)
    stack = [(node, np.arange(len(points)))]
    while stack:
        at, rows = stack.pop()
        if at.rows is not None:
            names[rows] = at.name
        else:
            under = points[rows, at.letter] <= at.most
            stack += [(at.below, rows[under]), (at.above, rows[~under])]
    return names


def search(node: Node, points: np.ndarray, more: int, less: int, outside: np.ndarray | None = None) -> Iterator[tuple[Node, np.ndarray]]:
    """Leaves with the points they are in reach of: a neighbour has up to ``more`` letters that the point has not, and
    lacks up to ``less`` of its letters. ``outside`` counts letters of a point that no point of the tree has.
    """
    stack = [(node, np.arange(len(points)))]
    while stack:
        at, rows = stack.pop()
        own = points[rows]
        need = np.maximum(at.low - own, 0).sum(axis=1)
        spare = np.maximum(own - at.high, 0).sum(axis=1)
        if outside is not None:
            spare = spare + outside[rows]
        rows = rows[(need <= more) & (spare <= less)]
        if len(rows) and at.rows is not None:
            yield at, rows
        elif len(rows):
            stack += [(at.below, rows), (at.above, rows)]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, whether words differ by exactly one inserted, deleted or replaced letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    n = a.shape[1]
    ahead = np.hstack([a != b[:, :n], np.ones((len(a), 1), bool)]).argmax(axis=1)             # letters before the first difference
    behind = np.hstack([(a != b[:, 1:])[:, ::-1], np.ones((len(a), 1), bool)]).argmax(axis=1)  # letters after the last one
    return ahead + behind >= n


class Cell:
    """Words of one length, in code-point order, with a tree over their letter counts."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words, self.n = [words[i] for i in order], n[order]
        self.letters = letters(self.words)
        points = counts(self.letters)
        self.used = np.flatnonzero(points.any(axis=0))
        self.points = points[:, self.used]
        self.tree = grow(self.points, LEAF)
        exact = np.float32 if self.letters.shape[1] < 1000 else np.float64  # holds all products as whole numbers
        self.flat, self.square = self.points.astype(exact), (self.points.astype(np.int64)**2).sum(axis=1)

    def near(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``words``, place in the cell) that are one edit apart; ``words`` have one length."""
        given = letters(words)
        step = given.shape[1] - self.letters.shape[1]
        every = counts(given)
        points = every[:, self.used]
        outside = every.sum(axis=1) - points.sum(axis=1)
        flat, square = points.astype(self.flat.dtype), (every.astype(np.int64)**2).sum(axis=1)
        found = []
        for leaf, rows in search(self.tree, points, int(step <= 0), int(step >= 0), outside):
            # Counts are whole, so a squared distance of 1 or 2 is an L1 distance of 1 or 2.
            apart = square[rows][:, None] + self.square[leaf.rows] - 2 * (flat[rows] @ self.flat[leaf.rows].T)
            i, j = np.nonzero(apart == (1 if step else 2))
            if len(i):
                found.append((rows[i], leaf.rows[j]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        left, right = (np.concatenate(x) for x in zip(*found))
        width = max(1, COMPARED // given.shape[1])
        same = np.concatenate([one_edit(given[left[k:k + width]], self.letters[right[k:k + width]]) for k in range(0, len(left), width)])
        return left[same], right[same]


# --- the distributed search -----------------------------------------------------------------------------------------

def _by_length(words: list[bytes]) -> dict[int, np.ndarray]:
    sizes = np.array(list(map(len, words)))
    return {int(x): np.flatnonzero(sizes == x) for x in np.unique(sizes)}


def draw_cells(words: DataFrame, cell: int = CELL) -> dict[int, Node]:
    """A tree of cells for each length of words, from a bounded sample; lengths with few words have none (one cell)."""
    sizes = {r.size: r.words for r in words.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("words")).where(F.col("size") <= DRAWN).collect()}
    total, grain = sum(sizes.values()), 1 << 30
    if not total:
        return {}
    drawn = words.where((F.length("word") <= DRAWN) & (F.pmod(F.xxhash64("word"), F.lit(grain)) < int(grain * min(1.0, 0.9 * SAMPLE / total))))
    sample = sorted(r.word.encode("latin-1") for r in drawn.select("word").limit(SAMPLE).collect())
    trees = {}
    most = max(cell, total // CELLS + 1)
    for size, rows in (_by_length(sample) if sample else {}).items():
        if sizes[size] > most:
            points = counts(letters([sample[i] for i in rows]))
            whole = np.zeros(_SIZE, np.int64), np.full(_SIZE, size, np.int64)
            trees[size] = grow(points, max(1, int(len(rows) * most / sizes[size])), whole)
            for name, leaf in enumerate(leaves(trees[size])):
                leaf.name, leaf.rows = name, np.zeros(0, np.int64)
    return trees


def _dealt(words: DataFrame, trees: dict[int, Node]) -> DataFrame:
    """``(size, cell, kind, word, n)``: each word once to be held (kind 0), and to each cell to be searched (kind 1 to 3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            n = batch.column("n").to_numpy()
            rows, sizes, cells, kinds = [], [], [], []

            def add(at, size, cell, kind):
                rows.append(at)
                cells.append(np.broadcast_to(cell, len(at)))
                sizes.append(np.full(len(at), size))
                kinds.append(np.full(len(at), kind))

            for size, at in _by_length(own).items() if own else ():
                points = counts(letters([own[i] for i in at]))
                add(at, size, home(trees[size], points) if size in trees else 0, 0)
                for step in (-1, 0, 1):
                    if size + step not in trees:
                        add(at, size + step, 0, 2 + step)
                        continue
                    for leaf, near in search(trees[size + step], points, int(step >= 0), int(step <= 0)):
                        add(at[near], size + step, leaf.name, 2 + step)
            if rows:
                at = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.concatenate(x).astype(np.int32)) for x in (sizes, cells, kinds)), batch.column("word").take(pa.array(at)), pa.array(n[at])],
                    names=["size", "cell", "kind", "word", "n"])

    return map_partitions(words, run, "size int, cell int, kind int, word string, n long")


def _found(rows: DataFrame) -> DataFrame:
    """``(word, n_near, form_n, form)`` per word and cell that has near words of it; ``form`` is the best of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, held_n, cell = None, [], [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("size", "cell", "part", "kind")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns], axis=0)) + 1 if batch.num_rows else []
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                now, kind = tuple(int(x[a]) for x in columns[:3]), int(columns[3][a])
                words = [w.encode("latin-1") for w in batch.column("word").slice(a, b - a).to_pylist()]
                n = batch.column("n").slice(a, b - a).to_numpy()
                if now != key:
                    key, held, held_n, cell = now, [], [], None
                if kind == 0:
                    held += words
                    held_n.append(n)
                    continue
                if cell is None and held:
                    cell = Cell(held, np.concatenate(held_n))
                    held, held_n = [], []
                if cell is None:
                    continue
                left, right = cell.near(words)
                order = np.lexsort((right, -cell.n[right], left))
                left, right = left[order], right[order]
                first = np.flatnonzero(np.r_[True, left[1:] != left[:-1]]) if len(left) else np.zeros(0, np.int64)
                if len(first):
                    best = right[first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words[i].decode("latin-1") for i in left[first]]), pa.array(np.diff(np.r_[first, len(left)])), pa.array(cell.n[best]),
                         pa.array([cell.words[j].decode("latin-1") for j in best])], names=["word", "n_near", "form_n", "form"])

    return map_partitions(rows, run, "word string, n_near long, form_n long, form string")


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """``(word, n_near, form_n, form)`` of the words of ``words`` (``word``, ``n``) that have a near word.

    ``form`` is the near word of largest ``n``, the first in code-point order among equals.
    """
    dealt = durable(_dealt(words, draw_cells(words, cell)))
    # A cell with more words than a task should hold is dealt over several; searches go to each of them.
    share = F.greatest(F.col("size") / DRAWN, F.lit(1.0)) / cell
    sizes = dealt.where("kind = 0").groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) * F.first(share)).cast("int").alias("parts"))
    total = dealt.count()
    split = dealt.join(sizes, ["size", "cell"]).withColumn(
        "part", F.explode(F.when(F.col("kind") == 0, F.array(F.pmod(F.xxhash64("word"), "parts").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    keys = ["size", "cell", "part"]
    ranged = split.repartition(max(1, min(10_000, total // 50_000)), *keys).sortWithinPartitions(*keys, "kind")
    found = _found(ranged.select(*keys, "kind", "word", "n"))
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form"))
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return out.select("word", "n_near", (-F.col("best.minus")).alias("form_n"), F.col("best.form").alias("form"))


def last_forms(forms: DataFrame) -> DataFrame:
    """``(word, root)``: where the forms of ``forms`` (``word``, ``form``) lead, by doubling the steps in each round.

    A form occurs at least twice as often as its word, so there are no circles, and the rounds grow with the logarithm of
    the logarithm of the counts.
    """
    at = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = durable(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")
        at = at.drop("moved")


def variants(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``docs``.

    Words are runs of letters (A-Z, a-z and the code points C0 to FF) with A-Z in lower case; where the CRC-32 of
    ``<doc_id>:<run>`` is a multiple of 97 the run loses a letter. Those of five letters or more with three or more occurrences in
    all are words. Two are near if they are one inserted, deleted or replaced letter apart. The form of a word is its near word of
    largest n (the first in code-point order among equals) if that is twice its own n or more, else null; the root is the last form.

    A null text has no words; a null doc_id counts as the empty text. Repeated rows are counted as often as they
    occur. An empty table has no words. Further columns are ignored. Words of any length are searched: those of over 64
    letters are not cut by a tree, only dealt over tasks by their hash.
    """
    words = durable(vocabulary(docs))
    near = near_words(words, cell)
    named = durable(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        *[F.when(F.col("form_n") >= RATIO * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")]))
    roots = last_forms(named.where("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
