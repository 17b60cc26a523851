"""Near-duplicate vectors by lattice hashing.

In each of several tables a vector is projected at random to ``blocks`` times
eight dimensions and every eight are decoded to the nearest point of the E8
lattice; the points are the vector's home cell. A vector is also shown to the
cells across its nearest facets (the ``probes`` lattice neighbours that lie
closest). Vectors that meet in a cell are compared by cosine in double
precision; only true links are ever counted, each once.

Scale. Equal vectors are collapsed first, so a vector that a third of all rows
share is compared once and counted with its multiplicity. What is shuffled for
the search are cell numbers; vectors travel to cells that hold at least two. A
crowded cell is cut into blocks that meet pairwise in tasks of bounded size, as
counting links takes every pair of a crowd; such tasks return one count and one
neighbour per vector, never the pairs. Small cells are compared many at a time.
The number of lattice blocks and tables follows the number of rows, so cells
stay small, and tables are added with blocks so that no setting finds a smaller
share of the links than the first.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths have no cosine, those
of one length are searched among themselves, whatever its share of the rows; a
cosine of exactly the threshold in double precision links, and every pair is
judged by one formula, so ties fall alike in every table; rows that repeat
``vec_id`` are one vector if equal (and, if not, each has its own links); null
ids get a row without links; long vectors are compared in full; an empty table
gives no rows; labels and other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.session import scratch, written

THRESHOLD = 0.9
SCALE = 1.0
PROBES = 4
BLOCK_ROWS = 4_096
#: Rows of a crowded cell that are compared with its other rows at once.
STRIP_ROWS = 256
#: Cells of up to so many rows are compared together with others.
SMALL_CELL = 64
#: Pairs that are judged at once.
PAIRS = 50_000
SEED = 8
#: Up to so many vectors: lattice blocks and tables, so many that pairs are found no less often than by the first setting.
SIZES = ((2_000_000, 3, 14), (200_000_000, 4, 32), (None, 5, 80))


def facets() -> np.ndarray:
    """The 240 shortest vectors of E8, by its rule: two signed ones, or eight signed halves with evenly many minus signs."""
    whole = [[s * (k == i) + t * (k == j) for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    half = [[x / 2 for x in signs] for signs in product((1, -1), repeat=8) if np.prod(signs) > 0]
    return np.array(whole + half)


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better one of D8 and its shift by halves."""

    def even(y):
        near = np.rint(y)
        gap = y - near
        odd = np.flatnonzero(near.sum(1) % 2 != 0)
        worst = np.abs(gap[odd]).argmax(1)
        near[odd, worst] += np.where(gap[odd, worst] >= 0, 1.0, -1.0)
        return near

    first, second = even(x), even(x - 0.5) + 0.5
    closer = ((x - first) ** 2).sum(1) <= ((x - second) ** 2).sum(1)
    return np.where(closer[:, None], first, second)


class Lattice:
    """Home and probed cells of unit vectors in every table."""

    def __init__(self, width: int, blocks: int, tables: int, scale: float = SCALE, probes: int = PROBES):
        rng = np.random.default_rng(SEED)
        self.planes = rng.standard_normal((tables, blocks, width, 8)) / np.sqrt(8)
        self.shift = rng.random((tables, blocks, 8))
        self.odd = rng.integers(1, 1 << 62, (blocks, 8)) * 2 + 1
        self.scale, self.probes, self.facets = scale, probes, facets()

    def _number(self, points: np.ndarray) -> np.ndarray:
        """A 64-bit number of each row of lattice points (doubled, they are whole)."""
        mixed = (np.rint(points * 2).astype(np.int64) * self.odd).sum((1, 2))
        mixed = (mixed ^ (mixed >> 31)) * np.int64(0x3C79AC492BA7B653)
        return mixed ^ (mixed >> 33)

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Columns: the home cell, then the probed cells."""
        with np.errstate(over="ignore"):
            places = np.stack([unit @ p / self.scale + s for p, s in zip(self.planes[table], self.shift[table], strict=True)], 1)
            points = np.stack([decode(places[:, b]) for b in range(places.shape[1])], 1)
            out = [self._number(points)]
            gain = ((places - points) @ self.facets.T).reshape(len(unit), -1)
            best = np.argpartition(-gain, self.probes, axis=1)[:, : self.probes]
            rows = np.arange(len(unit))
            for k in range(self.probes):
                moved = points.copy()
                moved[rows, best[:, k] // len(self.facets)] += self.facets[best[:, k] % len(self.facets)]
                out.append(self._number(moved))
        return np.stack(out, 1)


class Located:
    """Cells of some rows in every table that is asked for, each made once."""

    def __init__(self, lattice: Lattice, unit: np.ndarray):
        self.lattice, self.unit, self.made = lattice, unit, {}

    def cells(self, table: int) -> np.ndarray:
        if table not in self.made:
            self.made[table] = self.lattice.cells(self.unit, table)
        return self.made[table]


def links_once(located: Located, a: np.ndarray, b: np.ndarray, table: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Which linked pairs (numbers of located rows) their cell of their table is to count: no earlier table, and no lower cell of this one, finds them."""
    mine = np.ones(len(a), bool)
    for t in range(int(table.max(initial=-1)) + 1):
        cells = located.cells(t)
        home = cells[:, 0]
        same = home[a] == home[b]
        forth = (cells[a, 1:] == home[b][:, None]).any(1)
        back = (cells[b, 1:] == home[a][:, None]).any(1)
        lowest = np.where(forth & back, np.minimum(home[a], home[b]), np.where(forth, home[b], home[a]))
        here = np.where(same, home[a] == cell, lowest == cell)
        mine &= np.where(t < table, ~(same | forth | back), (t > table) | here)
    return mine


def _unit(raw: pa.Array, width: int) -> np.ndarray:
    raw = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
    at = np.frombuffer(raw.buffers()[1], np.int32, 1, raw.offset * 4)[0]
    x = np.frombuffer(raw.buffers()[2], "<f8", len(raw) * width, int(at)).reshape(len(raw), width)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(unit: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", unit[left], unit[right])


def small_pairs(starts: np.ndarray, sizes: np.ndarray):
    """Pairs (row numbers) of all rows of the same cell, in runs of bounded length."""
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, later = np.repeat(starts, sizes) + place, np.repeat(sizes, sizes) - 1 - place
    ends = np.cumsum(later)
    i = 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        n = later[i:j]
        left = np.repeat(row[i:j], n)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        i = j


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """One row per distinct usable vector: rep (a number, as ids may repeat), least (its smallest id), copies, raw (doubles, little-endian)."""
    sound = "vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"

    def flatten(batches):
        for batch in batches:
            raw = [np.array(x, "<f8").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    usable = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(sound)
    # Adding zero makes the two zeros of a float one.
    usable = usable.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    flat = usable.mapInArrow(flatten, "vec_id long, raw binary").distinct()
    distinct = flat.groupBy("raw").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    return distinct.withColumn("rep", F.monotonically_increasing_id())


def _runs(batches):
    """Tables of whole cells of one width, from batches sorted by their first five columns, of which width is the first."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = np.array([batch.column(i)[batch.num_rows - 1].as_py() for i in range(5)])
        first = np.array([batch.column(i)[0].as_py() for i in range(5)])
        if len(held) > 1 and (first == last).all() and sum(b.num_rows for b in held) < 4 * BLOCK_ROWS:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        columns = [whole.column(i).to_numpy() for i in range(5)]
        open_at = int(np.argmax(np.all([c == v for c, v in zip(columns, last, strict=True)], axis=0)))
        yield from _by_width(whole.slice(0, open_at), columns[0][:open_at])
        held = whole.slice(open_at).to_batches()
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield from _by_width(whole, whole.column(0).to_numpy())


def _by_width(table: pa.Table, widths: np.ndarray):
    cuts = [0, *(np.flatnonzero(widths[1:] != widths[:-1]) + 1).tolist(), len(widths)]
    for s, e in zip(cuts, cuts[1:], strict=False):
        if e > s:
            yield int(widths[s]), table.slice(s, e - s)


class Lattices:
    """One lattice per vector length; those of the last few lengths are kept."""

    def __init__(self, blocks: int, tables: int):
        self.blocks, self.tables, self.made = blocks, tables, {}

    def __getitem__(self, width: int) -> Lattice:
        if width not in self.made:
            if len(self.made) >= 4:
                self.made = {}
            self.made[width] = Lattice(width, self.blocks, self.tables)
        return self.made[width]


def near_links(reps: DataFrame, threshold: float = THRESHOLD, sizes=SIZES, folder: str | None = None) -> DataFrame:
    """Per distinct vector and task: rep, links (weighted by copies) and hub, a vector it is connected to."""
    n = reps.count()
    blocks, tables = next((b, t) for most, b, t in sizes if most is None or n <= most)

    def locate(batches):
        lattices = Lattices(blocks, tables)
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column(1).to_pylist()], np.int64) // 8
            for width in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == width))
                unit, ids = _unit(part.column(1), width), part.column(0).to_numpy()
                for t in range(tables):
                    cells = lattices[width].cells(unit, t)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(cells.size, width, np.int32)), pa.array(np.full(cells.size, t, np.int32)), pa.array(cells.ravel()), pa.array(np.repeat(ids, cells.shape[1])), pa.array(np.tile(np.arange(cells.shape[1]) == 0, len(ids)))],
                        names=["width", "table", "cell", "rep", "home"],
                    )

    found = written(reps.select("rep", "raw").mapInArrow(locate, "width int, table int, cell long, rep long, home boolean"), "cells", folder=folder)
    where = ["width", "table", "cell"]
    crowds = found.groupBy(*where).agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("all")).where("homes > 0 and all > 1")
    parts = F.ceil(F.col("all") / F.lit(BLOCK_ROWS)).cast("int")
    placed = found.join(crowds.select(*where, parts.alias("parts")), where)
    mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = placed.withColumn("mine", mine).withColumn("other", other)
    placed = placed.select(*where, F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "rep", "home", "mine")
    full = placed.join(reps.select("rep", "copies", "raw"), "rep").select(*where, "low", "high", "rep", "home", "mine", "copies", "raw")

    def compare(batches):
        lattices = Lattices(blocks, tables)
        for width, run in _runs(batches):
            columns = [run.column(i).to_numpy() for i in range(9)]
            _, table, cell, low, high, ids, home, part, copies = columns
            unit, lattice = _unit(run.column(9), width), lattices[width]
            starts = np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[1:5]], axis=0)) + 1])
            counts = np.diff(np.append(starts, len(ids)))

            def settled(left, right, crowd=None, first=0):
                """Links of these pairs: rows with their counts and hubs. ``crowd`` holds the cells of the rows from ``first`` on, where many pairs are of few rows."""
                # Two that only probe do not meet here; blocks meet once, a block with itself in one task.
                met = (home[left] | home[right]) & (ids[left] != ids[right]) & ((low[left] == high[left]) | (part[left] != part[right]))
                left, right = left[met], right[met]
                # In order of ids, so that a pair's cosine is the same number everywhere.
                left, right = np.where(ids[left] < ids[right], left, right), np.where(ids[left] < ids[right], right, left)
                good = _cosines(unit, left, right) >= threshold
                left, right = left[good], right[good]
                if not len(left):
                    return
                rows, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
                a, b = inverse[: len(left)], inverse[len(left) :]
                if crowd:
                    now = links_once(crowd, left - first, right - first, table[left], cell[left])
                else:
                    now = links_once(Located(lattice, unit[rows]), a, b, table[left], cell[left])
                a, b, left, right = a[now], b[now], left[now], right[now]
                if not len(left):
                    return
                count = np.bincount(a, copies[right], len(rows)) + np.bincount(b, copies[left], len(rows))
                hub = np.arange(len(rows))
                while True:  # the smallest row number that a row reaches here
                    was = hub.copy()
                    np.minimum.at(hub, a, hub[b])
                    np.minimum.at(hub, b, hub[a])
                    hub = hub[hub]
                    if (hub == was).all():
                        break
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[rows[some]], count[some].astype(np.int64), ids[rows[hub[some]]])], names=["rep", "links", "hub"])

            small = (counts > 1) & (counts <= SMALL_CELL)
            for left, right in small_pairs(starts[small], counts[small]):
                yield from settled(left, right)
            for s, c in zip(starts[counts > SMALL_CELL].tolist(), counts[counts > SMALL_CELL].tolist(), strict=True):
                crowd = Located(lattice, unit[s : s + c])
                for i in range(s, s + c, STRIP_ROWS):
                    near = unit[i : min(i + STRIP_ROWS, s + c)] @ unit[i : s + c].T >= threshold - 1e-9
                    a, b = np.nonzero(near)
                    a, b = (x[a < b] + i for x in (a, b))
                    for k in range(0, len(a), PAIRS):
                        yield from settled(a[k : k + PAIRS], b[k : k + PAIRS], crowd, s)

    keys = [*where, "low", "high"]
    return written(full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "rep long, links long, hub long"), "links", folder=folder)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, sizes=SIZES) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""

    def flatten(batches):
        for batch in batches:
            raw = [None if x is None else np.array([np.nan if v is None else v for v in x], "<f8").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    with scratch(vectors.sparkSession, "lattice") as folder:
        reps = written(distinct_vectors(vectors), "vectors", folder=folder)
        links = near_links(reps, threshold, sizes, folder)
        parts = connected_components(links, "rep", "hub", folder).toDF("rep", "part")
        totals = links.groupBy("rep").agg(F.sum("links").alias("links"))
        facts = reps.join(totals, "rep", "left").join(parts, "rep", "left").withColumn("part", F.coalesce("part", "rep"))
        named = facts.groupBy("part").agg(F.min("least").alias("_component"))
        facts = written(facts.join(named, "part").select("raw", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), "_component"), "lattice")
    zeros = vectors.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("embedding"))
    rows = zeros.mapInArrow(flatten, "vec_id long, raw binary")
    found = rows.join(facts, "raw", "left")
    usable = F.col("rep").isNotNull() & F.col("vec_id").isNotNull()
    component = F.when(usable, F.col("_component")).otherwise(F.col("vec_id"))
    return found.select("vec_id", F.when(usable, F.col("_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
