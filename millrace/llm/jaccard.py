"""Exact Jaccard join over word shingles by T-occurrence search.

A document that links to one of n shingles or more shares at least T of them
with it, T growing with both sizes. The search is DivideSkip: a document's inverted
lists are divided by length, the short ones are merged and counted, what
reaches T less the number of long lists is a candidate, and the long lists are
probed for the candidates by binary search. Lists are sorted runs held in one
array; their merge is a vectorised count over members, the form that a heap
takes in numpy. Long lists join the merge where that reads less than probing.

Scale. The search runs inside bounded blocks that Spark deals out; before it,
three exact steps take away what cannot link:

1. Documents with equal shingle sets are one class (128-bit digest).
2. A class needs ceil(80 % of n) shingles that another class holds too. Over a
   fixed share of the hash space (``SHARE`` sixteenths), every shingle of every
   class is counted; a class with more unique ones than it may have links with
   nothing. Most of a corpus ends here, at the cost of a third of its shingles.
3. For the classes left, all shingles are counted among themselves, unique ones
   are dropped and the rest kept by rarity ("core"). Classes that share one of
   the rarest of their core, just enough that every partner does, form groups.

Groups are cut into blocks of bounded size. Blocks are first searched within;
then classes are dealt anew by the component found so far, so blocks inside one
component are never compared with each other and only pairs across components
are searched, block by block. A task returns one row per class (its leader),
never pairs. Counts combine before the shuffle and all joins are equi-joins that
adaptive execution may split, so neither a shingle nor a set of copies that a
third of all rows share is one task's burden.

Defined cases: null, empty and blank texts have an empty set, link with nothing
and are their own component; texts of fewer than five words are one shingle;
rows that repeat ``doc_id`` each get a row and are one node, as a component is
a set of ids: what links to any of them is in the component of all; null ids
take part but a component is named by its smallest id (null if it has none); a
text of any length is read whole; a pair at exactly the limit links; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.shingles import WORDS, shingle_sets
from millrace.session import fresh, release, scratch, written

PERCENT = 80
#: Sixteenths of the hash space in which unique shingles are counted for all classes.
SHARE = 5
#: Shingles of a block's classes together; a class that holds more is a block of its own.
BLOCK_SHINGLES = 1 << 17
#: Classes that a task remembers to have seen already.
SEEN = 200_000
#: Cost of a long list in the division of lists, as in the published rule.
MU = 0.0085


def least_shared(n: int) -> int:
    """Shingles that a set of n must share with any partner."""
    return -(-PERCENT * n // 100)


def _least_shared(n):
    return F.expr(f"({PERCENT} * {n} + 99) div 100")


def class_key(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set as two signed longs."""
    n = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (n >> 64) - (1 << 63), (n & (1 << 64) - 1) - (1 << 63)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    borders = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=borders[1:])
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(borders), pa.array(flat))


def document_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, mark (text hash), n, high and low (class), and part: the class's shingles in the counted share of the hash space, once per task."""
    below = np.uint64(SHARE << 60)

    def run(batches):
        seen: set = set()
        for batch in batches:
            sizes, keys, parts = [], [], []
            for own in shingle_sets(batch.column(2), words):
                key = class_key(own)
                sizes.append(len(own))
                keys.append(key)
                parts.append(own[:0] if key in seen else own[: np.searchsorted(own, below)].copy())
                seen.add(key)
            if len(seen) > SEEN:
                seen = set()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array([h for h, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.int64()), _lists(parts)], names=["doc_id", "mark", "n", "high", "low", "part"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, n long, high long, low long, part array<long>")


def linkable_classes(sets: DataFrame) -> DataFrame:
    """Classes that are not ruled out by unique shingles: high, low, n, and the smallest row (doc_id, mark) of each."""
    classes = sets.where("n > 0").groupBy("high", "low").agg(F.max("n").alias("n"), F.min(F.struct("doc_id", "mark")).alias("row"))
    # Half a digest tells the holders of one shingle apart; classes that share it with another class are never ruled out.
    holders = sets.select("high", F.explode("part").alias("shingle")).groupBy("shingle").agg(F.min("high").alias("high"), F.max("high").alias("last"))
    counts = holders.where("high = last").groupBy("high").agg(F.count("*").alias("lonely"))
    alike = classes.groupBy("high").agg(F.count("*").alias("alike"))
    facts = counts.join(alike, "high").where("alike = 1").select("high", "lonely")
    left = classes.join(facts, "high", "left").where(F.coalesce("lonely", F.lit(0)) <= F.col("n") - _least_shared("n"))
    return left.select("high", "low", "n", F.col("row.doc_id").alias("doc_id"), F.col("row.mark").alias("mark"), F.monotonically_increasing_id().alias("class"))


def class_shingles(docs: DataFrame, classes: DataFrame, words: int = WORDS) -> DataFrame:
    """class, n and all shingles of the listed classes, each read from one row."""

    def run(batches):
        for batch in batches:
            found = list(shingle_sets(batch.column(4), words))
            # Two texts of one id and one text hash are told apart by their sets.
            good = [class_key(own) == key for own, key in zip(found, zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True), strict=True)]
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), _lists(found)], names=["class", "n", "shingles"])
            yield made.filter(pa.array(good, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    # By merge at every size: a table of classes grows with the corpus.
    wanted = classes.toDF("high", "low", "n", "_doc_id", "_mark", "class").hint("merge")
    rows = texts.join(wanted, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))).select("class", "high", "low", "n", "text")
    return rows.mapInArrow(run, "class long, n long, shingles array<long>")


def cores(found: DataFrame, folder: str) -> DataFrame:
    """class, n and core: its shingles that another listed class holds too, rarest first; only classes with enough of them."""
    rows = found.select("class", "n", F.explode("shingles").alias("shingle"))
    # Written, so that the join has no aggregate beside it and a hot shingle's rows can be split.
    counts = written(rows.groupBy("shingle").agg(F.count("*").alias("classes")).where("classes > 1"), "counts", folder=folder)
    shared = rows.join(counts, "shingle").groupBy("class", "n").agg(F.array_sort(F.collect_set(F.struct("classes", "shingle"))).alias("core"))
    return shared.where(F.size("core") >= _least_shared("n")).select("class", "n", F.col("core.shingle").alias("core"))


def candidate_groups(core: DataFrame, folder: str) -> DataFrame:
    """class and group; classes of different groups share no list that a link would need."""
    rarest = F.slice("core", F.lit(1), (F.size("core") - _least_shared("n") + 1).cast("int"))
    lists = written(core.select("class", F.explode(rarest).alias("shingle")), "lists", folder=folder)
    lowest = lists.groupBy("shingle").agg(F.min("class").alias("least"), F.count("*").alias("all")).where("all > 1").drop("all")
    lowest = written(lowest, "lowest", folder=folder)
    return connected_components(lists.join(lowest, "shingle").select("class", "least").distinct(), "class", "least", folder).toDF("class", "group")


def _flat(core: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    core = core.combine_chunks() if isinstance(core, pa.ChunkedArray) else core
    lengths = np.diff(core.offsets.to_numpy())
    return core.flatten().to_numpy(), lengths


def divide_skip(sizes: np.ndarray, shingles: np.ndarray, lengths: np.ndarray, side: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Leader (a row number) of every class of a block after all its links are found.

    ``shingles`` holds the sets one after another, of which only shared ones
    count; ``sizes`` are the full set sizes. Pairs of equal ``side`` are not
    compared (-1 compares with all), nor are those of one ``known`` component.
    """
    order = np.argsort(sizes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    sizes, side, count = sizes[order], side[order], len(order)
    label = np.unique(known[order], return_inverse=True)[1]
    label = np.minimum.reduceat(np.arange(count)[np.argsort(label, kind="stable")], np.flatnonzero(np.diff(np.sort(label), prepend=-1)))[label] if count else label
    codes = np.unique(shingles, return_inverse=True)[1]
    owner = np.repeat(rank, lengths)
    keyed = np.sort(codes * count + owner)  # the lists, one after another, each in order of its members
    member = keyed % count
    borders = np.searchsorted(keyed, np.arange((codes.max() + 1 if len(codes) else 0) + 1) * count)
    long = np.diff(borders)
    by_class = np.argsort(owner, kind="stable")
    codes, ends = codes[by_class], np.cumsum(np.bincount(owner, minlength=count))
    begins = ends - np.bincount(owner, minlength=count)
    for x in range(count):
        own, n = codes[begins[x] : ends[x]], int(sizes[x])
        # Partners of a smaller set were met from their side, so T is that of two equal sizes.
        least = -(-2 * PERCENT * n // (100 + PERCENT))
        if len(own) < least:
            continue
        own = own[np.argsort(long[own], kind="stable")]
        reach = long[own]
        skipped = min(least - 1, int(least / (MU * np.log2(max(2, int(reach[-1]))) + 1)))
        short = len(own) - skipped
        total = int(reach[:short].sum())
        if total == short:
            continue  # only x itself is in them
        met = _members(member, borders, own[:short], reach[:short])
        hits = np.bincount(met[met > x], minlength=count)
        likely = np.flatnonzero(hits >= least - skipped)
        fits = (sizes[likely] * PERCENT <= n * 100) & (label[likely] != label[x])
        if side[x] >= 0:
            fits &= side[likely] != side[x]
        likely = likely[fits]
        if not len(likely):
            continue
        shared = hits[likely]
        if skipped:
            rest = own[short:]
            if int(reach[short:].sum()) < 16 * len(rest) * len(likely):
                shared = shared + np.bincount(_members(member, borders, rest, reach[short:]), minlength=count)[likely]
            else:
                probe = (rest[:, None] * count + likely).ravel()
                at = np.minimum(np.searchsorted(keyed, probe), len(keyed) - 1)
                shared = shared + (keyed[at] == probe).reshape(len(rest), -1).sum(0)
        linked = likely[shared * (100 + PERCENT) >= PERCENT * (n + sizes[likely])]
        if len(linked):
            joined = np.unique(np.append(label[linked], label[x]))
            label[np.isin(label, joined)] = joined[0]
    return order[label[rank]]


def _members(member: np.ndarray, borders: np.ndarray, lists: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Members of several lists, one after another."""
    last = np.cumsum(reach)
    return member[np.repeat(borders[lists] - last + reach, reach) + np.arange(last[-1])]


def _runs(batches, keys: int):
    """Tables of whole groups from batches sorted by their first ``keys`` columns."""
    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[s] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _search(placed: DataFrame) -> DataFrame:
    """Leaders (a, b) from rows (group, one, two, block, known, class, n, core) dealt by their first three."""

    def run(batches):
        for table in _runs(batches, 3):
            one, two = table.column(1)[0].as_py(), table.column(2)[0].as_py()
            if table.num_rows < 2:
                continue
            classes, known = table.column(5).to_numpy(), table.column(4).to_numpy()
            flat, lengths = _flat(table.column(7))
            side = np.full(len(classes), -1) if one == two else (table.column(3).to_numpy() == one).astype(np.int64)
            hub = divide_skip(table.column(6).to_numpy(), flat, lengths, side, known)
            moved = np.flatnonzero(classes[hub] != classes)
            yield pa.RecordBatch.from_arrays([pa.array(classes[moved]), pa.array(classes[hub[moved]])], names=["a", "b"])

    keys = ["group", "one", "two"]
    rows = placed.select(*keys, "block", "known", "class", "n", "core")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def class_links(core: DataFrame, groups: DataFrame, folder: str, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b) that join every component of linked classes."""
    placed = core.join(groups, "class")
    sizes = groups.join(core.select("class", F.size("core").alias("weight")), "class").groupBy("group").agg(F.sum("weight").alias("weight"))
    sizes = written(sizes.select("group", F.ceil(F.col("weight") / F.lit(float(block))).cast("int").alias("blocks")), "groups", folder=folder)
    mine = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    first = placed.join(sizes, "group").withColumn("block", mine).withColumn("known", F.col("class"))
    links = written(_search(first.withColumn("one", F.col("block")).withColumn("two", F.col("block"))), "links", folder=folder)
    wide = sizes.where("blocks > 1").select("group")
    if not wide.limit(1).count():
        return links
    parts = connected_components(links, folder=folder).toDF("class", "part")
    # Dealt anew: large components fill blocks of their own, small ones share blocks.
    rest = placed.join(wide, "group").join(parts, "class", "left").withColumn("known", F.coalesce("part", "class")).drop("part")
    weights = rest.groupBy("group", "known").agg(F.ceil(F.sum(F.size("core")) / F.lit(float(block))).cast("int").alias("own"), F.sum(F.size("core")).alias("weight"))
    weights = written(weights, "weights", folder=folder)
    mixed = weights.where("own = 1").groupBy("group").agg(F.ceil(F.sum("weight") / F.lit(float(block))).cast("int").alias("mixed"))
    weights = weights.join(mixed, "group", "left").withColumn("mixed", F.coalesce("mixed", F.lit(0)))
    # The name of a block: its component and a number; mixed ones have none and say so by a negative number.
    pure = F.struct(F.col("known").alias("part"), F.pmod(F.xxhash64("class"), F.col("own")).cast("int").alias("k"))
    shared = F.struct(F.lit(None).cast("long").alias("part"), F.pmod(F.xxhash64("known", F.lit(1)), F.col("mixed")).cast("int").alias("k"))
    named = rest.join(weights.select("group", "known", "own", "mixed"), ["group", "known"]).withColumn("name", F.when(F.col("own") > 1, pure).otherwise(shared)).drop("own", "mixed")
    named = written(named, "named", folder=folder)
    # As many rows as blocks; a block meets those of its group that another component has part in.
    blocks = named.select("group", "name").distinct().withColumn("number", F.xxhash64("group", "name.part", "name.k"))
    blocks = written(blocks, "blocks", folder=folder)
    other = blocks.select("group", F.col("name").alias("_name"), F.col("number").alias("_number"))
    met = blocks.join(other, "group").where("name.part is null or _name.part is null or name.part <> _name.part").select("group", "name", F.col("number").alias("block"), F.least("number", "_number").alias("one"), F.greatest("number", "_number").alias("two"))
    key = (F.col("name.part").eqNullSafe(F.col("_part"))) & (F.col("name.k") == F.col("_k")) & (F.col("group") == F.col("_group"))
    met = met.select(F.col("group").alias("_group"), F.col("name.part").alias("_part"), F.col("name.k").alias("_k"), "block", "one", "two")
    return links.union(written(_search(named.join(met, key)), "links-across", folder=folder))


def _joined(docs: DataFrame, folder: str, block: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """Sets of all documents, and (high, low, part) of the classes with links."""
    spark = docs.sparkSession
    sets = written(document_sets(docs), "sets", folder=folder)
    classes = written(linkable_classes(sets), "classes", folder=folder)
    release(spark)
    every = written(class_shingles(docs, classes), "shingles", folder=folder)
    release(spark)
    core = written(cores(every, folder), "core", folder=folder)
    release(spark)
    links = class_links(core, candidate_groups(core, folder), folder, block)
    parts = connected_components(links, folder=folder).toDF("class", "part")
    return sets, classes.select("high", "low", "class").join(parts, "class").select("high", "low", "part")


def _named(docs: DataFrame, folder: str, block: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, mark, n and component (by class number, or by digest where a class has no links; null without words) of every row."""
    sets, parts = _joined(docs, folder, block)
    found = sets.drop("part").join(parts, ["high", "low"], "left")
    linked = F.col("part").isNotNull()
    name = F.struct(linked.alias("linked"), F.when(linked, F.col("part")).otherwise(F.col("high")).alias("x"), F.when(linked, F.lit(0)).otherwise(F.col("low")).alias("y"))
    return found.select("doc_id", "mark", "n", F.when(F.col("n") > 0, name).alias("component"))


def join(docs: DataFrame, block: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    with scratch(docs.sparkSession, "jaccard") as folder:
        rows = written(_named(docs, folder, block), "named", folder=folder)
        least = written(rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least")), "least", folder=folder)
        named = rows.join(least, "component", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component"))
        # Rows that repeat an id tie the components of their texts together.
        several = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
        ties = named.where("n > 0").join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
        ends = connected_components(ties, folder=folder).toDF("component", "end")
        out = named.join(ends, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("end", "component").alias("component_id"))
        return written(out, "jaccard")


def keep_first(docs: DataFrame, block: int = BLOCK_SHINGLES) -> DataFrame:
    """All columns of ``docs``, one row of each group of linked texts; rows without words all stay.

    Groups are of texts here: rows that share only an id are not tied together.
    The row that stays has the smallest ``doc_id`` (null last), then the
    smallest hash of the text; of rows equal in both, the smallest in the other
    columns as text.
    """
    with scratch(docs.sparkSession, "jaccard") as folder:
        rows = _named(docs, folder, block).where("n > 0")
        first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("row"))
        first = written(first.select(F.col("row.doc_id").alias("doc_id"), F.col("row.mark").alias("mark")), "jaccard-first")
    names = [fresh(docs, x) for x in ("_id", "_mark", "_own", "_place")]
    key, mark, own, place = names
    marked = docs.withColumn(own, F.xxhash64("text"))
    worded = F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    kept = marked.where(worded).join(first.toDF(key, mark).hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(mark)))
    others = [F.col(f"`{c}`").cast("string") for c in docs.columns if c.lower() not in ("doc_id", "text")]
    alone = kept.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", own).orderBy(*(others or [F.lit(0)])))).where(F.col(place) == 1)
    return alone.select(docs.columns).unionByName(docs.where(~worded))
