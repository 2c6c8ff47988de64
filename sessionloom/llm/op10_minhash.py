"""Near-duplicate documents by a chosen-path similarity join over minwise tokens, confirmed on full shingle sets.

1. Every text becomes its set of distinct word 5-shingles (64-bit hashes). Rows with equal sets form one class, so groups of
   copies shrink to one member before anything is compared.
2. A class is represented by ``COORDINATES`` minwise tokens. In each of ``TREES`` independent trees a class follows each token
   with probability 1 / (limit * COORDINATES) into a child node; classes of one node share all tokens on its path.
3. Nodes of up to ``LEAF`` classes are compared exhaustively, inside one task. Tokens first cut a leaf into groups: two classes
   are likely alike if their tokens are, with a margin of five standard deviations below the limit, so a true pair stays in
   one group but for one in some millions. Equal groups of many leaves are compared once.
4. Groups meet with their sets. A task links the classes of a group by exact intersections and hands on a forest of confirmed
   links, never pairs. Of a set with more than ``SKETCH`` shingles it has the smallest hashes; pairs of such sets that are
   likely linked by these are confirmed on the whole sets afterwards.
5. Larger nodes branch again. Their classes are first compared with a few random pivots of the node, and classes almost equal
   to a pivot leave, so a large group of near copies ends after one comparison each. Shares of unequal tokens add up like
   distances, so the likely partners of a class that left are all around its pivot; where these aren't one component
   already, the classes outside the largest component are compared with all of them, in blocks, as in 4.

A pair at the limit shares a leaf of one tree with probability above 0.6, so 16 trees miss less than one in a million.

Defined cases: null texts and texts without words have no shingles, link with nothing and are kept; texts of fewer than five
words are one shingle; repeated rows get equal answers. Rows without ``doc_id`` join only components of equal sets. Other
columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import list_array, mix, runs, stage, table, text_blocks, word_hashes
from .components import connected_components

WORDS = 5
COORDINATES = 64
TREES = 16
LEAF = 2048
#: Share of equal tokens from which a class leaves a large node for its pivot.
CLOSE = 0.92
#: Smallest hashes of a set that a group holds; sets up to this size are compared exactly.
SKETCH = 2048
#: Rows of a leaf or block that are compared with the others at once.
AT_ONCE = 64
#: Standard deviations between the limit and the estimates that decide against a pair.
MARGIN = 5

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_FACTORS = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_SEEDS = mix(np.arange(1001, 1001 + COORDINATES, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text behind one another, and n + 1 offsets."""
    words, edge, _, _ = word_hashes(data, off, _SEPARATOR, _LOWER)
    n = np.diff(edge)
    rows = []
    if len(words) >= WORDS:
        m = len(words) - WORDS + 1
        every = words[:m] * _FACTORS[0]
        for i in range(1, WORDS):
            every = every + words[i:m + i] * _FACTORS[i]
        every = mix(every)
    for a, k in zip(edge[:-1].tolist(), n.tolist()):
        if k >= WORDS:
            rows.append(np.unique(every[a:a + k - WORDS + 1]))
        elif k:
            rows.append(mix(np.asarray([(words[a:a + k] * _FACTORS[:k]).sum() + np.uint64(k)], np.uint64)))
        else:
            rows.append(np.zeros(0, np.uint64))
    return np.concatenate([np.zeros(0, np.uint64), *rows]), np.cumsum([0, *map(len, rows)])


def _set_ids(flat: np.ndarray, edge: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat), dtype=np.uint64)])
    return mix((total[edge[1:]] - total[edge[:-1]]) ^ (np.diff(edge).astype(np.uint64) << np.uint64(40))).view(np.int64)


def _sketches(batches):
    """A row for each text: set size, set id, and 64 minwise tokens of 32 bits."""
    for batch, data, off in text_blocks(batches):
        flat, edge = shingle_sets(data, off)
        n = np.diff(edge)
        full = np.flatnonzero(n)
        tokens = np.zeros((len(n), COORDINATES), np.uint32)
        if len(full):
            for c, seed in enumerate(_SEEDS):
                h = ((flat * seed) >> np.uint64(32)).astype(np.uint32)
                tokens[full, c] = np.minimum.reduceat(h, edge[:-1][full])
        none = n == 0
        raw = tokens.astype("<u4").tobytes()
        width = 4 * COORDINATES
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(_set_ids(flat, edge), pa.int64(), mask=none),
             pa.array([None if x else raw[i * width:(i + 1) * width] for i, x in enumerate(none.tolist())], pa.binary())],
            ["doc_id", "n_shingles", "set_id", "tokens"])


def _full_sets(batches):
    for batch, data, off in text_blocks(batches):
        flat, edge = shingle_sets(data, off)
        yield pa.RecordBatch.from_arrays(
            [pa.array(_set_ids(flat, edge), pa.int64()), list_array(flat.view(np.int64), edge, pa.int64())], ["set_id", "hashes"])


def _margin(percent: int, n: int) -> float:
    return MARGIN * float(np.sqrt(percent / 100 * (1 - percent / 100) / n))


def _likely(percent: int) -> int:
    """Least number of equal tokens of a pair that may be linked."""
    return int(np.floor(COORDINATES * (percent / 100 - _margin(percent, COORDINATES))))


def _tokens(batch, name: str = "tokens") -> np.ndarray:
    raw = b"".join(batch.column(name).to_pylist())
    return np.frombuffer(raw, "<u4").reshape(-1, COORDINATES)


def _branch(seeds: np.ndarray, node: np.ndarray, tokens: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and child nodes: each (coordinate, token) below a node is followed by all its classes or by none."""
    limit = np.uint64(2**64 / (level * COORDINATES))
    rows, children = [], []
    place = mix(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(77))
    for seed in seeds:
        h = mix(mix(tokens.astype(np.uint64) + place) + (node * np.uint64(0x9FB21C651E98DF25) + seed)[:, None])
        r, c = np.nonzero(h < limit)
        rows.append(r)
        children.append(mix(h[r, c] ^ np.uint64(0x5851F42D4C957F2D)))
    return np.concatenate(rows), np.concatenate(children)


def _grow(batches, trees: int, level: float):
    """Children of every class: below the roots of all trees, or below the node it stands in."""
    seeds = mix(np.arange(trees, dtype=np.uint64) + np.uint64(5))
    for big in batches:
        for lo in range(0, big.num_rows, 2048):
            batch = big.slice(lo, 2048)
            ids = batch.column("set_id").to_numpy()
            node = batch.column("node").to_numpy().view(np.uint64) if "node" in batch.schema.names else np.zeros(len(ids), np.uint64)
            rows, children = _branch(seeds, node, _tokens(batch), level)
            yield pa.RecordBatch.from_arrays([pa.array(children.view(np.int64)), pa.array(ids[rows])], ["node", "set_id"])


def _alike(tokens: np.ndarray, others: np.ndarray, sizes: np.ndarray, other_sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may be linked, by the number of equal tokens and by the sizes of the sets."""
    out = np.zeros((len(tokens), len(others)), bool)
    columns = np.ascontiguousarray(others.T)
    for lo in range(0, len(tokens), AT_ONCE):  # some rows at a time: the sizes of all pairs would take eight times the result, and four times over
        mine, own = tokens[lo:lo + AT_ONCE], sizes[lo:lo + AT_ONCE, None]
        equal = np.zeros((len(mine), len(others)), np.int8)
        for c in range(COORDINATES):
            equal += mine[:, c, None] == columns[c]
        out[lo:lo + AT_ONCE] = (equal >= _likely(percent)) & (100 * np.minimum(own, other_sizes) >= percent * np.maximum(own, other_sizes))
    return out


def _groups(batches, percent: int):
    """Groups of each leaf that likely pairs hold together; the same classes make the same group in every leaf."""
    names, members = [], []
    for leaf in runs(batches, "node"):
        ids, first = np.unique(leaf.column("set_id").to_numpy(), return_index=True)
        if len(ids) < 2:
            continue
        tokens, sizes = _tokens(leaf)[first], leaf.column("n_shingles").to_numpy()[first]
        near = _alike(tokens, tokens, sizes, sizes, percent)
        open_ = near.sum(axis=1) > 1
        while open_.any():
            group = np.zeros(len(ids), bool)
            fresh = np.arange(len(ids)) == np.argmax(open_)
            while fresh.any():
                group |= fresh
                fresh = near[fresh].any(axis=0) & ~group
            open_ &= ~group
            own = ids[group]
            names.append(mix(np.asarray([np.bitwise_xor.reduce(mix(own.view(np.uint64))) + np.uint64(len(own))], np.uint64))[0])
            members.append(own)
        if len(members) > 2048:
            yield _members(names, members)
            names, members = [], []
    if members:
        yield _members(names, members)


def _members(names: list, members: list[np.ndarray]) -> pa.RecordBatch:
    n = np.asarray([len(m) for m in members])
    part = np.repeat(np.asarray(names, np.uint64).view(np.int64), n)
    return pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.concatenate(members)), pa.array(np.repeat(n, n))], ["part", "set_id", "n"])


def _estimate(a: np.ndarray, b: np.ndarray, sketch: int) -> float:
    """Likeness of two sets by the smallest ``sketch`` hashes of either."""
    union = np.union1d(a, b)[:sketch]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / len(union)


def _links(batches, percent: int, sketch: int):
    """Links within each block that join different components: forests of exact ones, and others that whole sets must decide.

    Rows marked ``few`` are compared with the others, or with one another where a block has no others.
    """
    margin = _margin(percent, sketch)
    out = []
    for block in runs(batches, "block"):
        few, free, label = (block.column(c).to_numpy(zero_copy_only=False) for c in ("few", "free", "label"))
        ids, sizes, tokens = block.column("set_id").to_numpy(), block.column("n_shingles").to_numpy(), _tokens(block)
        hashes = block.column("hashes").combine_chunks()
        edge = hashes.offsets.to_numpy()
        flat = hashes.values.to_numpy()[edge[0]:edge[-1]].view(np.uint64)
        edge = edge - edge[0]
        codes = np.unique(flat, return_inverse=True)[1].astype(np.int32)
        marked = np.zeros(len(flat), bool)
        label = label.copy()
        rows = np.flatnonzero(few)
        others = rows if few.all() else np.flatnonzero(~few)
        for lo in range(0, len(rows), 512):
            part = rows[lo:lo + 512]
            near = _alike(tokens[part], tokens[others], sizes[part], sizes[others], percent)
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                x = int(part[i])
                partners = others[near[i]]
                partners = partners[(label[partners] != label[x]) & (free[x] | free[partners])]
                if few.all():
                    partners = partners[partners > x]
                mine = codes[edge[x]:edge[x + 1]]
                marked[mine] = True
                for y in partners.tolist():
                    if label[x] == label[y]:
                        continue
                    exact = bool(sizes[x] <= sketch and sizes[y] <= sketch)
                    if exact:
                        both = int(marked[codes[edge[y]:edge[y + 1]]].sum())
                        linked = 100 * both >= percent * (int(sizes[x]) + int(sizes[y]) - both)
                    else:
                        like = _estimate(flat[edge[x]:edge[x + 1]], flat[edge[y]:edge[y + 1]], sketch)
                        linked = like >= percent / 100 + margin
                        if not linked and like >= percent / 100 - margin:
                            out.append((int(ids[x]), int(ids[y]), False))
                    if linked:
                        out.append((int(ids[x]), int(ids[y]), exact))
                        label[label == label[y]] = label[x]
                marked[mine] = False
            if len(out) > 20_000:
                yield _found(out)
                out = []
    yield _found(out)


def _found(rows: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["a", "b", "exact"])


def _against_pivots(batches, least: float):
    """Pivots of its node that a class is alike by ``least`` or more; ``best`` marks the one it is most alike."""
    for big in batches:
        for lo in range(0, big.num_rows, 1024):
            batch = big.slice(lo, 1024)
            rows, pivots = _tokens(batch), batch.column("pivots")
            at, near, share, best = [], [], [], []
            for i, row in enumerate(rows):
                own = pivots[i].values
                known = np.frombuffer(b"".join(own.field("tokens").to_pylist()), "<u4").reshape(-1, COORDINATES)
                same = (known == row).mean(axis=1)
                some = np.flatnonzero(same >= least)
                at += [i] * len(some)
                near += own.field("set_id").take(pa.array(some)).to_pylist()
                share += same[some].tolist()
                best += (some == np.argmax(same)).tolist()
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(at), batch.column("set_id").take(at), pa.array(near, pa.int64()), pa.array(share, pa.float64()), pa.array(best, pa.bool_())],
                ["node", "set_id", "pivot", "alike", "best"])


def _confirm(batches, percent: int):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("a_hashes"), batch.column("b_hashes")):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            if percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
                keep.append(False)
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def candidates(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups of leaves ``(part, set_id, n)``, pairs of classes with their pivots, and ``(part, set_id, free)`` around pivots.

    Of the classes around a pivot, likely pairs that hold a free class are still to be compared.
    """
    near_limit = _likely(percent) / COORDINATES
    level_at = percent / 100
    narrow = classes.select("set_id", "tokens")
    level = stage(narrow.mapInArrow(lambda it: _grow(it, TREES, level_at), "node long, set_id long"), "nodes")
    leaves = []
    pairs = narrow.limit(0).select(F.col("set_id").alias("a"), F.col("set_id").alias("b"))
    around = narrow.limit(0).select(F.col("set_id").alias("part"), "set_id", F.lit(True).alias("free"))
    while True:
        sizes = stage(level.groupBy("node").agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("set_id")).alias("mark")).where("n > 1"), "sizes")
        # the same classes meet in many trees; one leaf stands for all
        chosen = sizes.where(F.col("n") <= LEAF).groupBy("n", "mark").agg(F.min("node").alias("node")).select("node")
        leaves.append(level.join(chosen, "node"))
        large = sizes.where(F.col("n") > LEAF).select("node", "n")
        if large.isEmpty():
            break
        big = stage(level.join(large, "node").join(narrow, "set_id"), "large")
        # about eight pivots a node, whatever its size
        chance = F.pmod(F.xxhash64("set_id", "node"), F.floor(F.col("n") / 8)) == 0
        pivots = big.where(chance).groupBy("node").agg(F.collect_list(F.struct("set_id", "tokens")).alias("pivots"))
        near = stage(big.select("node", "set_id", "tokens").join(pivots, "node").mapInArrow(
            lambda it: _against_pivots(it, CLOSE + near_limit - 1), "node long, set_id long, pivot long, alike double, best boolean"), "near")
        pairs = pairs.union(near.where(F.col("best") & (F.col("alike") >= near_limit) & (F.col("set_id") != F.col("pivot"))).select(
            *_ordered("set_id", "pivot")))
        leaves_it = F.col("best") & (F.col("alike") >= CLOSE)
        left = near.where(leaves_it).select("node", "set_id")
        around = around.union(near.select(F.xxhash64("node", "pivot").alias("part"), "set_id", leaves_it.alias("free")))
        level = stage(big.select("node", "set_id", "tokens").join(left, ["node", "set_id"], "left_anti").mapInArrow(
            lambda it: _grow(it, 1, level_at), "node long, set_id long"), "nodes")
    every = leaves[0]
    for more in leaves[1:]:
        every = every.union(more)
    sorted_leaves = (every.join(classes.select("set_id", "n_shingles", "tokens"), "set_id")
                     .repartition("node").sortWithinPartitions("node"))
    groups = sorted_leaves.mapInArrow(lambda it: _groups(it, percent), "part long, set_id long, n long").distinct()
    return stage(groups, "groups"), stage(pairs.distinct(), "pairs"), stage(around, "around")


def _labelled(rows: DataFrame, joined: DataFrame | None) -> DataFrame:
    """``rows`` with the components of their classes."""
    if joined is None:
        return rows.withColumn("label", F.col("set_id"))
    return rows.join(joined.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))


def _group_blocks(groups: DataFrame, joined: DataFrame | None) -> DataFrame:
    """Groups of several components as blocks."""
    rows = _labelled(groups.select("part", "set_id"), joined)
    several = rows.groupBy("part").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("part")
    return rows.join(several, "part").select(
        F.col("part").alias("block"), "set_id", "label", F.lit(True).alias("few"), F.lit(True).alias("free"))


def _pivot_blocks(around: DataFrame, joined: DataFrame) -> DataFrame:
    """Blocks of about ``LEAF`` classes each way: the classes outside the largest component around a pivot, and all around it."""
    rows = stage(_labelled(around, joined), "labelled")
    sizes = rows.groupBy("part", "label").agg(F.count("*").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most")).where("n > most.n").select(
        "part", F.col("most.label").alias("most"), F.ceil((F.col("n") - F.col("most.n")) / LEAF).alias("down"), F.ceil(F.col("n") / LEAF).alias("across"))
    rows = rows.join(parts, "part")
    own = lambda n: F.pmod(F.xxhash64("set_id"), F.col(n))
    all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["set_id", "label", "free"]
    every = rows.select("part", *columns, F.lit(False).alias("few"), own("across").alias("j"), all_("down").alias("i"))
    few = rows.where("label != most").select("part", *columns, F.lit(True).alias("few"), all_("across").alias("j"), own("down").alias("i"))
    return every.unionByName(few).select(F.xxhash64("part", "i", "j").alias("block"), "set_id", "label", "few", "free")


def block_links(blocks: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links that join the components of each block."""
    sketch = SKETCH
    held = sets.select("set_id", F.slice("hashes", 1, sketch).alias("hashes")).dropDuplicates(["set_id"])
    met = (blocks.join(classes.select("set_id", "n_shingles", "tokens").join(held, "set_id"), "set_id")
           .repartition("block").sortWithinPartitions("block"))
    found = stage(met.mapInArrow(lambda it: _links(it, percent, sketch), "a long, b long, exact boolean"), "found")
    rest = confirmed_links(found.where("not exact").select(*_ordered("a", "b")).distinct(), sets, percent)
    return stage(found.where("exact").select("a", "b").union(rest), "links")


def confirmed_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of class ids whose full sets have 100 * intersection >= percent * union."""
    both = (pairs.join(sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("a_hashes")), "a")
            .join(sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("b_hashes")), "b"))
    return both.mapInArrow(lambda it: _confirm(it, percent), "a long, b long").distinct()


def linked_classes(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``(id, label)`` of the components of confirmed links between classes."""
    groups, pairs, around = candidates(classes, percent)
    ids = groups.select("set_id").union(pairs.select("a")).union(pairs.select("b")).union(around.select("set_id")).distinct()
    # an id may stand in rows with several texts; only the sets asked for meet a group
    texts = classes.join(ids, "set_id").select(F.col("first_doc").alias("doc_id")).join(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id").select("text")
    sets = stage(texts.mapInArrow(_full_sets, "set_id long, hashes array<long>"), "sets")
    # the largest group of every class first; of the others, only those that it left apart
    first = groups.groupBy("set_id").agg(F.max(F.struct("n", "part")).alias("m")).select(F.col("m.part").alias("part")).distinct()
    links = block_links(_group_blocks(groups.join(first, "part"), None), classes, sets, percent)
    links = links.union(stage(confirmed_links(pairs, sets, percent), "links"))
    joined = connected_components(links, "a", "b")
    blocks = stage(_group_blocks(groups, joined).unionByName(_pivot_blocks(around, joined)), "blocks")
    more = block_links(blocks, classes, sets, percent)
    return joined if more.isEmpty() else connected_components(links.union(more), "a", "b")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``; ``percent`` is the least Jaccard likeness."""
    sketches = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _sketches, "doc_id long, n_shingles long, set_id long, tokens binary"), "sketches")
    classes = stage(sketches.where("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("first_doc"), F.max("n_shingles").alias("n_shingles"), F.max("tokens").alias("tokens")), "classes")
    joined = linked_classes(docs, classes, percent)
    # these have a row for each class or component: none goes through the driver, whatever the session's limit
    part = classes.select("set_id", "first_doc").join(joined.withColumnRenamed("id", "set_id").hint("merge"), "set_id", "left")
    part = part.withColumn("label", F.coalesce("label", "set_id"))
    first = part.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    part = part.join(first.hint("merge"), "label").select("set_id", F.col("component_id").alias("_component"))
    out = sketches.drop("tokens").join(part.hint("merge"), "set_id", "left")
    component = F.coalesce("_component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents at a likeness of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_minhash_dedup": op10_minhash_dedup}
SQL: dict[str, str] = {}
