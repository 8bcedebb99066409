"""N-gram Jaccard join: tiles of similar size, bitmap bounds, then exact intersections.

Texts of one shingle set form a class and go on as one. Two classes that are similar share one of their
rarest shingles: with shingles in any one order, the first n - ceil(t n) + 1 of each set are enough.
Classes that share such a shingle meet in a tile. A large tile is split by size bands and blocks, and
every pair of blocks of neighbouring bands is a tile. In a tile, the parity bitmaps of two sets bound
their overlap from above, and size and bound leave nearly similar pairs only. Their components form
groups; within a group, tiled in the same way, sets are intersected exactly and links fold into trees.

Rarity is a count of hashed shingles over all texts in a table of fixed size. It only orders shingles:
the result does not depend on it, but common ones would gather many classes in a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shingles
from plumbline.llm.components import Forest, connected
from plumbline.llm.frames import discard, row_bits, shuffles_go, stored, with_bits

#: Counters of shingles, and how many rows of them move together.
RARITY_BITS, RARITY_ROWS = 18, 16
#: Bits of a bitmap, and up to how many shingles a set has so many.
WIDTHS = ((256, 800), (1024, 3500), (4096, 2**62))
#: Classes in a block of a large tile of shared shingles, and of a large group.
TILE, GROUP_TILE = 4096, 1024
#: Bits of the filter that keeps sets outside all groups from moving.
FILTER_BITS = 23


def rarity(docs: DataFrame, size: int, text: str) -> np.ndarray:
    """A rank for each counter: the more shingles fall on it, the higher."""
    width = 1 << RARITY_BITS
    part = width // RARITY_ROWS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            texts = batch.column("t")
            for a, b in shingles.pieces(texts):
                hashes, before, _, _ = shingles.words(texts.slice(a, b - a), fold=True)
                grams, _ = shingles.windows(hashes, before, size)
                total += np.bincount((grams >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=width)
        yield pa.record_batch(
            [pa.array(range(RARITY_ROWS), pa.int32()), pa.array([total[i * part : (i + 1) * part].astype("<i8").tobytes() for i in range(RARITY_ROWS)])],
            names=["part", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                row = np.frombuffer(counts.as_buffer(), dtype="<i8")
                sums[key] = sums[key] + row if key in sums else row.copy()
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()])], names=["part", "counts"])

    schema = "part int, counts binary"
    counted = docs.select(F.col(text).alias("t")).mapInArrow(count, schema)
    with shuffles_go(docs.sparkSession):
        rows = counted.repartition(RARITY_ROWS, "part").mapInArrow(add, schema).collect()
    total = np.zeros((RARITY_ROWS, part), dtype=np.int64)
    for row in rows:
        total[row["part"]] += np.frombuffer(row["counts"], dtype="<i8")
    return np.floor(16 * np.log2(1 + total.ravel())).astype(np.uint64)


def _sets(texts: pa.Array, size: int, ranks: np.ndarray) -> list[np.ndarray]:
    """The shingle set of each text: keys in the order of rarity, each a rank and 54 bits of the hash."""
    hashes, before, _, _ = shingles.words(texts, fold=True)
    grams, first = shingles.windows(hashes, before, size)
    rank = ranks[(grams >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
    keys = (rank << np.uint64(54)) | (shingles.mix(grams) >> np.uint64(10))
    return [np.unique(keys[first[i] : first[i + 1]]) for i in range(len(texts))]


def _digest(keys: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(shingles.mix(np.sum(shingles.mix(keys), dtype=np.uint64, keepdims=True) + np.uint64(len(keys))).view(np.int64)[0])


def _bitmap(keys: np.ndarray) -> bytes:
    """Parities of hashed shingles: the ones of two bitmaps' difference never exceed the sets' difference."""
    width = next(bits for bits, most in WIDTHS if len(keys) <= most)
    odd = np.bincount((shingles.mix(keys) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bitmaps: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitmaps of at least ``bits`` bits folded to so many, and the row of each in that array or -1."""
    place, rows = np.full(len(bitmaps), -1), []
    for i, held in enumerate(bitmaps):
        if len(held) * 8 >= bits:
            place[i] = len(rows)
            rows.append(np.bitwise_xor.reduce(np.frombuffer(held, dtype=np.uint64).reshape(-1, bits // 64), axis=0))
    return np.array(rows, dtype=np.uint64).reshape(len(rows), bits // 64), place


def prefix_length(n: int, percent: int) -> int:
    """How many of the rarest of n shingles a similar set shares one of: n - ceil(percent n / 100) + 1."""
    return n - -(-percent * n // 100) + 1


def _near(
    tiles: np.ndarray, sizes: np.ndarray, bitmaps: list[bytes], percent: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs in one tile whose sizes and bitmaps allow the similarity. Rows are sorted by
    (tile, size), so a row's partners follow it until their size is too large."""
    folded = [_folded(bitmaps, bits) for bits, _ in WIDTHS]
    active = np.arange(len(tiles) - 1)
    step = 1
    while len(active):
        active = active[active + step < len(tiles)]
        other = active + step
        keep = (tiles[active] == tiles[other]) & (100 * sizes[active] >= percent * sizes[other])
        active, other = active[keep], other[keep]
        a, b = active, other
        for rows, place in folded:
            # An overlap of o needs o (100 + percent) >= percent * total, and 2 o <= total - difference.
            total = sizes[a] + sizes[b]
            room = total * (100 - percent) // (100 + percent)
            both = np.flatnonzero((place[a] >= 0) & (place[b] >= 0))
            apart = np.bitwise_count(rows[place[a[both]]] ^ rows[place[b[both]]]).sum(axis=1, dtype=np.int64)
            near = np.ones(len(a), dtype=bool)
            near[both] = apart <= room[both]
            a, b = a[near], b[near]
        if len(a):
            yield a, b
        step += 1


def _by_tile(
    batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch], None], rows: int = 20_000
) -> None:
    """Hand batches of whole tiles, of at least ``rows`` rows but the last, to ``work``."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        tile = batch.column("tile")
        last = tile[-1]
        if count < rows or tile[0] == last and len(held) > 1 and held[0].column("tile")[0] == last:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        column = table.column("tile").to_numpy()
        cut = int(np.searchsorted(column != column[-1], False)) if column[0] == column[-1] else len(column) - int(np.argmax((column != column[-1])[::-1]))
        if cut:
            work(table.slice(0, cut))
        held = table.slice(cut).combine_chunks().to_batches()
        count = len(column) - cut
    if count:
        work(pa.Table.from_batches(held).combine_chunks())


def _tiled(frame: DataFrame, key: str, count: str, block: int, percent: int) -> DataFrame:
    """``tile`` for each row: one where the key has at most ``block`` rows. Otherwise rows are dealt to
    size bands and blocks, and each goes to the tiles of its band and the one below with every block."""
    blocks = F.ceil(F.col(count) / block).cast("int")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    every = F.flatten(
        F.transform(
            F.array(band - 1, band),
            lambda low: F.transform(
                F.sequence(F.lit(0), blocks - 1),
                lambda other: F.xxhash64(F.col(key), low, F.least(own, other), F.greatest(own, other)),
            ),
        )
    )
    return frame.withColumn("tile", F.explode(F.when(blocks <= 1, F.array(F.xxhash64(F.col(key)))).otherwise(every)))


def _links(tiled: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Links (a, b) of the tiles, folded into trees by each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def work(table: pa.Table) -> None:
            table = table.sort_by([("tile", "ascending"), ("n", "ascending"), ("node", "ascending")])
            tiles, sizes, nodes = (table.column(c).to_numpy() for c in ("tile", "n", "node"))
            if len(nodes) > 1:
                # A class may come once for each task that met one of its texts.
                new = np.append(True, (tiles[1:] != tiles[:-1]) | (nodes[1:] != nodes[:-1]))
                if not new.all():
                    table = table.filter(pa.array(new))
                    tiles, sizes, nodes = tiles[new], sizes[new], nodes[new]
            bitmaps = table.column("bitmap").to_pylist()
            sets = [np.frombuffer(s, dtype=np.uint64) for s in table.column("keys").to_pylist()] if exact else []
            for left, right in _near(tiles, sizes, bitmaps, percent):
                for i, j in zip(left.tolist(), right.tolist(), strict=True):
                    a, b = int(nodes[i]), int(nodes[j])
                    if forest.root(a) == forest.root(b):
                        continue
                    if exact:
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if 100 * both < percent * (len(sets[i]) + len(sets[j]) - both):
                            continue
                    forest.link(a, b)

        _by_tile(batches, work)
        low, high = forest.links()
        yield pa.record_batch([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])

    parts = int(tiled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiled.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def jaccard_components(
    docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id that links reach; then row, the place
    in the scan, and component, a name of the component (null for an empty set).

    A set holds the distinct windows of ``size`` words, A-Z as a-z; a text with fewer words has its whole
    sequence as its one shingle. Texts link when 100 * intersection >= percent * union. A text that is
    null, empty or without words has the empty set and links with nothing. Rows of equal id are texts of
    their own; a component takes the smallest id of its rows, null only when all its ids are.
    Shingles are told apart by 54 bits of a hash, sets by 64.
    """
    spark = docs.sparkSession
    frame = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    kind = dict(frame.dtypes)["doc_id"]
    ranks = spark.sparkContext.broadcast(rarity(docs, size, text))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t")
            for start, stop in shingles.pieces(texts):
                sets = _sets(texts.slice(start, stop - start), size, ranks.value)
                yield pa.record_batch(
                    [
                        batch.column("row").slice(start, stop - start),
                        batch.column("doc_id").slice(start, stop - start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([s[: prefix_length(len(s), percent)].view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                        pa.array([_bitmap(s) for s in sets], pa.binary()),
                    ],
                    names=["row", "doc_id", "n", "node", "prefix", "bitmap"],
                )

    signed = stored(
        frame.mapInArrow(sign, f"row long, doc_id {kind}, n long, node long, prefix array<long>, bitmap binary"), "signed"
    )
    classes = stored(
        signed.where("node is not null")
        .groupBy(F.col("node").alias("class"))
        .agg(F.min("row").alias("first"), F.min("doc_id").alias("least_id")),
        "classes",
    )
    firsts = row_bits(classes, "first")
    single = with_bits(signed, "row", firsts)
    postings = single.select("node", "n", F.explode("prefix").alias("token"))
    counts = postings.groupBy(F.col("token").alias("shared")).agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    met = stored(postings.join(counts, F.col("token") == F.col("shared")).select("token", "node", "n", "count"), "met")
    # Shingles that the same classes share make the same tile: one of them is enough.
    chosen = (
        met.groupBy("token", "count")
        .agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
        .groupBy("count", "x", "y")
        .agg(F.min("token").alias("chosen"))
        .select("chosen")
    )
    every, met = met, met.join(chosen, F.col("token") == F.col("chosen")).select("token", "node", "n", "count")
    placed = _tiled(met, "token", "count", TILE, percent).select("tile", "node", "n")
    bitmaps = single.select(F.col("node").alias("class"), "bitmap")
    tiled = placed.join(bitmaps, F.col("node") == F.col("class")).select("tile", "node", "n", "bitmap")
    trees = connected(_links(tiled, percent, exact=False))
    groups = stored(trees, "groups")
    discard(every, firsts, trees)

    slot = F.pmod(F.col("node"), F.lit(1 << FILTER_BITS))
    flags = np.zeros((1 << FILTER_BITS) // 32, dtype=np.uint32)
    with shuffles_go(spark):
        words = groups.groupBy((slot / 32).cast("int").alias("word")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(node, {1 << FILTER_BITS}) % 32 as int))")).alias("bits")
        ).toPandas()
    flags[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    kept = spark.sparkContext.broadcast(flags)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            texts = batch.column("t")
            for start, stop in shingles.pieces(texts):
                rows = []
                for keys in _sets(texts.slice(start, stop - start), size, ranks.value):
                    if len(keys):
                        node = _digest(keys)
                        at = node & ((1 << FILTER_BITS) - 1)
                        if kept.value[at >> 5] >> np.uint32(at & 31) & np.uint32(1) and node not in sent:
                            sent.add(node)
                            rows.append((node, len(keys), _bitmap(keys), keys.tobytes()))
                columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "n", "bitmap", "keys"])

    sets = frame.select("t").mapInArrow(gather, "node long, n long, bitmap binary, keys binary")
    sized = groups.join(
        groups.groupBy(F.col("root").alias("group")).agg(F.count(F.lit(1)).alias("count")), F.col("root") == F.col("group")
    ).select(F.col("node").alias("member"), "group", "count")
    grouped = sets.join(sized, F.col("node") == F.col("member")).select("node", "n", "bitmap", "keys", "group", "count")
    exact = _tiled(grouped, "group", "count", GROUP_TILE, percent).select("tile", "node", "n", "bitmap", "keys")
    trees = connected(_links(exact, percent, exact=True))
    roots = stored(trees, "components")
    discard(groups, trees)

    named = classes.select("class", "least_id").join(roots, F.col("class") == F.col("node"), "left").select(
        "class", "least_id", F.coalesce("root", "class").alias("root")
    )
    least = named.groupBy(F.col("root").alias("top")).agg(F.min("least_id").alias("component_id"))
    placed_classes = named.join(least, F.col("root") == F.col("top")).select("class", "component_id", "root")
    found = (
        signed.select("row", "doc_id", F.col("n").alias("n_shingles"), "node")
        .join(placed_classes, F.col("node") == F.col("class"), "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            "row",
            F.col("root").alias("component"),
        )
    )
    found.read_from = (signed, classes, roots)
    return found


def without_near_copies(
    docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id (null ids last), then the
    first in the scan. Texts without a word stay.

    ``docs`` is read more than once and has to give its rows in the same partitions each time, as a
    table does.
    """
    components = jaccard_components(docs, size, percent, doc_id, text)
    found = stored(components, "copies")
    discard(*components.read_from)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row")
    firsts = (
        found.where("component is not null").groupBy("component").agg(F.min(rank).alias("first")).select("first.row")
    )
    kept = row_bits(firsts.unionByName(found.where("component is null").select("row")), "row")
    discard(found)
    return with_bits(docs.withColumn("__row", F.monotonically_increasing_id()), "__row", kept).select(*docs.columns)
