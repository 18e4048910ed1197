"""Near-duplicate groups: fast similarity sketching, banding, exact verification, components.

The sketch follows Dahlgaard, Knudsen and Thorup (FOCS 2017). In each of the first T rounds every
shingle falls in one of T bins; in round T + i all shingles fall in bin i. A bin keeps the lowest
(round, value) that reached it, so each of the T coordinates is filled after 2 T rounds at the
latest, and the share of equal coordinates of two sketches is concentrated about their Jaccard
similarity. Texts longer than a few hundred shingles need one or two rounds.

Buckets of bands are compared pair by pair if small, else with a leader. Members that a leader leaves apart
are banded again, more finely and independently; only buckets that still hold several components go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_ROWS, Table, bounded_batches, drop_ids, free_name, join_counted, new_path, scratch, small_side
from .components import connected_components
from .shingles import mix, shingle_sets

#: Buckets up to this size are compared pair by pair (at most half as many pairs a row), larger ones by stars.
SMALL_BUCKET = 12
#: Edges of one node that are verified together; its set is sent once for each such part of its edges.
STAR = 1024
#: When stars of fine bands leave members apart: sets in a block, its bytes (about: a longer set is alone with few others),
#: and blocks of either side that a task compares.
BLOCK, BLOCK_BYTES, TILE = 64, 16 << 20, 16


@dataclass(frozen=True)
class Banding:
    """Sketches of ``bins`` coordinates (a power of two), of which the first ``bands`` * ``rows`` are banded."""

    bins: int
    bands: int
    rows: int
    seed: int
    seeds: np.ndarray = field(init=False, repr=False)
    places: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        object.__setattr__(self, "seeds", rng.integers(0, 1 << 63, 2 * self.bins, dtype=np.uint64))
        object.__setattr__(self, "places", rng.integers(0, 1 << 63, (self.bands, self.rows), dtype=np.uint64) | np.uint64(1))

    def keys(self, sketches: list[np.ndarray]) -> np.ndarray:
        """The band keys of sketches, one after the other."""
        if not sketches:
            return np.zeros(0, dtype=np.uint64)
        grid = np.stack([x[: self.bands * self.rows] for x in sketches]).reshape(len(sketches), self.bands, self.rows)
        return mix((mix(grid) * self.places).sum(axis=2) + np.arange(self.bands, dtype=np.uint64)).ravel()


#: All sets: a pair of 85 % similarity shares no band with a probability of 4e-7 (80 %: 5e-5).
COARSE = Banding(128, 25, 5, 20_170_811)
#: Sets that a leader leaves apart: 3e-10 (80 %: 1e-5), and a pair of 60 % shares one in 100 * 0.6**10 = 0.6 bands, not 2.
FINE = Banding(1024, 100, 10, 20_171_016)


def sketch(shingles: np.ndarray, banding: Banding = COARSE) -> np.ndarray:
    """The coordinates of one non-empty set."""
    bins = banding.bins
    bits = bins.bit_length() - 1
    top, width = np.uint64(64 - bits), np.uint64(62 - 2 * bits)  # a key is bin, round (bits + 2), value
    places, low = np.arange(bins, dtype=np.uint64), (np.uint64(1) << width) - np.uint64(1)
    out, empty, at = np.zeros(bins, dtype=np.uint64), np.ones(bins, dtype=bool), 0
    while empty.any():
        rounds = np.arange(at, min(2 * bins, at + max(1, 6 * bins // len(shingles))), dtype=np.uint64)
        v = mix(shingles[None, :] ^ banding.seeds[rounds][:, None])
        free = v >> top
        bin_of = np.where(rounds[:, None] < bins, free, rounds[:, None] - np.uint64(bins)) if rounds[-1] >= bins else free
        keys = np.sort(((bin_of << top) | (rounds[:, None] << width) | (v & low)).ravel())
        first = np.searchsorted(keys, places << top)
        found = keys[np.minimum(first, len(keys) - 1)]
        filled = empty & (first < len(keys)) & (found >> top == places)
        out[filled] = found[filled]
        empty &= ~filled
        at += len(rounds)
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sums, xors, rows, full = [], [], [], [], []
        for i, s in enumerate(shingle_sets(batch.column("text"))):
            m = mix(s)
            n.append(len(s))
            sums.append(m.sum(dtype=np.uint64))
            xors.append(np.bitwise_xor.reduce(mix(m)) if len(s) else np.uint64(0))
            if len(s):
                rows.append(sketch(s))
                full.append(i)
        lens = np.zeros(len(n), dtype=np.int32)
        lens[full] = COARSE.bands
        flat = COARSE.keys(rows)
        bands = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lens))).astype(np.int32), pa.array(flat.view(np.int64)))
        whole = [np.array(x, dtype=np.uint64).view(np.int64) for x in (sums, xors)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), *map(pa.array, whole), bands], names=["id", "n", "fp1", "fp2", "bands"])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and fine bands of the non-empty sets."""
    for batch in batches:
        at, n, rows = [], [], []
        for i, s in enumerate(shingle_sets(batch.column("text"))):
            if len(s):
                at.append(i)
                n.append(len(s))
                rows.append(sketch(s, FINE))
        ends = np.arange(len(rows) + 1, dtype=np.int32) * FINE.bands
        bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(FINE.keys(rows).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int32())), pa.array(n, pa.int64()), bands], names=["id", "n", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"])


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres = batch.column("tb")
            fresh = np.ones(len(batch), dtype=bool)  # edges of a centre follow one another: its set is made once
            if len(batch) > 1:
                fresh[1:] = pc.not_equal(centres[1:], centres[:-1]).fill_null(True).to_numpy(zero_copy_only=False)
            heads, q, keep = shingle_sets(centres.filter(pa.array(fresh))), None, []
            for new, p in zip(fresh, shingle_sets(batch.column("ta")), strict=True):
                if new:
                    q = next(heads)
                small, big = sorted((p, q), key=len)
                both = int((big[np.minimum(np.searchsorted(big, small), len(big) - 1)] == small).sum()) if len(small) else 0
                keep.append(len(small) > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts with these distinct ids."""
    return texts.join(small_side(ids), "id", "left_semi")


def _sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The non-empty shingle sets of the texts with these ids."""
    schema = T.StructType([texts.schema["id"], T.StructField("shingles", T.BinaryType())])
    return _texts_of(texts, ids.distinct()).mapInArrow(_sets, schema).filter(F.length("shingles") > 0)


def _verified(texts: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose whole shingle sets are similar enough. b may have many edges, a has few.

    Texts are sent, and made sets where they meet: a set has eight bytes a word that don't compress.
    """
    kind = texts.schema["id"].dataType
    asked = Table(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked").df
    found = _texts_of(texts, asked)
    degree = Table(edges.groupBy("b").agg(F.count("*").alias("n"), F.ceil(F.count("*") / STAR).alias("salts")), "degrees").df
    dealt = join_counted(edges, degree, ["b"], "n").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")))
    centres = found.join(degree.select(F.col("b").alias("id"), "salts"), "id")
    centres = centres.select(F.col("id").alias("b"), F.col("text").alias("tb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
    pairs = dealt.join(found.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(centres, ["b", "salt"])
    return pairs.select("a", "b", "ta", "tb").mapInArrow(_linked(percent), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _block_pairs(percent: int):
    """Links between the sets of two blocks: for each left set, one for each group that it is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for row in range(len(batch)):
                sides = [batch.column(c)[row].values for c in ("left", "right")]
                sets = [[np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in side.field("shingles")] for side in sides]
                names = [side.field("c").to_numpy(zero_copy_only=False) for side in sides]
                flat = [np.concatenate(x) for x in sets]
                common = np.intersect1d(*flat)
                if not len(common):
                    continue
                grids = []
                for x, f in zip(sets, flat, strict=True):
                    owner, at = np.repeat(np.arange(len(x)), [len(y) for y in x]), np.minimum(np.searchsorted(common, f), len(common) - 1)
                    grid = np.zeros((len(x), len(common)), dtype=np.float32)
                    hit = common[at] == f
                    grid[owner[hit], at[hit]] = 1
                    grids.append(grid)
                both = grids[0] @ grids[1].T
                n = [np.array([len(y) for y in x]) for x in sets]
                near = (100 * both >= percent * (n[0][:, None] + n[1][None, :] - both)) & (names[0][:, None] != names[1][None, :])
                for i in np.flatnonzero(near.any(axis=1)):
                    js = np.flatnonzero(near[i])
                    out += [(row, i, js[k]) for k in np.unique(names[1][js], return_index=True)[1]]
            ids = [[batch.column(side)[r].values.field("id")[int((i, j)[k])].as_py() for r, i, j in out] for k, side in enumerate(("left", "right"))]
            kind = batch.schema.field("left").type.value_type.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in ids], names=["a", "b"])

    return run


def _block_links(texts: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Links of the members apart from their leader's group with all members of that leader.

    ``stars(leader, id, c, head)``. Both sides are cut in blocks of about BLOCK sets and BLOCK_BYTES, and the
    blocks in tiles of TILE: a task compares two tiles, and a block is sent once for each tile of the other
    side. A group of m members with r apart takes r * m / BLOCK**2 rows.
    """
    kind = texts.schema["id"].dataType
    rows = Table(stars.join(_sets_of(texts, stars.select("id")), "id"), "star-sets").df
    away, size = F.col("c") != F.col("head"), F.length("shingles")
    blocks = lambda n, total: F.greatest(F.ceil(n / BLOCK), F.ceil(total / BLOCK_BYTES), F.lit(1))
    sizes = rows.groupBy("leader").agg(F.count("*").alias("n"), blocks(F.count("*"), F.sum(size)).alias("rights"), blocks(F.count_if(away), F.coalesce(F.sum(F.when(away, size)), F.lit(0))).alias("lefts"))
    dealt = join_counted(rows, sizes, ["leader"], "n")
    member = F.collect_list(F.struct("id", "c", "shingles"))
    tiles = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / TILE)))

    def side(df: DataFrame, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.col(f"{name}s"))
        other = "rights" if name == "left" else "lefts"
        made = df.groupBy("leader", other, block.alias("block")).agg(member.alias(name))
        return made.select("leader", name, F.floor(F.col("block") / TILE).alias(f"{name}_tile"), tiles(other).alias(f"{other[:-1]}_tile"))

    pairs = side(dealt.filter(away), "left").join(side(dealt, "right"), ["leader", "left_tile", "right_tile"]).select("left", "right")
    return pairs.mapInArrow(_block_pairs(percent), T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Groups of documents linked by 100 * intersection >= ``percent`` * union of their shingle sets.

    Returns one row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id of the
    group) and ``kept`` (it is that smallest id). Only ``id_col`` and ``text_col`` are read.

    * A null, empty or blank text has no shingles and is linked with nothing.
    * Equal sets are one class: its smallest id stands for it, so copies cost no pairs.
    * Rows that repeat an id are one node; their texts' links meet in it. Each keeps its own n_shingles.
    * A row with a null id is linked with nothing, has a null component_id and is kept.
    * An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("n", "fp1", "fp2")), T.StructField("bands", T.ArrayType(T.LongType()))])
    spark, kept = docs.sparkSession, [new_path(docs.sparkSession, x) for x in ("class-of", "groups")]
    with scratch(spark):
        mapped, told = _groups(texts, schema, percent, kept)
    found = join_counted(mapped.filter("rep IS NOT NULL"), told, ["rep"], "copies", "left").select("id", "n", F.coalesce("component", "rep").alias("component_id"))
    out = found.unionByName(mapped.filter("rep IS NULL").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _groups(texts: DataFrame, schema: T.StructType, percent: int, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(id, n, rep)`` of every row, rep being the smallest id with the same set (null without a set or id), and
    ``(rep, copies, component)`` of the linked ones. These two are written to the paths ``kept``."""
    kind = texts.schema["id"].dataType
    sketches = Table(texts.mapInArrow(_sketches, schema), "sketches").df
    full = sketches.filter("n > 0 AND id IS NOT NULL")
    same = ["n", "fp1", "fp2"]
    # Copies are one row from here on; written, so that what follows is dealt by other keys than what copies share.
    classes = Table(full.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes").df
    mapped = join_counted(full.select("id", *same), classes.drop("bands"), same, "copies").select("id", "n", "rep")
    alone = sketches.filter("n = 0 OR id IS NULL").select("id", "n", F.lit(None).cast(kind).alias("rep"))
    mapped = Table(mapped.unionByName(alone), "class-of", path=kept[0]).df

    banded = classes.select(F.explode("bands").alias("key"), F.col("rep").alias("id"), "n", F.col("rep").alias("c"))
    tried, stars = _candidates(banded, percent)

    own = mapped.filter("rep IS NOT NULL").select("id", "rep").distinct()
    twice = own.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("m")).filter("lo < hi").drop("hi")
    repeated = join_counted(own, twice, ["id"], "m").select(F.col("rep").alias("a"), F.col("lo").alias("b"))
    links = Table(_verified(texts, tried, percent).unionByName(repeated), "links").df
    groups = connected_components(links)

    # Members that no star joined to their leader's group are banded finely with all members of the leader; what stars of
    # the fine buckets leave apart too is compared in blocks.
    for last in (False, True):
        apart = _apart(stars, groups)
        if apart is None:
            break
        if last:
            more = _block_links(texts, apart, percent)
        else:
            own = Table(apart.select("id", "c").distinct(), "apart").df
            fine = _texts_of(texts, own.select("id")).mapInArrow(_fine, T.StructType([schema["id"], schema["n"], schema["bands"]]))
            fine = Table(fine.distinct().join(own, "id"), "fine").df
            tried, stars = _candidates(fine.select(F.explode("bands").alias("key"), "id", "n", "c"), percent)
            if tried.isEmpty():
                continue
            more = _verified(texts, tried, percent)
        more = Table(more, "more").df
        if not more.isEmpty():  # groups are stars already: they stand for the links they were made of
            groups = connected_components(Table(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), "links").df)

    # Classes of many copies are told too if no link leads to them, so that their rows stay where they are.
    told = classes.groupBy("rep").agg(F.sum("copies").alias("copies")).join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    told = Table(told.filter((F.col("copies") > HOT_ROWS) | F.col("component").isNotNull()), "told", path=kept[1]).df
    return mapped, told


def _candidates(banded: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` to try, and stars ``(leader, id)``, of ``banded(key, id, n, c)``; rows of one ``c`` are known to be linked.

    A bucket (the rows of a key) of one ``c`` is dropped. Small ones give their pairs, others a pair of each member with the leader.
    """
    differ = F.min("c") < F.max("c")
    shared = Table(banded.groupBy("key").agg(F.count("*").alias("m"), F.count("*").alias("rows"), differ.alias("open")).filter("open").drop("open"), "shared").df
    members = Table(join_counted(banded, shared, ["key"], "rows"), "members").df
    fits = lambda x, y: 100 * F.least(x, y) >= int(percent) * F.greatest(x, y)

    few, many = members.filter(F.col("m") <= SMALL_BUCKET), members.filter(F.col("m") > SMALL_BUCKET)
    weight = members.groupBy("id").agg(F.sum("m").alias("w"))
    leader = many.join(weight, "id").groupBy("key", "m").agg(F.min_by(F.struct("id", "n", "c"), F.struct(-F.col("w"), "id")).alias("x"))
    leader = Table(leader.select("key", "m", F.col("x.id").alias("leader"), F.col("x.n").alias("leader_n"), F.col("x.c").alias("leader_c")), "leaders").df
    stars = Table(join_counted(many.select("key", "id", "n", "c"), leader, ["key"], "m").filter("id != leader").drop("key").distinct(), "stars").df
    a, b = (few.select("key", *(F.col(c).alias(f"{c}_{i}") for c in ("id", "n", "c"))) for i in "ab")
    small = a.join(b, "key").filter((F.col("id_a") < F.col("id_b")) & (F.col("c_a") != F.col("c_b")) & fits("n_a", "n_b"))
    large = stars.filter((F.col("c") != F.col("leader_c")) & fits("n", "leader_n"))
    pairs = small.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).unionByName(large.select(F.col("id").alias("a"), F.col("leader").alias("b")))
    return Table(pairs.distinct(), "tried").df, stars.select("leader", "id")


def _apart(stars: DataFrame, groups: DataFrame) -> DataFrame | None:
    """``(leader, id, c, head)`` of the stars in which some member's component ``c`` isn't the leader's (``head``); None if there are none."""
    heads = stars.groupBy("leader").agg(F.count("*").alias("m")).join(groups.withColumnRenamed("id", "leader"), "leader", "left")
    heads = heads.select("leader", "m", F.coalesce("component", "leader").alias("head"))
    named = join_counted(stars, heads, ["leader"], "m").join(groups, "id", "left")
    named = Table(named.select("leader", "id", F.coalesce("component", "id").alias("c"), "head"), "named-stars").df
    split = named.groupBy("leader").agg(F.count("*").alias("m"), F.count_if(F.col("c") != F.col("head")).alias("away")).filter("away > 0").drop("away")
    return None if split.isEmpty() else join_counted(named, split, ["leader"], "m", "left_semi")


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id.

    Each row is judged by its own text: rows that repeat an id are apart unless their texts are linked.
    Of rows with the same smallest id one is kept. Rows with a null id, or without shingles, stay. All columns come back
    as they were, whatever their names; an empty table gives an empty result.
    """
    row = free_name(docs.columns, "near_row")
    rows = Table(docs.withColumn(row, F.monotonically_increasing_id()), "rows").df  # written, so that numbers stay
    named = rows.filter("doc_id IS NOT NULL").select(F.col(row).alias("row"), "doc_id", "text")
    path = new_path(docs.sparkSession, "extra")
    with scratch(docs.sparkSession):
        extra = _all_but_first(named, percent, path)
    return drop_ids(rows, extra.withColumnRenamed("row", row), row).select(*docs.columns)


def _all_but_first(named: DataFrame, percent: int, path: str) -> DataFrame:
    """Numbers of the rows that are not the first of their group."""
    groups = Table(near_duplicates(named, id_col="row", percent=percent).select(F.col("doc_id").alias("row"), "component_id"), "groups").df
    order = named.select("row", F.struct("doc_id", F.xxhash64(F.col("text").cast("string")).alias("hash"), "row").alias("place"))
    first = groups.join(order, "row").groupBy("component_id").agg(F.min("place")["row"].alias("row")).select("row")
    return Table(groups.select("row").join(first, "row", "left_anti"), "extra", path=path).df
