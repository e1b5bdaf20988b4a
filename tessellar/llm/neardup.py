"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct shingles of five words (64-bit hashes). A
shingle falls in one of REGISTERS buckets; a bucket's register is the least
hash in it, stored as its leading-zero count and MANTISSA bits after the
leading one (16 bits). A bucket that a small set leaves empty takes the
register of the first filled one in an order of the bucket's own, the same for
all sets, which keeps the chance of equal registers at the similarity.
Registers are banded; documents that share a band are candidates, kept if the
similarity estimated from equal registers, less the expected share of
accidental collisions, is near enough to the limit, and then verified on their
full sets.

Groups are never expanded into pairs: documents with equal sets are one class;
in each band a class is compared with the least and the greatest of its bucket
and what is verified is joined to components. Buckets that then still hold several
components (a passage that many share, say) are compared in full, whatever
their size, in blocks: first on registers, which names the classes that have a
near enough one in another component, then these on their sets; a block gives
no more rows than it has classes, and no more links than join its components.

A link of similarity s is missed if all BANDS bands differ,
(1 - s**ROWS)**BANDS: 4e-7 at 0.85, 5e-5 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import ship
from .graph import components
from .store import by_ids, cut, repeats
from .words import LOWER, Slice, hash_spans, mix, shingles, slices, stream, words

ROWS, BANDS = 5, 25
REGISTERS = ROWS * BANDS
MANTISSA = 10
#: Classes of one bucket whose sets are compared with each other at once.
BLOCK = 256
#: The same for registers, which are 250 bytes a class whatever its text: a class goes out once for so many others.
REGISTER_BLOCK = 4096
#: Pairs whose registers a task holds at a time.
PAIRS = 1 << 17

#: Of each bucket the order in which it looks for another one's register, itself first.
_ORDER = np.stack([np.append(k, [x for x in np.argsort(stream(40 + k, REGISTERS)) if x != k]) for k in range(REGISTERS)])
_OTHER = stream(31, 1)[0]


def sets(s: Slice, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles (64-bit hashes) of the slice's rows, and where each row's begin."""
    w = words(s)
    return shingles(hash_spans(LOWER[s.data], w.start, w.end), w.row, s.rows, size)


def registers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of registers for each set that isn't empty."""
    rows = len(starts) - 1
    mixed = mix(values)
    bucket = ((mixed >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    least = np.full(rows * REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    place = np.repeat(np.arange(rows), np.diff(starts)) * REGISTERS + bucket.astype(np.int64)
    # of each bucket the least of another hash than that which chose the bucket
    np.minimum.at(least, place, mix(mixed ^ _OTHER))
    filled = np.zeros(rows * REGISTERS, bool)
    filled[place] = True
    filled = filled.reshape(rows, REGISTERS)
    fraction, exponent = np.frexp(least.astype(np.float64))
    code = (((64 - exponent) << MANTISSA) + ((2 * fraction - 1).clip(0) * (1 << MANTISSA)).astype(np.int64)).clip(0).astype("<u2").reshape(rows, REGISTERS)
    row, empty = np.nonzero(~filled)
    for k in range(1, REGISTERS):
        if not len(row):
            break
        look = _ORDER[empty, k]
        hit = filled[row, look]
        code[row[hit], empty[hit]] = code[row[hit], look[hit]]
        row, empty = row[~hit], empty[~hit]
    return code


def jaccard(equal, n, m):
    """Similarity from the number of equal registers of sets of n and m shingles.

    Two different minima fall in one register with a chance near
    n m / (n + m)^2 * 2^-MANTISSA / (2 ln 2), which is taken out.
    """
    chance = n * m / (n + m) ** 2 * 2.0**-MANTISSA / (2 * np.log(2))
    return (equal / REGISTERS - chance) / (1 - chance)


def near_enough(limit: float) -> float:
    """The least estimate that is verified: five standard deviations under the limit."""
    return limit - 5 * (limit * (1 - limit) / REGISTERS) ** 0.5


_SIGNED = "id bigint, n bigint, class binary, signature binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight = stream(33, 2) | np.uint64(1)
    for batch in batches:
        for s in slices(batch.column(1)):
            values, starts = sets(s)
            n = np.diff(starts)
            full = np.flatnonzero(n)
            signature = [None] * s.rows
            name = [None] * s.rows
            if len(full):
                at = np.append(starts[full], len(values))
                r = registers(values, at)
                # a set's name: two sums over its mixed elements, 128 bits
                sums = np.stack([np.add.reduceat(mix(values * w), at[:-1]) for w in weight], axis=1)
                for k, row in enumerate(full):
                    signature[row] = r[k].tobytes()
                    name[row] = sums[k].tobytes()
            ids = batch.column(0).slice(s.first, s.rows)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(signature, pa.binary())], ["id", "n", "class", "signature"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in slices(batch.column(1)):
            values, starts = sets(s)
            blobs = [values[starts[k] : starts[k + 1]].astype("<u8").tobytes() for k in range(s.rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.array(blobs, pa.binary())], ["id", "set"])


@F.pandas_udf(T.DoubleType())
def _estimate(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x = np.frombuffer(b"".join(a), "<u2").reshape(-1, REGISTERS)
    y = np.frombuffer(b"".join(b), "<u2").reshape(-1, REGISTERS)
    return pd.Series(jaccard((x == y).sum(axis=1), n.to_numpy(float), m.to_numpy(float)))


def shared_elements(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


@F.pandas_udf(T.LongType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([shared_elements(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def _bands(classes: DataFrame) -> DataFrame:
    """``rep, band, k``: the hash of each band's registers and its number."""
    piece = lambda k: F.substring("signature", 2 * ROWS * k + 1, 2 * ROWS)
    own = F.array(*(F.struct(F.lit(k).alias("no"), F.xxhash64(F.lit(k), piece(k)).alias("hash")) for k in range(BANDS)))
    return classes.select("rep", F.explode(own).alias("b")).select("rep", F.col("b.hash").alias("band"), F.col("b.no").alias("k"))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (``a, b``) those that are linked."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("signature").alias(f"s{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    # sizes alone bound the similarity
    near = near.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near = cut(near.where(_estimate("sa", "sb", "na", "nb") >= near_enough(percent / 100)).select("a", "b", "na", "nb"), "near")
    if near.isEmpty():
        return near.select("a", "b")
    full = _full_sets(near.select(F.explode(F.array("a", "b")).alias("w")).distinct(), docs)
    of = lambda c: full.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}"))
    checked = near.join(of("a"), "a").join(of("b"), "b").withColumn("shared", _shared("set_a", "set_b"))
    return cut(checked.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b"), "links")


def shared_counts(one: list[np.ndarray], two: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """|A & B| of every A of one list and B of the other.

    Shingles that only one list has don't count; the others are columns of two
    0/1 matrices, a bounded number at a time, and the counts their product.
    """
    common = np.intersect1d(np.concatenate(one), np.concatenate(two))
    total = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, len(common), columns):
        part = common[at : at + columns]

        def matrix(sets: list[np.ndarray], part=part) -> np.ndarray:
            m = np.zeros((len(sets), len(part)), np.float32)
            for k, x in enumerate(sets):
                place = np.searchsorted(part, x)
                place[place == len(part)] = 0
                m[k, place[part[place] == x]] = 1
            return m

        total += matrix(one) @ matrix(two).T
    return total.astype(np.int64)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """Of each row of registers a number for each band."""
    weight = stream(34, ROWS) | np.uint64(1)
    return mix((registers.reshape(len(registers), BANDS, ROWS) * weight).sum(axis=2, dtype=np.uint64))


def equal_registers(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many registers every row of one block has in common with every one of another."""
    if len(one) * len(two) <= 1024:
        return (one[:, None, :] == two[None, :, :]).sum(axis=2, dtype=np.uint8)
    total = np.zeros((len(one), len(two)), np.uint8)
    for x, y in zip(np.ascontiguousarray(one.T), np.ascontiguousarray(two.T), strict=True):
        total += (x[:, None] == y[None, :]).view(np.uint8)
    return total


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end where a run of equal keys does, and the places between which their runs lie; the rows come sorted by the keys."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.concat_batches([*rest, batch]) if rest else batch
        new = np.zeros(whole.num_rows - 1, bool)
        for key in keys:
            column = whole.column(key).to_numpy()
            new |= column[1:] != column[:-1]
        at = np.concatenate([[0], np.flatnonzero(new) + 1])
        if at[-1]:
            yield whole.slice(0, at[-1]), at
        rest = [whole.slice(at[-1])]
    if rest:
        yield rest[0], np.array([0, rest[0].num_rows])


_OPEN = ("rep", "component", "band", "i", "j")
_CANDIDATES = "rep bigint, component bigint, band bigint, i bigint, j bigint"


def _block_candidates(percent: int):
    """Rows sorted by bucket and pair of blocks, as many pairs of blocks as a batch has."""

    def near(c: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The rows of two blocks (or of one) that have one of another component with near enough registers and size.

        Two classes that share several buckets count in the first of them.
        """
        k = int(c["k"][one[0]])
        step = max(1, PAIRS // len(two))
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(one), step):
            part = one[at : at + step]
            n, m = c["n"][part][:, None], c["n"][two][None, :]
            first = (c["component"][part][:, None] != c["component"][two][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            if one is two:
                first = np.triu(first, at + 1)
            if not first.any():
                continue
            equal = equal_registers(c["registers"][part], c["registers"][two])
            # the estimate is at most the share of equal registers
            a, b = np.nonzero(first & (equal >= near_enough(percent / 100) * REGISTERS))
            equal, a, b = equal[a, b].astype(float), part[a], two[b]
            close = jaccard(equal, c["n"][a].astype(float), c["n"][b].astype(float)) >= near_enough(percent / 100)
            close &= ~(c["bands"][a, :k] == c["bands"][b, :k]).any(axis=1)
            found += [a[close], b[close]]
        return np.unique(np.concatenate(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at in _runs(batches, ("band", "i", "j")):
            c = {name: batch.column(name).to_numpy() for name in (*_OPEN, "block", "k", "n")}
            c["registers"] = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(-1, REGISTERS)
            c["bands"] = band_keys(c["registers"])
            found = [np.zeros(0, np.int64)]
            for start, end in zip(at[:-1], at[1:], strict=True):
                rows = np.unique(c["rep"][start:end], return_index=True)[1] + start
                i, j = c["i"][start], c["j"][start]
                one = rows[c["block"][rows] == i]
                two = one if i == j else rows[c["block"][rows] == j]
                if len(one) and len(two):
                    found.append(near(c, one, two))
            yield batch.select(_OPEN).take(pa.array(np.concatenate(found)))

    return run


def _block_pairs(rows: DataFrame, most: int) -> DataFrame:
    """Rows of buckets (``band``, of ``size`` rows) in blocks of about ``most``: each goes to every pair ``i, j`` of blocks with its own."""
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / most)).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other", "size")


def _block_links(percent: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links between the components of two blocks (or of one), as few as join what is linked."""
        rows = rows.drop_duplicates("rep")
        one, two = rows[rows["block"] == key[1]], rows[rows["block"] == key[2]]
        if not len(one) or not len(two):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        sets = [[np.frombuffer(x, "<u8") for x in t["set"]] for t in (one, two)]
        shared = shared_counts(*sets)
        n, m = (np.array([len(x) for x in t]) for t in sets)
        linked = 100 * shared >= percent * (n[:, None] + m[None, :] - shared)
        linked &= one["component"].to_numpy()[:, None] != two["component"].to_numpy()[None, :]
        x, y = np.nonzero(linked)
        a, b = one["rep"].to_numpy()[x], two["rep"].to_numpy()[y]
        # each goes to the least id that it reaches here
        label = {k: k for k in np.concatenate([a, b]).tolist()}

        def root(k: int) -> int:
            while label[k] != k:
                label[k] = label[label[k]]
                k = label[k]
            return k

        for u, v in zip(a.tolist(), b.tolist(), strict=True):
            u, v = root(u), root(v)
            label[max(u, v)] = min(u, v)
        out = [(root(k), k) for k in label if root(k) != k]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _full_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``id, set`` of the documents in ``ids`` (``w``), once each; texts don't move while the ids are few enough to be broadcast."""
    text = by_ids(docs, "id", cut(ids, "wanted"), "left_semi").select("id", "text")
    return cut(text.mapInArrow(_shingle_sets, "id bigint, set binary"), "sets")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id, kept``.

    ``kept`` holds for all rows of a component's least id. Documents are linked where 100 * |A & B| >= percent * |A | B| (equal sets
    always are). A null or empty text has no shingles and is linked with
    nothing. Rows with a repeated id are separate documents of the same id; a
    null id is never linked and always kept. An empty table gives an empty
    result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not repeats(rows, "id"):
        return _near(rows, percent).withColumnRenamed("id", id_col)
    keyed = _keyed(rows, "id", "text")
    ids = keyed.select(F.col("__row").alias("row"), F.col("id").alias("of"))
    found = _near(keyed.select(F.col("__row").alias("id"), "text"), percent).drop("kept")
    found = found.join(ids.withColumnsRenamed({"row": "r", "of": "own"}), F.col("id") == F.col("r"), "left").join(ids, F.col("component_id") == F.col("row"), "left")
    return found.select(F.col("own").alias(id_col), "n_shingles", F.col("of").alias("component_id"), F.coalesce(F.col("own") == F.col("of"), F.lit(True)).alias("kept"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a number ``__row`` that is the row's own and in the order of the ids; null where the id is."""
    by = (F.col(id_col), F.xxhash64(text_col))
    rows = docs.repartitionByRange(*by).sortWithinPartitions(*by)
    return cut(rows.withColumn("__row", F.when(F.col(id_col).isNotNull(), F.monotonically_increasing_id())), "keyed")


def _settle(banded: DataFrame, classes: DataFrame, rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compares the classes of every bucket (``rep, band, k``) with its least and greatest.

    Returns the links, their components (``node, component``) and, as ``rep,
    component, band, k, size``, the buckets of three or more whose classes
    aren't all of one component after that.
    """
    hubs = banded.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    shared = cut(banded.join(hubs, "band"), "shared")
    star = shared.select(F.col("low").alias("a"), F.col("rep").alias("b")).union(shared.select(F.col("rep").alias("a"), F.col("high").alias("b"))).where("a <> b").distinct()
    links = _verified(cut(star, "pairs"), classes, rows, percent)
    found = components(links)
    open_rows = shared.where("size > 2").join(found, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component"), "band", "k", "size")
    open_rows = cut(open_rows, "open")
    unsettled = open_rows.groupBy("band").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l <> h").select("band")
    return links, found, cut(open_rows.join(cut(unsettled, "unsettled"), "band"), "buckets")


def _near(rows: DataFrame, percent: int) -> DataFrame:
    """``id, n_shingles, component_id, kept`` of rows ``id, text`` of which no two have the same id."""
    ship(rows.sparkSession)
    signed = cut(rows.mapInArrow(_sign, _SIGNED), "signed")
    some = signed.where("n > 0 and id is not null")
    reps = some.groupBy("class").agg(F.min("id").alias("rep"))
    # one row a class: that of its least id
    classes = some.join(reps.withColumnRenamed("class", "c"), (F.col("class") == F.col("c")) & (F.col("id") == F.col("rep")))
    classes = cut(classes.select("rep", "class", "n", "signature").dropDuplicates(["class"]), "classes")
    links, found, buckets = _settle(cut(_bands(classes), "bands"), classes, rows, percent)
    if not buckets.isEmpty():
        # a class takes its registers once for all of its buckets, of which it has at most BANDS
        rest = buckets.groupBy("rep", "component").agg(F.collect_list(F.struct("band", "k", "size")).alias("buckets"))
        rest = rest.join(classes.select("rep", "n", "signature"), "rep").select("rep", "component", "n", "signature", F.explode("buckets").alias("b"))
        rest = _block_pairs(rest.select("rep", "component", "n", "signature", "b.*"), REGISTER_BLOCK)
        # many small buckets: what a bucket costs besides its pairs must be little
        by = ("band", "i", "j")
        rest = rest.repartition(*by).sortWithinPartitions(*by).mapInArrow(_block_candidates(percent), _CANDIDATES)
        rest = cut(rest, "candidates")
        full = _full_sets(rest.select(F.col("rep").alias("w")).distinct(), rows)
        # what a pair of blocks leaves is a bucket of its own, in smaller blocks
        rest = rest.select(F.xxhash64("band", "i", "j").alias("band"), "rep", "component")
        rest = _block_pairs(rest.join(rest.groupBy("band").agg(F.count(F.lit(1)).alias("size")), "band"), BLOCK)
        rest = rest.join(full, F.col("rep") == F.col("id")).drop("id")
        more = cut(rest.groupBy("band", "i", "j").applyInPandas(_block_links(percent), "a bigint, b bigint").distinct(), "links")
        if not more.isEmpty():
            found = components(links.union(more))
    names = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("class").alias("c"), F.coalesce("component", "rep").alias("component"))
    names = cut(names, "names")
    # the class table is read back, so that a class with very many copies can be split in the join
    out = signed.join(names, F.col("class") == F.col("c"), "left")
    component = F.coalesce(F.when(F.col("id").isNotNull(), F.col("component")), F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that of its least id.

    A null or empty text and a null id always stay; rows of a repeated id go
    or stay each by their own text.
    """
    if repeats(docs, id_col):
        keyed = _keyed(docs, id_col, text_col)
        gone = _near(keyed.select(F.col("__row").alias("id"), F.col(text_col).alias("text")), percent).where("not kept").select(F.col("id").alias("__gone"))
        return by_ids(keyed, "__row", cut(gone, "gone"), "left_anti").drop("__row")
    gone = near_duplicates(docs, id_col, text_col, percent).where("not kept").select(F.col(id_col).alias("__gone"))
    return by_ids(docs, id_col, cut(gone, "gone"), "left_anti")
