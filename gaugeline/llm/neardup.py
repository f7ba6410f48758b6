"""Near-duplicate detection by MinHash, banding, verification and connected components.

1. One pass over the texts gives each document its number of shingles, a 128-bit key
   of its word sequence, and the hashes of its bands: runs of ROWS minima of BANDS *
   ROWS universal hash functions over its set of shingles. This is written once.
2. Documents with equal keys are one node, named by their smallest id.
3. Nodes that share a band hash are candidates. A bucket is a star around its
   smallest node, so it gives as many links as members, and the candidates'
   components come from large-star and small-star. Linked nodes share a component.
4. A component's texts meet in units of bounded size. A component that fits into one is
   one unit. In a larger one every node first meets its centre: the star in which it shares the most
   bands. The confirmed ones make clusters. Then blocks of nodes meet in pairs, but for two blocks of
   one cluster, whose nodes are joined already: nodes of a large cluster have blocks of their own, the others
   share blocks. So every two members of a component that are not joined yet meet in some unit. There,
   signatures are compared, then whole sets. Nodes already joined in the unit need
   no further test, so a unit gives fewer links than it has members.
5. The confirmed links' components are the result, with a link from each id to the nodes of all its texts.

A group of near copies of one text thus takes work in proportion to its size. What grows with the square is
a component of different texts that share bands without being similar to their centres.

A pair with similarity s shares no band with probability (1 - s**ROWS)**BANDS: 3e-7
at 0.85. Signatures reject a pair only if the estimate is more than five standard
deviations below the threshold.

Defined results. Words are the runs of characters other than ASCII white space,
A-Z in lower case. A text with fewer words than a shingle is one shingle; a null,
empty or blank text has no shingle and is linked with nothing. Rows with the same id
are one node: what any of their texts is linked to, the id is linked to, and all its rows have one component. A row
without id is linked with nothing, has no component, and is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gaugeline.llm import _text
from gaugeline.llm._store import Store
from gaugeline.llm.components import components

#: Words of a shingle; a link has SIMILAR[0] * intersection >= SIMILAR[1] * union.
WIDTH, SIMILAR = 5, (100, 85)
#: Bands and minima in each.
BANDS, ROWS = 32, 6
#: A unit holds one component of at most these nodes and bytes, or two blocks of about half of each.
UNIT_NODES, UNIT_BYTES = 512, 4 << 20
#: The side of a unit's centre.
CENTRE = -2


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of n universal hash functions over 64 bits."""
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**64, n, dtype=np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each function a * x + b over the shingles."""
    out = np.full(len(a), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 512):
        x = shingles[at : at + 512]
        y = a[:, None] * x[None, :]
        y += b[:, None]
        np.minimum(out, y.min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, key: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n_bytes, n_shingles, k1, k2, bands): one row for each row of docs."""
    rows_in = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([rows_in.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType(), False))])
    a, b = _functions(bands * rows)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _text.mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        salt = _text.mix64(np.arange(1000, 1000 + bands, dtype=np.uint64))
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            raw, off = _text.column_bytes(batch.column(1))
            n_sh, keys, found = [], [], []
            for i, j in _text.groups(off):
                h, _, _, first = _text.word_hashes(raw, off[i : j + 1])
                sets = _text.shingle_sets_of(h, first, width)
                for k, s in enumerate(sets):
                    n_sh.append(len(s))
                    word_key = hashlib.blake2b(h[first[k] : first[k + 1]].tobytes(), digest_size=16).digest()
                    keys.append(word_key)
                    if not len(s):
                        found.append(np.zeros(0, np.int64))
                        continue
                    if (got := known.get(word_key)) is None:
                        m = minima(s, a, b).reshape(bands, rows)
                        got = _text.mix64((m * step).sum(axis=1, dtype=np.uint64) ^ salt).view(np.int64)
                        if len(known) < 20_000:
                            known[word_key] = got
                    found.append(got)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            stops = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=stops[1:])
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(n_sh, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.ListArray.from_arrays(stops, flat)], names=names)

    return rows_in.mapInArrow(run, schema)


class _Joined:
    """Union-find over the members of a unit."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x


def confirmed(ids: list, sides: list[int], sets: list[np.ndarray], similar: tuple[int, int], funcs) -> list[tuple]:
    """Links between the members of a unit that join all that their sets join.

    sides: members on the same side of a unit of two blocks meet elsewhere; a unit
    of one block has all on side -1; those on the side CENTRE meet all others, and nobody else meets.
    """
    n, out = len(ids), []
    if n < 2:
        return out
    joined = _Joined(n)
    num, den = similar
    sizes = np.array([len(s) for s in sets])

    def test(i: int, j: int) -> None:
        x, y = joined.root(i), joined.root(j)
        if x == y:
            return
        small, large = (i, j) if sizes[i] <= sizes[j] else (j, i)
        if num * sizes[small] < den * sizes[large]:
            return
        p, q = sets[small], sets[large]
        at = np.searchsorted(q, p)
        at[at == len(q)] = 0
        both = int((q[at] == p).sum())
        if num * both >= den * (len(p) + len(q) - both):
            joined.up[max(x, y)] = min(x, y)
            out.append((ids[i], ids[j]))

    if n == 2:
        if sides[0] != sides[1] or sides[0] < 0:
            test(0, 1)
        return out
    if CENTRE in sides:
        centres = [k for k in range(n) if sides[k] == CENTRE]
        for j in range(n):
            if sides[j] != CENTRE:
                for i in centres:
                    test(i, j)
        return out
    sig = np.stack([minima(s, *funcs) for s in sets])
    t, k = den / num, sig.shape[1]
    least = k * (t - 5 * (t * (1 - t) / k) ** 0.5)
    side = np.array(sides)
    sig8 = (_text.mix64(sig) & np.uint64(0xFFFF)).astype(np.uint16)
    roots = np.arange(n)
    for i in range(n - 1):
        roots[i:] = [joined.root(x) for x in range(i, n)] if out else roots[i:]
        ok = roots[i + 1 :] != roots[i]
        if side[i] >= 0:
            ok &= side[i + 1 :] != side[i]
        js = np.flatnonzero(ok) + i + 1
        if not len(js):
            continue
        same = (sig8[js] == sig8[i]).sum(axis=1)
        for j in js[same >= least][np.argsort(-same[same >= least], kind="stable")]:
            test(i, int(j))
    return out


def verified(units: DataFrame, width: int, similar: tuple[int, int], hashes: int) -> DataFrame:
    """(a, b) links of rows (unit, lo, hi, side, id, text) that stand together by (unit, lo, hi)."""
    kind = units.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    funcs = _functions(hashes)
    pa_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sides, sets = None, [], [], []
        links: list[tuple] = []
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa_kind) for k in (0, 1)], names=["a", "b"])
        for batch in batches:
            where = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            new_sides, new_ids = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            raw, off = _text.column_bytes(batch.column(5))
            at = 0
            for i, j in _text.groups(off):
                for s in _text.shingle_sets(raw, off[i : j + 1], width):
                    if where[at] != now:
                        if len(ids) > 1:
                            links += confirmed(ids, sides, sets, similar, funcs)
                        now, ids, sides, sets = where[at], [], [], []
                    ids.append(new_ids[at])
                    sides.append(new_sides[at])
                    sets.append(s)
                    at += 1
            if links:
                yield table(links)
                links = []
        if len(ids) > 1 and (links := confirmed(ids, sides, sets, similar, funcs)):
            yield table(links)

    return units.mapInArrow(run, schema)


def _blocks(unit_nodes: int, unit_bytes: int) -> Column:
    """Column: blocks of at most about half a unit for n nodes of ``bytes``."""
    return F.ceil(F.greatest(2 * F.col("n") / unit_nodes, 2 * F.col("bytes") / unit_bytes)).cast("int")


def _with_texts(units: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (unit, lo, hi, side, node) with the texts of their nodes, those of a unit together."""
    units = units.join(texts, units.node == texts.id).select("unit", "lo", "hi", "side", "id", "text")
    return units.repartition("unit", "lo", "hi").sortWithinPartitions("unit", "lo", "hi")


def _centred(big: DataFrame, stars: DataFrame, unit_nodes: int, unit_bytes: int) -> DataFrame:
    """Units in which each node of large components meets the centre of most of its bands; a centre comes to each block of its nodes."""
    own = stars.join(big.select(F.col("node").alias("a"), "n_bytes"), "a").groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "b"))["b"].alias("unit"), F.first("n_bytes").alias("n_bytes"))
    size = own.groupBy("unit").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    size = size.select("unit", _blocks(unit_nodes, unit_bytes).alias("blocks"))
    placed = own.join(size, "unit").select("unit", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("lo"), F.col("a").alias("node"))
    centres = size.select("unit", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("lo"), F.col("unit").alias("node"))
    return placed.select("unit", "lo", F.col("lo").alias("hi"), F.lit(0).alias("side"), "node").union(centres.select("unit", "lo", F.col("lo").alias("hi"), F.lit(CENTRE), "node"))


def _paired(big: DataFrame, clusters: DataFrame, unit_nodes: int, unit_bytes: int) -> DataFrame:
    """Units of two blocks in which all nodes of a large component meet, but for those of one large cluster; clusters: (node, component) of the joined nodes."""
    label = clusters.select("node", F.col("component").alias("cluster"))
    rows = big.join(label, "node", "left").select("component", "node", "n_bytes", F.coalesce("cluster", "node").alias("cluster"))
    size = rows.groupBy("component", "cluster").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    # a large cluster has blocks of its own; the small ones, as the cluster null, share theirs
    large = (2 * F.col("n") > unit_nodes) | (2 * F.col("bytes") > unit_bytes)
    size = size.withColumn("of", F.when(large, F.col("cluster")))
    groups = size.groupBy("component", "of").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select("component", "of", _blocks(unit_nodes, unit_bytes).alias("blocks"))
    w = Window.partitionBy("component")  # a row for each large cluster: a 256th of the nodes at most, or of 2 MB
    groups = groups.select("component", "of", "blocks", (F.sum("blocks").over(w.orderBy("of")) - F.col("blocks")).cast("int").alias("start"), F.sum("blocks").over(w).cast("int").alias("every"))
    rows = rows.join(size.select("component", "cluster", "of"), ["component", "cluster"])
    rows = rows.alias("r").join(groups.alias("g"), (F.col("r.component") == F.col("g.component")) & F.col("r.of").eqNullSafe(F.col("g.of")))
    block = F.col("start") + F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    own = F.col("of").isNotNull() & F.col("other").between(F.col("start"), F.col("start") + F.col("blocks") - 1)
    rows = rows.select(F.col("r.component").alias("unit"), "node", F.col("g.of").alias("of"), "start", "blocks", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("every") - 1)).alias("other")).where(~own)
    return rows.select("unit", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block")).alias("side"), "node")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, similar: tuple[int, int] = SIMILAR, bands: int = BANDS, rows: int = ROWS, unit_nodes: int = UNIT_NODES, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of docs; see the module's text for each case."""
    spark = docs.sparkSession
    store = Store(spark, "neardup")
    sig = store.keep(signatures(docs, key, text, width, bands, rows))
    able = sig.where("n_shingles > 0 and id is not null")
    nodes = able.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    # the band rows of one document for each key
    n2 = nodes.select(F.col("rep").alias("id"), "k1", "k2")
    banded = able.join(n2, ["id", "k1", "k2"], "left_semi").select("id", F.explode("bands").alias("band"))
    centres = banded.groupBy("band").agg(F.min("id").alias("c"), F.max("id").alias("d")).where("c < d").select("band", "c")
    stars = banded.join(centres, "band").where("id <> c").groupBy(F.col("id").alias("a"), F.col("c").alias("b")).agg(F.count("*").alias("n"))
    stars = store.keep(stars)
    near = store.keep(components(stars, store))

    # size of each candidate component
    ids = sig.where("id is not null").groupBy("id").agg(F.max("n_bytes").alias("n_bytes"), F.min(F.struct("k1", "k2")).alias("k"), F.max(F.struct("k1", "k2")).alias("other"))
    members = near.join(ids.select("id", "n_bytes"), near.node == ids.id).select("component", "node", "n_bytes")
    size = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    size = store.keep(size.select("component", ((F.col("n") <= unit_nodes) & (F.col("bytes") <= unit_bytes)).alias("fits")))
    # the candidates' texts, shuffled once from among all
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col(key).isNotNull())
    texts = store.keep(texts.join(near.select(F.col("node").alias("id")), "id", "left_semi"))
    small = near.join(size.where("fits"), "component").select(F.col("component").alias("unit"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(-1).alias("side"), "node")
    links = []
    if not size.where("not fits").isEmpty():
        big = store.keep(members.join(size.where("not fits"), "component").select("component", "node", "n_bytes"))
        first = store.keep(verified(_with_texts(_centred(big, stars, unit_nodes, unit_bytes), texts), width, similar, bands * rows))
        links.append(first)
        small = small.union(_paired(big, components(first, store), unit_nodes, unit_bytes))
    links.append(verified(_with_texts(small, texts), width, similar, bands * rows))
    # an id with several texts is linked with each one's node
    several = able.join(ids.where("k <> other").select("id"), "id", "left_semi").select("id", "k1", "k2")
    links.append(several.join(nodes, ["k1", "k2"]).select(F.col("id").alias("a"), F.col("rep").alias("b")))
    links = components(reduce(DataFrame.union, links), store)

    label = links.select(F.col("node").alias("rep"), F.col("component"))
    named = nodes.join(label, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    plain = sig.select("id", "n_shingles", "k1", "k2")
    full = plain.where("n_shingles > 0").join(named, ["k1", "k2"], "left").select("id", "n_shingles", "component")
    empty = plain.where("n_shingles = 0").join(label.withColumnRenamed("rep", "id"), "id", "left").select("id", "n_shingles", "component")
    out = full.union(empty)
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
