"""Near-duplicate classes by SetSketch registers over word shingles, verified on full sets.

Every text becomes the set of its k-word shingles (ASCII lower case). Texts with
the same set form one class, so copies meet once. Of each class a SetSketch
(Ertl 2021) is kept: each shingle sends a Poisson stream of exponentially spaced
points over m registers, a register keeps the earliest, and registers are
truncated to integer logarithms. Equal registers are as likely as the Jaccard
similarity J, so classes that share a band of `rows` registers are candidates;
the joint likelihood of the register comparison and the known set sizes prunes
those far below the threshold; the rest are verified by intersecting full sets.

Groups of many near copies are never paired out. Buckets of a few members are
compared directly. In a larger bucket members first meet only a pivot, the one
that lies in the most and largest buckets and so near the group's centre;
verified links join components. What then still lies in different components of
one bucket is compared on full sets in blocks: blocks of members outside the
bucket's largest component against all its blocks, so that only verified links
leave a task. Blocks are bounded in members and in shingles, and joined by bucket
and block, so a hot bucket is dealt over many tasks. Full sets are made anew from
the texts; a bitmap of fixed size tells which, so no text is shuffled.

Probability to miss a pair of J = 0.8 in one comparison of bands: with the
default 40 bands of 5 rows (1 - 0.8**5)**40 = 1.2e-7.

Cases: null and wordless texts have no shingles, are linked with nothing and
stay, whatever their doc_id; a null doc_id has a null component and stays; rows
with one doc_id and different texts are one document, so what either is linked
with is linked with both, and all rows of a component's smallest doc_id stay; a
very long text is one set, held whole by one task; an empty table gives no rows;
extra columns are ignored here and come back untouched from `keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm._text import GOLD, bounded_batches, fixed_bitmap, has_bit, mix, shingle_sets, signed, slices
from tessera.operators.components import connected_components
from tessera.session import materialise, release

BANDS, ROWS = 40, 5
#: Buckets of so many members are compared directly; members of a block in larger ones, and shingles of a block of more than one member.
SMALL, BLOCK, CELLS = 8, 128, 1 << 18
#: Of the lowest bits of 128 registers, those that differ are expected to be (1 - J) / 2. At J = 0.8 more than 32 differ with probability 2e-7.
BITS, MOST_BITS = 128, 32
#: Rows and bytes of a batch, bytes of a slice: what a worker's heap and the batch's copies outside the JVM's heap grow to, and keep.
BATCH_ROWS, BATCH_BYTES, SLICE = 500, 8 << 20, 1 << 18
#: Shingles whose registers are made together.
TOGETHER = 1 << 17
#: Base of the register scale, and rate that keeps registers of one-element sets above zero.
SCALE, RATE = 1.001, 20.0


def setsketch(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of m uint16 registers a set; depends on the set alone, and the elementwise maximum is that of the union."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    state = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    base = np.repeat(np.arange(n) * m, size)
    low = np.full(n * m, np.inf)
    at = np.zeros(len(state))
    limit = np.full(n, np.inf)
    step, check = 0, 1
    while len(state):
        step += 1
        state = state + GOLD
        r = mix(state)
        at = at - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / m
        reg = base + ((mix(r ^ GOLD) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(low, reg, at)
        if step >= check:
            check = step + 1 + step // 4
            limit = low.reshape(n, m).max(1)
        # a stream beyond its set's latest register can no longer change any
        live = at < limit[base // m]
        if not live.all():
            state, at, base = state[live], at[live], base[live]
    out = np.zeros(n * m, np.uint16)
    has = np.isfinite(low)
    out[has] = np.clip(np.floor(1 - np.log(low[has] / RATE) / np.log(SCALE)), 1, 65535)
    return out.reshape(n, m)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band, different from band to band."""
    part = registers[:, : bands * rows].reshape(len(registers), bands, rows).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLD), part.shape[:2]).copy()
    for r in range(rows):
        key = mix(key + part[:, :, r] * GOLD + np.uint64(r))
    return key


def keeps_candidate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, slack: float = 14.0) -> np.ndarray:
    """Whether the joint likelihood leaves J >= threshold possible.

    With D+, D-, D0 of m registers greater, less and equal, and u, v the shares of
    both sizes, log L(J) = D+ log p(u - vJ) + D- log p(v - uJ) + D0 log(1 - p(..) - p(..)),
    p(x) = -log_b(1 - x (b-1)/b). A pair goes if the best J below the threshold is
    more than `slack` nats likelier than the best one above.
    """
    m = a.shape[1]
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    below, above = np.linspace(0, threshold, 41)[None, :], np.linspace(threshold, 1, 11)[None, :]

    def loglik(j: np.ndarray) -> np.ndarray:
        j = np.minimum(j, top)
        p = lambda x: -np.log1p(-np.maximum(x, 0) * (SCALE - 1) / SCALE) / np.log(SCALE)
        pu, pv = p(u - v * j), p(v - u * j)
        return up * np.log(np.maximum(pu, 1e-9)) + down * np.log(np.maximum(pv, 1e-9)) + (m - up - down) * np.log(np.maximum(1 - pu - pv, 1e-9))

    return loglik(above).max(1) >= loglik(below).max(1) - slack


def _set_groups(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and sets of consecutive rows. Slices are small, but several share one `setsketch`, which takes as many rounds as its smallest set needs."""
    first, sets, held = 0, [], 0
    for piece in slices(texts, SLICE):
        own = shingle_sets(piece, k)
        sets += own
        held += sum(map(len, own))
        if held >= TOGETHER:
            yield first, sets
            first, sets, held = first + len(sets), [], 0
    if sets:
        yield first, sets


def _sketches(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for first, sets in _set_groups(b.column("text"), k):
                regs = setsketch(sets, m)
                total = np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in map(mix, sets)], np.uint64)
                other = np.array([np.bitwise_xor.reduce(mix(s ^ GOLD)) if len(s) else 0 for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(total)), pa.array(signed(other)), pa.array([r.tobytes() for r in regs], pa.binary())],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "sketch"],
                )

    return run


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            regs = np.stack([np.frombuffer(x, np.uint16) for x in b.column("sketch").to_pylist()])
            keys = band_keys(regs, bands, rows)
            bits = np.packbits((regs[:, :BITS] & 1).astype(np.uint8), axis=1).view(np.int64)
            of = lambda x: pa.array(np.repeat(x, bands))
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys.ravel())), of(b.column("node").to_numpy()), of(b.column("n").to_numpy()), of(bits[:, 0].copy()), of(bits[:, 1].copy())], names=["band", "node", "n", "z1", "z2"])

    return run


def _block_links(percent: int):
    """Verified links between the members of two blocks, by products of their incidence matrices over shared shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):  # one pair of blocks as Python objects at a time
                x, y = (b.column(c)[r].as_py() for c in ("xs", "ys"))
                sides = [[np.frombuffer(m["shingles"], np.uint64) for m in side] for side in (x, y)]
                size = [np.array([len(v) for v in side]) for side in sides]
                token = [np.concatenate(side) for side in sides]
                owner = [np.repeat(np.arange(len(n)), n) for n in size]
                both = np.intersect1d(*token)
                inter = np.zeros((len(x), len(y)), np.int64)
                for k in range(0, len(both), 4096):
                    part, one = both[k : k + 4096], []
                    for t, o, side in zip(token, owner, sides):
                        at = np.minimum(np.searchsorted(part, t), len(part) - 1)
                        hit = part[at] == t
                        m = np.zeros((len(side), len(part)), np.float32)
                        m[o[hit], at[hit]] = 1
                        one.append(m)
                    inter += np.rint(one[0] @ one[1].T).astype(np.int64)
                comp = [np.array([m["comp"] for m in side]) for side in (x, y)]
                node = [np.array([m["node"] for m in side], np.int64) for side in (x, y)]
                ok = (100 * inter >= percent * (size[0][:, None] + size[1][None, :] - inter)) & (comp[0][:, None] != comp[1][None, :])
                i, j = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[0][i], node[1][j])), pa.array(np.maximum(node[0][i], node[1][j]))], names=["a", "b"])

    return run


def _sets(k: int, m: int, bitmap: np.ndarray):
    """Sets and registers of the texts whose node's bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node").to_numpy().view(np.uint64)
            on = np.flatnonzero(has_bit(bitmap, mix(node)))
            some = b.take(pa.array(on))
            for first, sets in _set_groups(some.column("text"), k):
                yield pa.RecordBatch.from_arrays([some.column("node").slice(first, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([r.tobytes() for r in setsketch(sets, m)], pa.binary())], names=["node", "shingles", "sketch"])

    return run


def _verified(percent: int):
    """Pairs that the joint likelihood of their registers allows and whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                b = whole.slice(k, 2000)
                side = lambda c, t: [np.frombuffer(x.as_buffer(), t) for x in b.column(c)]  # noqa: E731, B023
                xs, ys = side("xs", np.uint64), side("ys", np.uint64)
                ok = keeps_candidate(np.stack(side("xk", np.uint16)), np.stack(side("yk", np.uint16)), np.array([len(x) for x in xs], float), np.array([len(y) for y in ys], float), percent / 100)
                for i in np.flatnonzero(ok):
                    both = np.sort(np.concatenate([xs[i], ys[i]]))
                    inter = int((both[1:] == both[:-1]).sum())
                    ok[i] = 100 * inter >= percent * (len(both) - inter)
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(signed(mix(b.column("node").to_numpy().view(np.uint64))))], names=["key"])


def mixed_bitmap(nodes: DataFrame) -> np.ndarray:
    return fixed_bitmap(nodes.mapInArrow(_mixed, "key long"))


class NearDuplicates:
    """The tables of one run: `docs` (doc_id, n_shingles, node) and `links` (a, b) between class representatives."""

    def __init__(self, docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS):
        self.k, self.percent, self.bands, self.rows = shingle_words, percent, bands, rows
        self.source = bounded_batches(docs, BATCH_ROWS, BATCH_BYTES).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        sketched = self.source.mapInArrow(_sketches(shingle_words, bands * rows), "doc_id long, n_shingles long, set_a long, set_b long, sketch binary")
        self.sketched = materialise(sketched, "sketches")
        usable = self.sketched.where("n_shingles > 0 and doc_id is not null")
        # one row a class of equal sets, whose node is its smallest doc_id
        classes = usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        self.classes = materialise(classes.groupBy("node", "set_a", "set_b").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
        self.links = self._links().unionByName(materialise(self._repeated(usable), "repeats"))

    def _repeated(self, usable: DataFrame) -> DataFrame:
        """Links between the classes of every doc_id that stands for different sets."""
        rows = usable.select("doc_id", F.struct("set_a", "set_b").alias("s"))
        several = rows.groupBy("doc_id").agg(F.min("s").alias("x"), F.max("s").alias("y")).where("x <> y").select("doc_id")
        named = usable.select("doc_id", "set_a", "set_b").distinct().join(several, "doc_id").join(self.classes.select("set_a", "set_b", "node"), ["set_a", "set_b"])
        first = named.groupBy("doc_id").agg(F.min("node").alias("a"))
        return named.join(first, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()

    def _buckets(self) -> DataFrame:
        """(band, node, n, z1, z2, members) of buckets with two members or more."""
        rows = self.classes.select("node", "n", "sketch").mapInArrow(_bands(self.bands, self.rows), "band long, node long, n long, z1 long, z2 long")
        # written: no aggregate shares the join's stage, so that the rows of a hot band can be split; so in _open and _star
        full = materialise(rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "bands")
        buckets = materialise(rows.join(full, "band"), "buckets")
        release(full)
        return buckets

    def _pairs(self, joined: DataFrame) -> DataFrame:
        """Of rows with node, n, z1, z2 and another member in node_, n_, z1_, z2_: the pairs (a, b, na, nb) that sizes and bits allow."""
        fits = f"100 * least(n, n_) >= {self.percent} * greatest(n, n_) and bit_count(z1 ^ z1_) + bit_count(z2 ^ z2_) <= {MOST_BITS}"
        first = F.col("node") < F.col("node_")
        return joined.where(fits).select(
            F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b"),
            F.when(first, F.col("n")).otherwise(F.col("n_")).alias("na"), F.when(first, F.col("n_")).otherwise(F.col("n")).alias("nb"),
        )

    def _check(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        pairs = materialise(pairs.distinct(), "pairs")
        sets = self._full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        x, y = sets.toDF("a", "xs", "xk"), sets.toDF("b", "ys", "yk")
        tried = pairs.join(x, "a").join(y, "b").where("length(xs) > 0 and length(ys) > 0")
        links = materialise(tried.select("a", "b", "xs", "xk", "ys", "yk").mapInArrow(_verified(self.percent), "a long, b long"), "links")
        release(pairs, sets)
        return links

    def _full_sets(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles, sketch) of the nodes and of some others."""
        texts = self.source.where("doc_id is not null").withColumnRenamed("doc_id", "node")
        return materialise(texts.mapInArrow(_sets(self.k, self.bands * self.rows, mixed_bitmap(nodes)), "node long, shingles binary, sketch binary"), "sets")

    def _open(self, rows: DataFrame, links: DataFrame) -> DataFrame:
        """The rows of buckets that hold more than one component, with comp."""
        named = rows.join(connected_components(links, "a", "b"), "node", "left")
        named = named.withColumn("comp", F.coalesce("component", "node")).drop("component")
        named = materialise(named, "named")
        more = materialise(named.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band"), "more")
        still = materialise(named.join(more, "band"), "open")
        release(named, more)
        return still

    def _star(self, rows: DataFrame) -> DataFrame:
        """Pairs of every bucket's most central member with its other members."""
        central = rows.groupBy("node").agg(F.sum("members").alias("weight"))
        named = rows.join(central, "node")
        pivot = named.groupBy("band").agg(F.min(F.struct((-F.col("weight")).alias("o"), "node", "n", "z1", "z2")).alias("p"))
        other = materialise(pivot.select("band", *[F.col(f"p.{c}").alias(f"{c}_") for c in ("node", "n", "z1", "z2")]), "pivots")
        return self._pairs(rows.join(other, "band").where("node <> node_"))

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """Verified links between different components of the buckets, compared block by block."""
        size = rows.groupBy("band", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        total = size.groupBy("band").agg(F.max(F.struct("c", "comp", "s")).alias("m"), F.sum("c").alias("c"), F.sum("s").alias("s"))
        cut = lambda c, s: F.ceil(F.greatest(c / BLOCK, s / CELLS, F.lit(1)))
        # one row a bucket; then one a bucket and slot of its members, so that no join deals a bucket to one task
        plan = materialise(total.select("band", F.col("m.comp").alias("core"), cut(F.col("c"), F.col("s")).alias("n_all"), cut(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s")).alias("n_rest")), "plan")
        slot = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK))
        # the bucket's members are all here, so slots need no count beside `members`
        spread = plan.join(rows.groupBy("band").agg(F.max("members").alias("members")), "band").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("members") / BLOCK) - 1))).drop("members")
        placed = rows.withColumn("slot", slot).join(spread, ["band", "slot"]).withColumn("rest", (F.col("comp") != F.col("core")).cast("int"))
        block = F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("rest") == 1, F.col("n_rest")).otherwise(F.col("n_all")))
        keyed = placed.select("node", "comp", "band", "rest", block.alias("block"))
        whole = self._full_sets(rows.select("node"))
        sets = whole.drop("sketch").where("length(shingles) > 0")
        blocks = keyed.join(sets, "node").groupBy("band", "rest", "block").agg(F.collect_list(F.struct("node", "comp", "shingles")).alias("ms"))
        blocks = materialise(blocks, "blocks")
        release(whole)
        x = blocks.where("rest = 1").select("band", F.col("block").alias("bx"), F.col("ms").alias("xs"))
        y = blocks.select("band", F.col("rest").alias("ry"), F.col("block").alias("by"), F.col("ms").alias("ys"))
        counts = plan.select("band", F.explode(F.array(F.struct(F.lit(0).alias("ry"), F.col("n_all").alias("ny")), F.struct(F.lit(1).alias("ry"), F.col("n_rest").alias("ny")))).alias("o")).select("band", "o.ry", "o.ny")
        partners = plan.select("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rest") - 1)).alias("bx")).join(counts, "band").withColumn("by", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)))
        partners = partners.where("ry = 0 or bx <= by").select("band", "bx", "ry", "by")
        met = x.join(partners, ["band", "bx"]).join(y, ["band", "ry", "by"])
        links = materialise(met.select("xs", "ys").mapInArrow(_block_links(self.percent), "a long, b long").distinct(), "links")
        release(blocks, plan)
        return links

    def _links(self) -> DataFrame:
        rows = self._buckets()
        small, large = rows.where(F.col("members") <= SMALL), rows.where(F.col("members") > SMALL)
        other = small.select("band", *[F.col(c).alias(f"{c}_") for c in ("node", "n", "z1", "z2")])
        direct = self._pairs(small.join(other, "band").where("node < node_"))
        links = self._check(direct.unionByName(self._star(large)))
        still = self._open(large, links)
        more = self._blocks(still)
        release(rows, still)
        return links.unionByName(more)

    def members(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept, one row a row of the input."""
        comp = connected_components(self.links, "a", "b")
        node = self.classes.select("set_a", "set_b", "node").join(comp, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component_id"))
        rows = self.sketched.select("doc_id", "n_shingles", "set_a", "set_b")
        linked = rows.where("n_shingles > 0 and doc_id is not null").join(node, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id")
        alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, **more: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    return NearDuplicates(docs, shingle_words, percent, **more).members()


def keep_first(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those whose component holds a smaller doc_id."""
    gone = near_duplicates(docs, shingle_words, percent).where("n_shingles > 0 and not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["_gone"]) & docs["text"].rlike(r"[^\x20\x09-\x0D]"), "left_anti")
