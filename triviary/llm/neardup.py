"""Near-duplicate documents by SetSketch registers: bands propose, likelihood screens, full sets confirm.

A document's set holds its distinct shingles of `width` words. A register is the least of exponential variates of the set's elements, on a
logarithmic scale of base `B`, truncated to a byte; an element's variates come from one Poisson process over all registers, so a
document costs about M (ln M + 1) points however many shingles it has. Registers of a union are the maxima of the registers.

1. Rows of equal sets become one node. Nodes are banded by `R` registers each; two nodes of similarity 0.8 share a band
   with probability over 1 - 1e-6.
2. Each node is linked to the least node of the buckets that name it most often, if the full sets confirm it; components of these links.
3. In buckets that still hold several components, pairs across components are screened by the joint likelihood of their registers, in blocks.
   What plausible pairs join is a cluster; each cluster's nodes meet block by block, and its plausible pairs across components are
   confirmed on the full sets there. Tasks return spanning forests, never all pairs.

So a group of any size is linked through few pairs, but no pair that shares a bucket and may be similar is left out.
Rows travel as 8-byte hashes or byte registers; texts only for nodes that share a bucket.

Nulls and texts without words have the empty set and are linked with nothing. A text of fewer than `width` words is one shingle. A null key is
never a component's least if another is there. Rows with repeated keys are nodes of their own. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, slices, written
from .graph import components
from .words import SPACES, buffers, mix, shingles

R, BANDS = 6, 42
M = R * BANDS
B = 1.2
OFFSET = 32
U = np.uint64
WORD = ~SPACES


def sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted hashes."""
    out: list[np.ndarray] = [np.zeros(0, U)] * len(texts)
    held: dict[int, list[np.ndarray]] = {}
    for start, w in buffers(texts, WORD):
        if not len(w.hash):
            continue
        n = int(w.text[-1]) + 1
        cuts = np.searchsorted(w.text, np.arange(n + 1))
        if n == 1:
            held.setdefault(start, []).append(w.hash)
            continue
        s = shingles(w.hash, width) if len(w.hash) >= width else np.zeros(0, U)
        for i, a, z in zip(range(start, start + n), cuts.tolist(), cuts[1:].tolist()):
            if z - a >= width:
                out[i] = np.unique(s[a : z - width + 1])
            elif z > a:
                out[i] = shingles(w.hash[a:z], z - a)
    for i, parts in held.items():
        h = np.concatenate(parts)
        out[i] = np.unique(shingles(h, min(width, len(h))))
    return out


def sketch(own: list[np.ndarray]) -> np.ndarray:
    """The registers of each (non-empty) set: uint8, one row of M per set."""
    size = np.fromiter(map(len, own), np.int64, len(own))
    least = np.full((len(own), M), np.inf)
    h = np.concatenate(own) if own else np.zeros(0, U)
    doc = np.repeat(np.arange(len(own)), size)
    x = np.zeros(len(h))
    level = 0
    while len(h):
        steps = 1 if len(h) > 20_000 else min(64, max(1, 40_000 // len(h)))
        j = np.arange(level, level + steps, dtype=U)
        a = mix(h[:, None] + (j * U(0x9E3779B97F4A7C15))[None, :])
        x = x[:, None] - np.cumsum(np.log(((a >> U(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1) / M
        reg = (((mix(a ^ U(0xA5A5A5A5A5A5A5A5)) >> U(32)) * U(M)) >> U(32)).astype(np.int64)
        np.minimum.at(least.reshape(-1), (doc[:, None] * M + reg).ravel(), x.ravel())
        docs = doc[np.concatenate([[True], doc[1:] != doc[:-1]])]
        top = np.empty(len(own))
        top[docs] = least[docs].max(axis=1)
        x = x[:, -1]
        go = x < top[doc]
        h, doc, x = h[go], doc[go], x[go]
        level += steps
    return np.clip(np.floor(-np.log(least) / np.log(B)) + OFFSET, 0, 255).astype(np.uint8)


def bands(registers: np.ndarray) -> np.ndarray:
    """The hash of each band of registers."""
    r = registers.reshape(len(registers), BANDS, R).astype(U)
    out = np.arange(1, BANDS + 1, dtype=U)[None, :] * U(0x9E3779B97F4A7C15)
    for i in range(R):
        out = mix(out + r[:, :, i])
    return out.astype(np.int64)


def plausible(above: np.ndarray, below: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, least: float, slack: float = 14.0) -> np.ndarray:
    """Whether a similarity of `least` or more is within `slack` of the best log-likelihood, from the counts of larger and smaller registers."""
    u = n_u / (n_u + n_v)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    best, good = np.full(len(u), -np.inf), np.full(len(u), -np.inf)
    for t in np.linspace(0, 1, 101):
        j = np.minimum(t, most)
        a, b = p(u - v * j), p(v - u * j)
        log = above * np.log(np.maximum(a, 1e-9)) + below * np.log(np.maximum(b, 1e-9)) + (M - above - below) * np.log(np.maximum(1 - a - b, 1e-9))
        best = np.maximum(best, log)
        good = np.maximum(good, np.where(j >= least - 1e-9, log, -np.inf))
    return (good >= best - slack) & (most >= least - 1e-9)


def sketched(docs: DataFrame, key: str, text: str, width: int, least: float) -> DataFrame:
    """(key, th, n, set, registers) of every row: th names the text, set the shingles.

    Registers are null for sets too small to be linked with any but an equal one: n / (n + 1) is under `least`.
    """
    per = round(100 * least)
    schema = T.StructType([docs.schema[key], T.StructField("th", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField("registers", T.BinaryType())])

    def run(batches):
        claim("neardup")
        for b in slices(batches, 1, 2 << 20):
            own = sets([(t or "").encode() for t in b.column(1).to_pylist()], width)
            names = [None if not len(s) else np.array([len(s), s.sum(dtype=U), np.bitwise_xor.reduce(mix(s))], U)[1:].tobytes() + len(s).to_bytes(4, "big") for s in own]
            large = [i for i, s in enumerate(own) if 100 * len(s) >= per * (len(s) + 1)]
            regs: list = [None] * len(own)
            for i, r in zip(large, sketch([own[i] for i in large])):
                regs[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(map(len, own)), pa.int64()), pa.array(names, pa.binary()), pa.array(regs, pa.binary())], names=schema.names)

    return docs.select(key, text, F.xxhash64(text).alias("th")).mapInArrow(run, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (u, v) whose full sets have a similarity of `least` or more; texts: (node, text)."""
    a, b = texts.select(F.col("node").alias("u"), F.col("text").alias("ut")), texts.select(F.col("node").alias("v"), F.col("text").alias("vt"))
    per = round(100 * least)

    def run(batches):
        for batch in batches:
            for part in slices(slices(iter([batch]), 2, 4 << 20), 3, 4 << 20):
                ours = [sets([(t or "").encode() for t in part.column(i).to_pylist()], width) for i in (2, 3)]
                fine = []
                for x, y in zip(*ours):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    fine.append(100 * both >= per * (len(x) + len(y) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["u", "v"]).filter(pa.array(fine))

    return pairs.join(a, "u").join(b, "v").select("u", "v", "ut", "vt").mapInArrow(run, "u long, v long")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs that join what all pairs (u, v) join, one less than nodes in each tree."""
    parent: dict[int, int] = {}
    a, b = [], []

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(u.tolist(), v.tolist()):
        p, q = find(x), find(y)
        if p != q:
            parent[p] = q
            a.append(x)
            b.append(y)
    return a, b


def across(members: DataFrame, least: float) -> DataFrame:
    """(u, v): a spanning forest, per task, of the plausible pairs across components that share a bucket; members: (band, count, node, comp, n, registers)."""
    per = 1024
    blocks = F.ceil(F.col("count") / per).cast("int")
    m = members.withColumn("_nb", blocks).withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_nb")).cast("int"))
    m = m.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    m = m.select("band", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), F.col("_b").alias("b"), "node", "comp", "n", "registers")

    def block(side, i, j, comp, node, reg):
        """Row numbers of the pairs of one block that share enough registers, and how many these are."""
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        us, vs, same = [], [], []
        for s in range(0, len(left), 64):
            rows = left[s : s + 64]
            ok = comp[rows][:, None] != comp[right][None, :]
            if i == j:
                ok &= node[rows][:, None] < node[right][None, :]
            a, b = np.nonzero(ok)
            a, b = rows[a], right[b]
            eq = np.concatenate([(reg[a[k : k + 8192]] == reg[b[k : k + 8192]]).sum(axis=1) for k in range(0, len(a), 8192)]) if len(a) else a
            ok = eq >= floor
            us.append(a[ok])
            vs.append(b[ok])
            same.append(eq[ok])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs, same))

    def judged(held):
        u, v, same, above, nu, nv = (np.concatenate(x) for x in zip(*held))
        ok = plausible(above, M - same - above, nu.astype(float), nv.astype(float), least)
        a, b = forest(u[ok], v[ok])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    def run(batches):
        claim("neardup")
        held, size = [], 0
        for t in whole_groups(batches, ("band", "i", "j")):
            band, i, j, side, node, comp, n = (t.column(c).to_numpy() for c in ("band", "i", "j", "b", "node", "comp", "n"))
            reg = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint8).reshape(len(node), M)
            cuts = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]])).tolist()
            for a, z in zip(cuts, cuts[1:]):
                u, v, same = block(side[a:z], i[a], j[a], comp[a:z], node[a:z], reg[a:z])
                if len(u):
                    u, v = u + a, v + a
                    above = np.concatenate([(reg[u[k : k + 8192]] > reg[v[k : k + 8192]]).sum(axis=1) for k in range(0, len(u), 8192)])
                    held.append((node[u], node[v], same, above, n[u], n[v]))
                    size += len(u)
                    if size > 200_000:
                        yield judged(held)
                        held, size = [], 0
        if held:
            yield judged(held)

    floor = least * M - 6 * np.sqrt(least * (1 - least) * M)
    return m.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "u long, v long")


def settled(members: DataFrame, width: int, least: float, rows: int = 2048, size: int = 16 << 20) -> DataFrame:
    """(u, v): links that join what all links across components inside a cluster join; members: (cluster, node, comp, n, registers, text).

    A cluster is cut into blocks by rows and bytes, and every two blocks meet in one task, which tests the plausible pairs of nodes that are in
    different components, its own new links included, on their full sets. Only a spanning forest of links leaves the task.
    """
    total = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum(F.octet_length("text")) / size)).cast("int").alias("_nb"))
    m = members.join(total, "cluster").withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_nb")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    m = m.select("cluster", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), F.col("_b").alias("b"), "node", "comp", "n", "registers", "text")
    per, floor = round(100 * least), least * M - 6 * np.sqrt(least * (1 - least) * M)

    def links(i, j, side, node, comp, n, reg, own):
        label = np.unique(comp, return_inverse=True)[1]
        ids = np.unique(np.concatenate(own), return_inverse=True)[1] if own else np.zeros(0, int)
        ends = np.cumsum([len(x) for x in own])
        starts = ends - n
        mark = np.zeros(int(ids.max(initial=-1)) + 1, bool)
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        for k in range(0, len(left), 64):
            rows = left[k : k + 64]
            ok = label[rows][:, None] != label[right][None, :]
            if i == j:
                ok &= node[rows][:, None] < node[right][None, :]
            a, b = np.nonzero(ok)
            a, b = rows[a], right[b]
            equal = np.concatenate([(reg[a[x : x + 8192]] == reg[b[x : x + 8192]]).sum(axis=1) for x in range(0, len(a), 8192)]) if len(a) else a
            a, b, equal = a[equal >= floor], b[equal >= floor], equal[equal >= floor]
            above = np.concatenate([(reg[a[x : x + 8192]] > reg[b[x : x + 8192]]).sum(axis=1) for x in range(0, len(a), 8192)]) if len(a) else a
            fine = plausible(above, M - equal - above, n[a].astype(float), n[b].astype(float), least)
            a, b = a[fine], b[fine]
            edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])).tolist() if len(a) else []
            for x, z in zip(edge, edge[1:]):
                r, o = a[x], b[x:z]
                o = o[label[o] != label[r]]
                if not len(o):
                    continue
                mark[ids[starts[r] : ends[r]]] = True
                both = np.array([np.count_nonzero(mark[ids[starts[y] : ends[y]]]) for y in o.tolist()])
                mark[ids[starts[r] : ends[r]]] = False
                for y in o[100 * both >= per * (n[r] + n[o] - both)].tolist():
                    if label[y] != label[r]:
                        yield int(node[r]), int(node[y])
                        label[label == label[y]] = label[r]

    def run(batches):
        claim("neardup")
        for t in whole_groups(batches, ("cluster", "i", "j")):
            cluster, i, j, side, node, comp, n = (t.column(c).to_numpy() for c in ("cluster", "i", "j", "b", "node", "comp", "n"))
            reg = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint8).reshape(len(node), M)
            own = sets([(x or "").encode() for x in t.column("text").to_pylist()], width)
            cuts = np.flatnonzero(np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]])).tolist()
            found = [x for a, z in zip(cuts, cuts[1:]) for x in links(i[a], j[a], side[a:z], node[a:z], comp[a:z], n[a:z], reg[a:z], own[a:z])]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

    return m.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(run, "u long, v long")


def whole_groups(batches, columns: tuple[str, ...]):
    """Tables of sorted rows that hold every group of equal columns whole."""
    rest = None
    for b in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        same = None
        for c in columns:
            eq = pc.equal(t.column(c), t.column(c)[-1])
            same = eq if same is None else pc.and_(same, eq)
        k = t.num_rows - pc.sum(same).as_py()
        if k:
            yield t.slice(0, k).combine_chunks()
        rest = t.slice(k)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, least: float = 0.8) -> DataFrame:
    """(key, th, n_shingles, component_id, group, kept) of every row.

    th is xxhash64 of the text; component_id the least key among all that links reach; group numbers the components and is null for empty sets.
    """
    rows = written(sketched(docs, key, text, width, least), "sketches")
    # nodes: one for each distinct set, numbered where they are written
    nodes = rows.where("set is not null").groupBy("set").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("th").alias("th"))).alias("rep"), F.max("n").alias("n"), F.max("registers").alias("registers"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "set", "rep", "n", "registers"), "nodes")

    def band(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                reg = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, M)
                yield pa.RecordBatch.from_arrays([pa.array(bands(reg).ravel()), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["band", "node"])

    banded = nodes.where("registers is not null").select("node", "registers").mapInArrow(band, "band long, node long")
    buckets = banded.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("count")).where("count > 1")
    shared = written(banded.join(buckets, "band").select("band", "node", "first", "count"), "buckets")
    reps = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", F.col("rep.key").alias("k"), F.col("rep.th").alias("h"))
    d = docs.select(F.col(key).alias("k2"), F.col(text).alias("text"), F.xxhash64(text).alias("h2"))
    texts = written(reps.join(d, reps.k.eqNullSafe(d.k2) & (reps.h == d.h2)).select("node", "text"), "texts")
    votes = shared.where("node <> first").groupBy("node", "first").agg(F.count("*").alias("votes"))
    tried = votes.groupBy("node").agg(F.max_by("first", F.struct("votes", -F.col("first"))).alias("first"))
    links = written(confirmed(tried.select(F.col("node").alias("u"), F.col("first").alias("v")), texts, width, least).distinct(), "links")
    found = components(links)
    label = found.select(F.col("node").alias("x"), "least")
    now = written(shared.join(label, shared.node == label.x, "left").select("band", "node", "count", F.coalesce("least", "node").alias("comp")), "labels")
    open_ = now.groupBy("band").agg(F.min("comp").alias("a"), F.max("comp").alias("z")).where("a <> z").select("band")
    members = now.join(open_, "band", "left_semi").join(nodes.select("node", "n", "registers"), "node").select("band", "count", "node", "comp", "n", "registers")
    tied = written(across(members, least), "tied")
    if not tied.isEmpty():
        ends = components(tied)
        clusters = ends.select("node", F.col("least").alias("cluster")).unionByName(ends.select(F.col("least").alias("node"), F.col("least").alias("cluster")).distinct())
        comps = now.select("node", "comp").distinct()
        rest = clusters.join(comps, "node").join(nodes.select("node", "n", "registers"), "node").join(texts, "node")
        new = settled(rest.select("cluster", "node", "comp", "n", "registers", "text"), width, least)
        found = components(written(links.unionByName(new).distinct(), "links"))
    label = found.select(F.col("node").alias("x"), "least")
    named = nodes.join(label, nodes.node == label.x, "left").select("set", F.col("rep.key").alias("key"), F.coalesce("least", "node").alias("group"))
    least_key = named.groupBy("group").agg(F.min("key").alias("component_id"))
    named = named.join(least_key, "group").select("set", "component_id", "group")
    component = F.when(F.col("set").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return rows.join(named, "set", "left").select(key, "th", F.col("n").alias("n_shingles"), component.alias("component_id"), "group").withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
