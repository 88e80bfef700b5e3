"""Near-duplicate detection with dart-throwing weighted minwise hashing.

*Signature* (DartMinHash): every element has a region as wide as its weight, over which darts fall as a Poisson
process in the rank direction; place and rank of each dart are hashed from element, strip and number, so all
documents see the same darts. Only darts up to a rank near k ln k + 2k over the document's weight are thrown,
about as many as the signature needs, whatever the document's length. Each dart has one of k coordinates and the
earliest per coordinate is the signature; a document with an empty coordinate doubles its ranks. Two documents agree
in a coordinate with a chance equal to their weighted Jaccard similarity.

*Banded joining*: documents with an equal band are linked to the least text of that band (never in pairs), and the
components of these links are the candidate groups. With 24 bands of 4 a pair at similarity 0.8 shares a band with a
chance of 0.999997.

*Verification* is exact: within a candidate group, shingle sets are compared through inverted lists, and only links
at the threshold or above join texts to a class. A group larger than a block is compared in three steps: each block in
itself; then, of each block, the largest class's first text with those of the other blocks; then what is still outside the
group's largest class with all texts of the group. Two texts within one class need no comparison, so no link between
classes is lost. Each comparison returns a spanning forest, never all its links.

Exact copies are one text throughout (equal 128-bit hash, then a number of its own), so copies never meet in a band.

Defined cases: null texts are empty; empty texts (without a word) are in one class only if they are equal byte for
byte; a text shorter than a shingle is one shingle; equal shingles count once; repeated rows and repeated ids with
equal texts are copies; rows with a null id take part and have their class's least id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_dealt, materialise, mix64, ranges, row_key, slices, spans, texts, tune
from .components import components
from .words import shingles

BANDS, ROWS = 24, 4
#: Texts and words in a block of a candidate group.
BLOCK_TEXTS, BLOCK_WORDS = 256, 200_000
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def signatures(elements: np.ndarray, weights: np.ndarray | None, bounds: np.ndarray, k: int) -> np.ndarray:
    """Signatures (n, k) of weighted sets that lie one after the other; zeros for sets without weight.

    ``weights`` None: all one. A weight w covers the strips [0, 1), [1, 2), ... up to w.
    """
    n = len(bounds) - 1
    count = np.diff(bounds)
    doc = np.repeat(np.arange(n), count)
    if weights is None:
        strip, width = np.zeros(len(elements), np.uint64), None
        total = count.astype(float)
    else:
        strips = np.ceil(np.maximum(weights, 0)).astype(np.int64)
        total = np.bincount(doc, np.maximum(weights, 0), minlength=n)
        strip = ranges(np.zeros(len(strips), np.int64), strips).astype(np.uint64)
        width = np.repeat(weights, strips) - strip
        elements, doc = np.repeat(elements, strips), np.repeat(doc, strips)
    root = mix64(elements + (strip + np.uint64(1)) * ODD[0])
    sig = np.full(n * k, np.iinfo(np.uint64).max, dtype=np.uint64)
    far = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    todo = np.flatnonzero(total > 0)
    live = np.arange(len(root))
    while len(todo):
        rank = np.zeros(len(live))
        r, d = root[live], doc[live]
        j = 0
        while len(r):
            j += 1
            x = mix64(r + np.uint64(j * int(ODD[1]) % (1 << 64)))
            u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            hit = u >= np.exp(rank - far[d])
            live_u = u[hit]
            r, d, rank, x = r[hit], d[hit], rank[hit] - np.log(live_u), x[hit]
            if width is not None:
                live = live[hit]
            y = mix64(x ^ ODD[2])
            key = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | (y & np.uint64(0xFFFFFFFF))
            spot = d * k + ((y >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            if width is not None:
                inside = ((mix64(x ^ ODD[3]) >> np.uint64(11)).astype(np.float64) * 2.0**-53) < width[live]
                spot, key = spot[inside], key[inside]
            np.minimum.at(sig, spot, key)
        empty = (sig.reshape(n, k)[todo] == np.iinfo(np.uint64).max).any(axis=1)
        todo = todo[empty]
        far[todo] *= 2
        again = np.zeros(n, dtype=bool)
        again[todo] = True
        live = np.flatnonzero(again[doc])
    sig = sig.reshape(n, k)
    sig[total <= 0] = 0
    return sig


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band (n, k // rows)."""
    n, k = sig.shape
    out = np.zeros((n, k // rows), dtype=np.uint64)
    for r in range(rows):
        out = mix64(out * ODD[0] + sig[:, r::rows][:, : k // rows])
    return mix64(out + np.arange(1, k // rows + 1, dtype=np.uint64) * ODD[3])


def classes(sets: list[np.ndarray], threshold: float, probe: list[int] | None = None) -> np.ndarray:
    """For each sorted set of distinct hashes the place of the first set of its class, by exact Jaccard links.

    With ``probe`` only links of the sets at these places are looked for.
    """
    n = len(sets)
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.array([len(s) for s in sets], dtype=np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True) if size.sum() else (None, np.zeros(0, np.int64))
    at = spans(size)
    doc = np.repeat(np.arange(n), size)
    order = np.argsort(ids, kind="stable")
    posts = doc[order]
    often = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    head = spans(often)
    for a in range(1, n) if probe is None else probe:
        mine = ids[at[a] : at[a + 1]]
        mine = mine[often[mine] > 1]
        if not len(mine):
            continue
        both = np.bincount(posts[ranges(head[mine], often[mine])], minlength=n)
        both = both[:a] if probe is None else both
        union = size[a] + size[: len(both)] - both
        for b in np.flatnonzero((both > 0) & (both >= threshold * union - 1e-9)).tolist():
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)], dtype=np.int64)


def _verified(blocks: DataFrame, n: int, threshold: float) -> DataFrame:
    """Forest edges (node, other) of the classes within each block; ``blocks`` has root, i, j, node, text and probe (whose links count)."""

    def solve(rows: list[tuple[int, str, bool]]) -> Iterator[pa.RecordBatch]:
        first, asked = {}, set()
        for node, text, probe in rows:
            first[node] = text
            if probe:
                asked.add(node)
        names = sorted(first)
        flat, at = shingles(pa.array([first[x] for x in names], pa.large_string()), n)
        probe = None if len(asked) == len(names) else [i for i, x in enumerate(names) if x in asked]
        got = classes([np.unique(flat[a:b]) for a, b in zip(at, at[1:])], threshold, probe)
        some = np.flatnonzero(got != np.arange(len(got)))
        if len(some):
            ids = np.array(names, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[got[some]])], names=["node", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for *key, node, text, probe in zip(*(b.column(c).to_pylist() for c in ("root", "i", "j", "node", "text", "probe"))):
                if key != now:
                    if len(rows) > 1:
                        yield from solve(rows)
                    now, rows = key, []
                rows.append((node, text, probe))
        if len(rows) > 1:
            yield from solve(rows)

    dealt = blocks.select("root", "i", "j", "node", "text", "probe").repartition("root", "i", "j")
    return dealt.sortWithinPartitions("root", "i", "j").mapInArrow(run, "node long, other long")


def _parts():
    """Blocks that texts with sizes need."""
    return F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_WORDS), F.lit(1)).cast("int")


def _block(n: str):
    return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")


def _across(big: DataFrame, links: DataFrame, n: int, threshold: float) -> DataFrame:
    """Links between the blocks of large groups; ``big`` has root, n, i (block), node, size, text; ``links`` those within blocks."""
    # a text is in one block, and links within it lead to the first text of the text's class
    classed = big.drop("text").dropDuplicates(["node"]).join(links.select("node", F.col("other").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node"))
    classed = materialise(classed, "classed")
    sizes = classed.groupBy("root", "i", "class").agg(F.count("*").alias("c"), F.max_by("size", F.col("node") == F.col("class")).alias("size"))
    # the first text of each block's largest class, with those of the group's other blocks
    heads = sizes.groupBy("root", "i").agg(F.max_by(F.struct("class", "size"), F.struct("c", "class")).alias("x")).select("root", F.col("x.class").alias("node"), "x.size")
    heads = heads.join(heads.groupBy("root").agg(_parts().alias("m")), "root").select("node", _block("m").alias("k"))
    met = big.join(heads, "node").select("root", F.col("k").alias("i"), F.lit(-1).alias("j"), "node", "text", F.lit(True).alias("probe"))
    met = materialise(_verified(met, n, threshold), "met")
    # what is outside the group's largest class, with all of the group
    joined = sizes.join(met.select(F.col("node").alias("class"), "other"), "class", "left").withColumn("far", F.coalesce("other", "class"))
    joined = materialise(joined.select("root", "i", "class", "far", "c"), "joined")
    top = joined.groupBy("root", "far").agg(F.sum("c").alias("c")).groupBy("root").agg(F.max_by("far", F.struct("c", "far")).alias("top"))
    apart = joined.join(top, "root").where("far <> top").select("root", "i", "class")
    rest = materialise(classed.join(apart, ["root", "i", "class"]).select("node", "root", "size"), "rest")
    parts = rest.groupBy("root").agg(_parts().alias("m"))
    rest = rest.join(parts, "root").select("node", _block("m").alias("k"))
    lone = big.join(rest, "node").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("root", F.col("k").alias("i"), "j", "node", "text", F.lit(True).alias("probe"))
    every = big.join(parts, "root").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("root", F.col("k").alias("i"), F.col("i").alias("j"), "node", "text", F.lit(False).alias("probe"))
    return links.unionByName(met).unionByName(_verified(lone.unionByName(every), n, threshold))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, band_count: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the least id of its class), class_rows, text_hash (xxhash64 of the text) and
    kept (its text stands for the class: the least id's, of several texts with that id the one with the least hash)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                flat, at = shingles(part.column("text"), n)
                got = bands(signatures(flat, None, at, band_count * rows), rows).astype(np.int64)
                size = np.diff(at)
                lists = pa.ListArray.from_arrays(pa.array(spans(np.where(size > 0, band_count, 0)).astype(np.int32)), pa.array(got[size > 0].ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "h1", "h2")), pa.array(size), lists], names=["doc_id", "h1", "h2", "size", "bands"])

    tune(docs.sparkSession)
    own = texts(docs, id_col, text_col)
    key = ["h1", "h2"]
    keyed = own.select("doc_id", "text", *row_key())
    signed = materialise(keyed.mapInArrow(sign, "doc_id long, h1 long, h2 long, size long, bands array<long>"), "signed")
    # one node per distinct text: copies are summed up before anything else; written, so that the numbers stay
    nodes = signed.groupBy(*key).agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    n_nodes = nodes.count()
    stars = join_dealt(banded, heads, ["band"], "n", band_count * n_nodes).where("node <> head").select("node", "head").distinct()
    groups = components(stars, "node", "head")
    # blocks of a candidate group: by hash, as many as its texts and words need
    sized = materialise(groups.join(nodes.select("node", "size", "least", *key), "node"), "sized")
    parts = sized.groupBy("root").agg(_parts().alias("n"), F.count("*").alias("c"))
    dealt = materialise(join_dealt(sized, parts, ["root"], "c", n_nodes).withColumn("i", _block("n")).drop("c"), "dealt")

    def held(of: DataFrame) -> DataFrame:
        """With the text, read from a row with the least id: the id is part of the key, so copies are dealt over tasks."""
        o = of.select("root", "n", "i", "node", "size", *(F.col(x).alias(f"{x}_") for x in ("least", *key)))
        return keyed.join(o.hint("merge"), (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")) & F.col("doc_id").eqNullSafe(F.col("least_"))).select("root", "n", "i", "node", "size", "text")

    whole = held(dealt)
    several = not dealt.where("n > 1").isEmpty()
    if several:  # read again for what lies across blocks
        whole = materialise(whole, "whole")
    links = _verified(whole.withColumns({"j": F.lit(0), "probe": F.lit(True)}), n, threshold)
    if several:
        links = _across(whole.where("n > 1"), materialise(links, "links"), n, threshold)
    links = components(links, "node", "other")
    named = materialise(nodes.select("node", *key, "least", "rows").join(links, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    sums = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "h1", "h2", "node")).alias("first"), F.sum("rows").alias("class_rows"), F.count("*").alias("c"))
    of_node = join_dealt(named, sums, ["root"], "c", n_nodes).select(*key, "rows", F.col("first.least").alias("class_id"), "class_rows", (F.col("node") == F.col("first.node")).alias("stands"))
    out = join_dealt(signed.select("doc_id", *key), materialise(of_node, "of_node"), key, "rows", signed.count())
    return out.select("doc_id", "class_id", "class_rows", F.col("h1").alias("text_hash"), (F.col("stands") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))
