"""Near-duplicate components by a MinHash LSH forest.

A document's set holds its distinct 5-word shingles; documents with equal
sets form one class and are one node from there on, however many there are.
Each node's MinHash signature is read in ``TREES`` orders of ``DEPTH`` values,
and every order is sorted as a whole:

1. Neighbours.  In each sorted order, rows that agree with their predecessor
   in at least ``LEAST`` leading values are candidates with that predecessor
   (the longest common prefix is always next to a row) and with the first row
   of the region that shares just as long a prefix: dense regions get deep
   ones, sparse regions shallow ones.  Candidates are confirmed on the full
   shingle sets and joined into components.
2. The rest.  Regions of ``LEAST`` equal values that still hold several
   components are compared in full, in blocks of bounded size: every node
   outside the region's main component against every node of another
   component, once for each pair.  Signatures that agree in fewer than
   ``AGREE`` places are left out (at the threshold, a share of 1e-8 of the
   pairs), the others are compared by their sets where they are; of the
   links that each node has to another component, one per block goes on to
   be confirmed on the full sets.

So a link is missed only if its two sets share no region in any order:
at a similarity of 0.75, with probability 2e-6.  No group of copies is ever
paired out, and no group is held in one task: sorted orders are dealt by
range, regions by blocks.

Defined results: a text without words (null, empty) has an empty set and is
linked with nothing; rows with equal doc_id are separate documents; a null
doc_id counts for no minimum, and a component without any doc_id has none
and is kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.llm.common import binary_column, mix64, stored, table

SHINGLE = 5
TREES, DEPTH, LEAST = 24, 5, 3
HASHES = TREES * DEPTH
#: Similarity of linked sets: PERCENT of the union at least.
PERCENT = 75
#: Six standard deviations below the share of equal signature values expected at the threshold.
AGREE = math.floor(HASHES * (PERCENT / 100 - 6 * math.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / HASHES)))
#: Rows of a region that are compared with as many others at a time.
BLOCK = 512

_BYTES = 4 * DEPTH
_WORDS_KEPT = 1 << 19
_CHUNK = 1 << 16

with np.errstate(over="ignore"):
    _PLACE = mix64(np.arange(1, 2 * SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
    _A = mix64(np.arange(1000, 1000 + HASHES, dtype=np.uint64)) | np.uint64(1)
    _B = mix64(np.arange(9000, 9000 + HASHES, dtype=np.uint64))


class WordHashes(dict):
    """Hashes of words, remembered; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = value
        return value


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Hashes, ascending, of the distinct shingles of a UTF-8 text; A-Z count as a-z."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - size + 1, _PLACE[SHINGLE + size - 1])
        for k in range(size):
            out += h[k:len(words) - size + 1 + k] * _PLACE[k]
    return np.unique(mix64(out))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures (a row of HASHES values each) of sets that aren't empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    done = 0
    while done < len(sets):
        upto, n = done, 0
        while upto < len(sets) and (n == 0 or n + len(sets[upto]) <= _CHUNK):
            n += len(sets[upto])
            upto += 1
        x = np.concatenate(sets[done:upto])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[done:upto - 1]])]).astype(np.int64)
        y = np.empty_like(x)
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                np.multiply(x, _A[k], out=y)
                y += _B[k]
                out[done:upto, k] = np.minimum.reduceat(y, starts) >> np.uint64(32)
        done = upto
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sets = [shingles(t, hashes) for t in binary_column(part.column(2))]
            full = [k for k, s in enumerate(sets) if len(s)]
            sigs = signatures([sets[k] for k in full])
            nodes: list[bytes | None] = [None] * len(sets)
            sig: list[bytes | None] = [None] * len(sets)
            for row, k in enumerate(full):
                nodes[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                sig[k] = sigs[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(nodes, pa.binary()), pa.array(sig, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "node", "sig"])


def document_sets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, node (digest of the set, null if empty), sig; stored."""
    rows = docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(
        _sets, "doc_id long, text_hash long, n_shingles long, node binary, sig binary"), "shingle-sets")


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _in_trees(nodes: DataFrame, *columns: str) -> DataFrame:
    """A row for each node and order."""
    return nodes.select(*columns, "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))


def _prefix(length: int) -> Column:
    return F.col("sig").substr(F.col("tree") * _BYTES + 1, F.lit(4 * length))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (tree, prefix, node) -> candidates (a, b), a < b; the first and the last row as (a, a)."""
    depths = np.arange(LEAST, DEPTH + 1)
    tree0, prefix0, node0 = None, None, None
    first0: list[bytes] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column(0).to_numpy()
        prefix = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, DEPTH)
        nodes = batch.column(2).to_pylist()
        same = np.zeros((len(nodes), DEPTH), bool)
        same[1:] = (prefix[1:] == prefix[:-1]) & (tree[1:] == tree[:-1])[:, None]
        pairs: list[tuple[bytes, bytes]] = []
        if node0 is None:
            pairs.append((nodes[0], nodes[0]))
        elif tree0 == tree[0]:
            same[0] = prefix[0] == prefix0
        common = np.cumprod(same, axis=1).sum(axis=1)
        rows = np.arange(len(nodes))
        region = np.array([np.maximum.accumulate(np.where(common < d, rows, -1)) for d in depths])
        for k in np.flatnonzero(common >= LEAST).tolist():
            d = int(common[k]) - LEAST
            before = nodes[k - 1] if k else node0
            pivot = nodes[region[d, k]] if region[d, k] >= 0 else first0[d]
            for other in {before, pivot}:
                if other != nodes[k]:
                    pairs.append((min(other, nodes[k]), max(other, nodes[k])))
        first0 = [nodes[region[d, -1]] if region[d, -1] >= 0 else first0[d] for d in range(len(depths))]
        tree0, prefix0, node0 = tree[-1], prefix[-1].copy(), nodes[-1]
        pairs = list(dict.fromkeys(pairs))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])
    if node0 is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node0], pa.binary())] * 2, names=["a", "b"])


def neighbour_candidates(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) of all orders, each once; (a, a) names a row at the edge of a task."""
    rows = _in_trees(nodes, "node").select("tree", _prefix(DEPTH).alias("prefix"), "node")
    ordered = rows.repartitionByRange("tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")
    return ordered.mapInArrow(_neighbours, "a binary, b binary").distinct()


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    known: dict[bytes, np.ndarray] = {}
    held = 0
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ta, tb = binary_column(batch.column(2)), binary_column(batch.column(3))
        linked = []
        for k in range(len(a)):
            both = []
            for node, text in ((a[k], ta[k]), (b[k], tb[k])):
                if node not in known:
                    if held > _WORDS_KEPT:
                        known.clear()
                        held = 0
                    known[node] = shingles(text, hashes)
                    held += len(known[node])
                both.append(known.get(node))
            x, y = both
            union = np.unique(np.concatenate([x, y])).size
            linked.append(100 * (x.size + y.size - union) >= PERCENT * union)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def confirmed(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs with linked = whether their full sets are as similar as asked; stored."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return stored(rows.mapInArrow(_confirm, "a binary, b binary, linked boolean"), name)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so paths
    halve; it ends when a round changes nothing."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both, "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"))
                    .select("node", "label"), "labels")
    while True:
        heard = (both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node"))
                 .agg(F.min("label").alias("heard")))
        lower = labels.join(heard, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        now = stored(lower.join(jump, "label").select(
            "node", "old", F.least("label", "further").alias("label")), "labels")
        labels = now.select("node", "label")
        if now.where("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, items): the size of the set, then 32 bits of each hash, ascending and distinct."""
    hashes = WordHashes()
    for batch in batches:
        items = []
        for text in binary_column(batch.column(1)):
            full = shingles(text, hashes)
            items.append(np.concatenate([[len(full)], np.unique(full >> np.uint64(32))]).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary())], names=["node", "items"])


def _may_link(x: np.ndarray, y: np.ndarray) -> bool:
    """False only if the full sets are not linked: hashes cut to 32 bits can hide as many shared shingles as
    collide within a set, and those are counted as shared."""
    shared = len(x) + len(y) - 2 - len(np.unique(np.concatenate([x[1:], y[1:]])))
    shared += int(x[0]) - (len(x) - 1) + int(y[0]) - (len(y) - 1)
    return 100 * shared >= PERCENT * (int(x[0]) + int(y[0]) - shared)


def _linked(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
    """Of one block: for each open row (side 0) and other component, one member (side 1) that may be linked.
    A pair that shares regions in several orders is compared in the first of them."""
    members = [r for r in rows if r[1]]
    opened = [r for r in rows if not r[1]]
    if not members or not opened:
        return []
    tree = rows[0][0][0] - 65
    grid = np.frombuffer(b"".join(r[4] for r in members), np.uint32).reshape(-1, HASHES)
    sets: dict[int, np.ndarray] = {}
    out = []
    for _, _, node, component, sig, items, _ in opened:
        same = grid == np.frombuffer(sig, np.uint32)
        agree = same.sum(axis=1)
        near = np.flatnonzero(agree >= AGREE)
        near = near[same[near].reshape(-1, TREES, DEPTH)[:, :, :LEAST].all(axis=2).argmax(axis=1) == tree]
        own, joined = np.frombuffer(items, np.uint32), {component}
        for k in near[np.argsort(-agree[near], kind="stable")].tolist():
            _, _, other, other_component, _, other_items, other_open = members[k]
            # a pair of two open rows is met twice
            if other_component in joined or other_open and other < node:
                continue
            if k not in sets:
                sets[k] = np.frombuffer(other_items, np.uint32)
            if _may_link(own, sets[k]):
                joined.add(other_component)
                out.append((min(node, other), max(node, other)))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, side, node, component, sig, items, open) sorted by key -> pairs (a, b)."""

    def rows(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        out: list[tuple[bytes, bytes]] = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                out += _linked(held)
                held = []
            held.append(row)
        yield rows(out)
    if held:
        yield rows(_linked(held))


def open_candidates(nodes: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates (a, b) of different components within regions of LEAST equal values."""
    labelled = nodes.join(labels, "node", "left").select(
        "node", "sig", F.coalesce("component", "node").alias("component"))
    rows = _in_trees(labelled, "node", "component").select(
        F.concat(F.encode(F.char(F.col("tree") + 65), "utf-8"), _prefix(LEAST)).alias("region"), "node", "component")
    mixed = (
        rows.groupBy("region", "component").agg(F.count("*").alias("n"))
        .groupBy("region").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main"),
                               F.max("n").alias("most"), F.sum("n").alias("n"))
        .where("parts > 1")
        .select("region", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
                F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("open_blocks")))
    found = stored(rows.join(mixed, "region").withColumn("open", F.col("component") != F.col("main")), "mixed-regions")
    items = stored(texts.mapInArrow(_compact, "node binary, items binary"), "compact-sets")
    payload = nodes.join(items, "node").select("node", "sig", "items")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["region", "block", "open_block", "side", "node", "component", "open"]
    members = found.withColumn("block", block("blocks")).withColumn("open_block", every("open_blocks"))
    opened = found.where("open").withColumn("open_block", block("open_blocks")).withColumn("block", every("blocks"))
    dealt = members.withColumn("side", F.lit(1)).select(*names).unionByName(
        opened.withColumn("side", F.lit(0)).select(*names)).join(payload, "node")
    keyed = dealt.select(F.concat("region", F.encode(F.concat_ws(" ", "block", "open_block"), "utf-8")).alias("key"),
                         "side", "node", "component", "sig", "items", "open")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): doc_id, text_hash, n_shingles, component_id, kept."""
    sets = document_sets(docs)
    classes = stored(
        sets.where(F.col("node").isNotNull()).groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"),
            F.min("sig").alias("sig")).select("node", "first.doc_id", "first.text_hash", "sig"), "set-classes")
    nodes = classes.select("node", "sig")
    near = stored(neighbour_candidates(nodes), "candidates")
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node")
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("text_hash"))
    texts = stored(
        source.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
                               & (F.col("d.text_hash") == F.col("w.text_hash")))
        .select("node", "text").dropDuplicates(["node"]), "candidate-texts")
    checked = confirmed(near.where("a < b"), texts, "checked")
    labels = components(checked.where("linked"))
    rest = open_candidates(nodes, labels, texts).join(checked, ["a", "b"], "left_anti")
    again = confirmed(rest, texts, "checked-rest")
    more = again.where("linked")
    if not more.isEmpty():
        # what the first round joined is an edge from each node to its component
        joined = labels.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        labels = components(joined.unionByName(more.select("a", "b")))
    named = classes.select("node", "doc_id").join(labels, "node", "left").select(
        "node", "doc_id", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = named.join(smallest, "component").select("node", "component_id")
    out = sets.select("doc_id", "text_hash", "n_shingles", "node").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def keep_one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each component; of rows that are equal in doc_id and text, one.  Columns stay."""
    kept = near_duplicates(docs).where("kept").select("doc_id", "text_hash").distinct()
    own = docs.alias("d").join(
        kept.alias("k"),
        F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id"))
        & F.xxhash64(F.col("d.text").cast("string")).eqNullSafe(F.col("k.text_hash")), "left_semi")
    return own.dropDuplicates(["doc_id", "text"])


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared s JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)),
reach AS (
  SELECT doc_id, doc_id AS r FROM words
  UNION
  SELECT reach.doc_id, b FROM reach JOIN links ON reach.r = a),
component AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM words w LEFT JOIN size USING (doc_id) JOIN component USING (doc_id)
"""
